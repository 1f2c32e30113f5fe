"""Corpus pipeline: five stages over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and all rows of the stage before. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import jaccard, langid, lines, mixing, pieces
from vigil.session import drop, release, table, tables, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null texts and texts without a letter go, and nothing else if no language was learned."""
    docs = _shaped(docs)
    labelled = langid.sample(docs)
    if not labelled:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, labelled)
    return _shaped(found.where(F.col("lang_pred") != langid.UND))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source are cut; n_chars counts what is left. Every document stays.

    Null texts stay null and null sources are one source; repeated rows are cut alike.
    """
    cut = lines.line_dedup(_shaped(docs))
    return _shaped(cut.withColumn("n_chars", F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five words, the least doc_id stays."""
    return _shaped(jaccard.near_dedup(_shaped(docs), k=5, percent=80))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Repeated rows and rows without an id each have a draw of their own; null and
    empty texts are drawn like others; an empty table stays empty.
    """
    return _shaped(mixing.mix(_shaped(docs)))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids, n_tokens and exact; a null text has no ids, equal texts have equal ones."""
    return pieces.tokenize(_shaped(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Language ID and the last stage have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. Tables that a stage worked with, and its input if a stage before wrote it, are dropped once its result is written."""
    docs, own = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        before = set(tables())
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        *scratch, result = [t for t in tables() if t not in before]
        drop(spark, *scratch, *own)
        own = (result,)
        release(spark)
    return docs
