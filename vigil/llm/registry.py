"""Queries and SQL of this package, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.session import table

from . import fingerprints, jaccard, langid, lines, maxent, media, mixing, pieces, pii, quality, resample, turns, urls


def _over(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": _over(lines.op1),
        "op2_media_chunks": _over(media.op2),
        "op3_source_mixing": _over(mixing.op3),
        "op4_language": _over(langid.op4),
        "op6_jaccard_join": _over(jaccard.op6),
        "op9_sentencepiece": _over(pieces.op9),
        "op10_maxent_scores": _over(maxent.op10),
        "op7_quality": lambda spark, sf_dir: quality.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op8_fingerprints": _over(fingerprints.op8),
        "op5_personal_data": _over(pii.op5),
        "op11_conversation_repair": lambda spark, sf_dir: turns.op11(table(spark, sf_dir, "conversations")),
        "op12_url_filter": lambda spark, sf_dir: urls.op12(table(spark, sf_dir, "pages")),
        "op13_importance_resampling": lambda spark, sf_dir: resample.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": lines.OP1_SQL, "op3_source_mixing": mixing.OP3_SQL, "op5_personal_data": pii.OP5_SQL, "op11_conversation_repair": turns.OP11_SQL, "op13_importance_resampling": resample.OP13_SQL}
