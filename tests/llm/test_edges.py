"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import fingerprints, jaccard, langid, lines, maxent, media, mixing, pieces, pii, quality

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, Score string, spans string, ids string, Line_Hash string, host string, n_lines string"
LONG = "word " * 20_000 + "a" * 50_000


def rows():
    texts = [None, "", " \n\t ", "one", "two words", "same text here again and again", "same text here again and again", LONG, "1234567 +!?", "é中😀 mixed\ncase TEXT\n"]
    made = [(i, t, None if i == 3 else "en", None if i % 4 == 0 else "s1", None, 7, "x", "y", "z", "h", "h", "n") for i, t in enumerate(texts)]
    return [*made, made[5], (None, "null id", None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def clean(df):
    return {c.lower() for c in df.columns}


def test_line_dedup(docs):
    got = lines.line_dedup(docs)
    assert got.count() == 12 and {"n_lines", "_n_lines", "n_dropped"} <= clean(got)
    assert got.where("doc_id = 0").first().text is None


def test_mixing(docs):
    plan = mixing.mix_plan(docs)
    assert plan.count() == 12 and plan.where("copies > 3").count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_language(docs):
    got = {r.doc_id: r for r in langid.identify(docs, langid.sample(docs)).collect()}
    assert len(got) == 11 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 8)) and got[7].lang_pred == "en"
    nothing = langid.identify(docs.drop("score"), langid.sample(docs.where("lang = 'none'")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_pii(docs):
    got = pii.find(docs)
    assert got.count() == 12 and dict(got.dtypes)["spans"].startswith("array")


def test_jaccard(docs):
    got = {(r.id, r.component) for r in jaccard.join(docs.select("doc_id", "text")).collect()}
    assert (6, 5) in got and (0, 0) in got and (2, 2) in got
    kept = jaccard.near_dedup(docs.withColumns({"id": F.lit(1), "rows": F.lit(2), "_id": F.lit(3)})).drop("id", "rows", "_id")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_quality(docs, labels):
    got = quality.rate(docs, quality.fit(docs, labels))
    assert got.count() == 12 and got.where("score between 0 and 1").count() == 12
    none = quality.rate(docs, quality.fit(docs, labels.limit(0)))
    assert {r.score for r in none.select("score").collect()} == {0.5}


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.op8(docs).collect()}
    assert len(got) == 11 and got[0].fingerprint == got[1].fingerprint == "" and got[5].fingerprint == got[6].fingerprint and got[6].near_next == 1.0


def test_pieces(docs):
    got = {r.doc_id: r for r in pieces.tokenize(docs).collect()}
    assert len(got) == 11 and all(r.exact for r in got.values()) and got[0].ids == got[1].ids == []


def test_media(docs):
    got = {r.doc_id: r for r in media.op2(docs).collect()}
    assert len(got) == 11 and got[0].media_sha256 == got[1].media_sha256 and got[0].payload_bytes == 64


def test_maxent(docs):
    got = {r.doc_id: r for r in maxent.score(docs).collect()}
    assert len(got) == 11 and got[0].n_tokens == 1 and got[7].n_tokens == 20_002 and all(r.score < 0 for r in got.values())


@pytest.mark.parametrize("run", [lines.op1, media.op2, mixing.op3, langid.op4, pii.op5, jaccard.op6, fingerprints.op8, pieces.op9, maxent.op10], ids=range(1, 10))
def test_empty_table(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_empty_quality(docs, labels):
    assert quality.op7(docs.limit(0), labels).count() == 0


def test_one_document(spark):
    one = spark.createDataFrame([(5, "only one text here", "en", "s", 4)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert fingerprints.op8(one).first().near_next == 1.0
    assert mixing.op3(one).first().taken == 4 and maxent.op10(one).count() == 1


def test_pipeline_columns(spark, docs):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("extra"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == list(corpus_pipeline.COLUMNS), name
    assert isinstance(corpus_pipeline.STAGES[-1][1](spark, rows, "").schema["ids"].dataType, T.ArrayType)


def test_line_dedup_both_ways_with_null_and_shared_ids(spark):
    made = [(None, "s1", "menu\nbody 1"), (None, "s2", "menu\nbody 2"), (7, "s1", "menu\nbody 3"), (7, "s2", "menu\nbody 4"), (8, "s1", "menu"), (8, "s1", "other"), (None, None, "menu"), (9, None, None)]
    made += [(20 + i, "s2", f"plain {i}") for i in range(30)]
    df = spark.createDataFrame(made, "doc_id bigint, source string, text string")
    rows = lambda **x: sorted(map(repr, lines.line_dedup(df, **x).collect()))
    assert rows() == rows(broadcast_rows=-1) and lines.line_dedup(df, broadcast_rows=-1).where("text = 'menu\nbody 4'").count() == 1


def test_near_dedup_with_null_and_shared_ids(spark):
    words = lambda s, n=30: " ".join(f"{s}{i}" for i in range(n))
    made = [(None, words("a")), (None, words("b")), (None, words("b") + " more"), (5, words("c")), (5, words("d")), (3, words("d") + " x"), (5, words("e")), (5, words("e")), (None, ""), (None, ""), (None, None), (6, None)]
    got = jaccard.near_dedup(spark.createDataFrame(made, "doc_id bigint, text string"))
    want = [made[i] for i in (0, 1, 3, 5, 6, 8, 9, 10, 11)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_language_learns_all_languages(spark):
    made = [(100 * j + i, f"word{i} of lang{j}", f"l{j:02d}") for j in range(70) for i in range(80)]
    got = langid.sample(spark.createDataFrame(made, "doc_id bigint, text string, lang string"))
    assert len(got) == 70 and all(t.count("\n") == langid.TEXTS for _, t in got)


def test_pipeline_without_a_learned_language(spark):
    import corpus_pipeline

    made = [(1, "clean text", None, "s", 10), (2, "123 !", None, "s", 5), (3, None, None, "s", 0), (4, "é", None, None, 1)]
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()) == [1, 4]
