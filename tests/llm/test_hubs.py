"""Rows of one text, and chunks that many files hold, met in shares."""

from pyspark.sql import functions as F

from vigil.llm import components, media


def test_media_of_copies_in_shares(spark, monkeypatch):
    texts = [None, "", "x", "spam " * 300, "y" * 40_000, "spam " * 300 + "end"]
    rows = [(i, texts[i % len(texts)]) for i in range(60)] + [(None, "x")] * 9
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    plain = sorted(map(repr, media.op2(docs).collect()))
    monkeypatch.setattr(components, "HUB", 2)
    assert sorted(map(repr, media.op2(docs).collect())) == plain and len(plain) == 69


def test_salted_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("k"), "id")
    told = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    few = components.hubs(told, "k", 100)
    few = few.withColumn("_shares", F.lit(5).cast("bigint")) if few.count() else told.where("n > 100").select("k", F.lit(5).cast("bigint").alias("_shares"))
    got = components.salted(rows, told, "k", F.col("id"), few)
    assert got.count() == 1000 and {r.n for r in got.where("k = 7").collect()} == {900} and got.columns == ["k", "id", "n"]
