"""Mixing sources to target weights, DataFrame functions only.

Words are counted per source, capped weights are filled with water until they
share the whole, and each document is emitted floor(rate) times plus one copy
drawn by a seeded hash with the fraction as its probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.windows import numbered
from vigil.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Hash draws take 60 bits of an MD5 digest.
DRAW_BITS = 60


def words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds rank, 0 first, of each distinct source by code point, null last.

    The sources are dealt by range and sorted within their partitions; only one
    row a partition meets in the window that adds up the partitions before it.
    """
    ordered = sources.orderBy(F.col("source").isNull(), F.col("source").asc_nulls_last())
    dealt = checkpointed(ordered.withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(F.col("source").isNull(), F.col("source").asc_nulls_last())
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_part").select(*sources.columns, (F.row_number().over(within) - 1 + F.col("_start")).cast("long").alias("rank"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) for rows (source, source_size).

    Weights repeat over the ranked sources. A source of no words has target 0.
    Each round fixes at their cap the sources whose share passes it and deals the
    rest anew; a round is one aggregate, of which the driver sees three sums.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    rows = checkpointed(ranked(sources).select("source", "source_size", weight.alias("weight")))
    level, rest, free = None, 0, 1
    while True:
        size = F.col("source_size").cast("decimal(20,0)")
        full = F.lit(False) if level is None else (size * F.lit(most * free) <= F.col("weight").cast("decimal(10,0)") * F.lit(rest))
        got = rows.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        rest, free = int(got["all"] or 0) - int(got["capped"]), int(got["free"])
        if free == 0 or (rest, free) == level:
            break
        level = (rest, free)
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(max(free, 1)))
    cap = (F.col("source_size") * most).cast("double")
    return rows.withColumn("target", F.when(F.lit(free == 0), cap).otherwise(F.least(share, cap)))


def draw(doc_id: Column, text: Column, place: Column, seed: str) -> Column:
    """Uniform in [0, 1) from an MD5 digest of seed, doc_id, the text's digest and the row's place among its equals."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit("")), place.cast("string")]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long") / F.lit(float(2**DRAW_BITS))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", broadcast_rows: int = 100_000) -> DataFrame:
    """All rows and columns of docs plus size, source_size, target and copies, in place of columns so named.

    A null text has no words; it and an empty text have size 0 and are drawn like
    any other row. Every row has a draw of its own, rows that share a doc_id too;
    rows equal in doc_id and text are numbered for it. An empty table gives no rows. Targets go to every task if the sources number at most
    broadcast_rows; beyond that they meet the rows in a shuffled join.
    """
    extra = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c.lower() not in extra]
    return _planned(_packed(docs), weights, most, seed, broadcast_rows).select(*[F.col(f"doc.`{c}`") for c in keep], *extra)


def _packed(docs: DataFrame) -> DataFrame:
    """Each row as one column, so that no name meets another, and what the plan needs beside it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source", words(F.col("text")).alias("size"))
    return rows.withColumn("_key", F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("bigint")), F.coalesce("doc.text", F.lit(""))))


def placed(rows: DataFrame) -> DataFrame:
    """rows plus _place: of rows that share a _key their number, from 0; of others 0.

    Keys are counted by a combining aggregate. Only rows of keys that repeat are
    dealt again, in runs by key and row, so many equal rows are many tasks.
    """
    repeated = checkpointed(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key"))
    zero = F.lit(0).cast("bigint")
    n = repeated.count()
    if not n:
        return rows.withColumn("_place", zero)
    repeated = F.broadcast(repeated) if n <= 100_000 else repeated
    again = rows.join(repeated, "_key", "left_semi").withColumn("_row", F.monotonically_increasing_id())
    again = numbered(checkpointed(again), "_key", "_row").withColumnRenamed("_n", "_place").drop("_row")
    return rows.join(repeated, "_key", "left_anti").withColumn("_place", zero).unionByName(again)


def _planned(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", broadcast_rows: int = 100_000) -> DataFrame:
    sized = placed(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = checkpointed(targets(totals, weights, most).select(F.col("source").alias("_source"), "source_size", "target"))
    small = plan.count() <= broadcast_rows
    joined = sized.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col("doc_id"), F.col("doc.text"), F.col("_place"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: the columns of docs, each row as often as its plan says."""
    plan = _planned(_packed(docs), **options).where(F.col("copies") > 0)
    return plan.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op3(docs: DataFrame) -> DataFrame:
    plan = mix_plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
with recursive d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    coalesce(md5(text), '') || ':' || (row_number() over (partition by doc_id, coalesce(text, '')) - 1) as digest from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         cast((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1 as bigint) as weight
  from d group by source),
r as (
  select 0 as k, cast(sum(source_size) as bigint) as rest, cast(sum(weight) as bigint) as free from s
  union all
  select k + 1, rest2, free2 from (
    select r.k, r.rest, r.free,
      cast((select sum(source_size) from s) - (select coalesce(sum(3 * source_size), 0) from s where 3 * source_size * r.free <= weight * r.rest) as bigint) as rest2,
      cast((select coalesce(sum(weight), 0) from s where 3 * source_size * r.free > weight * r.rest) as bigint) as free2
    from r where r.free > 0)
  where (rest2, free2) <> (rest, free)),
e as (select rest, free from r order by k desc limit 1),
t as (
  select source, source_size,
    case when e.free = 0 then cast(3 * source_size as double)
         else least(cast(weight * e.rest as double) / cast(e.free as double), cast(3 * source_size as double)) end as target
  from s, e),
p as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
    cast(('0x' || substr(md5('mix:' || coalesce(cast(d.doc_id as varchar), '') || ':' || d.digest), 1, 15)) as bigint) / 1152921504606846976.0::double as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast((floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) * size as bigint) as taken
from p
"""
