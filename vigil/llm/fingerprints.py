"""Document fingerprints by one-permutation MinHash, DataFrame functions only.

Every shingle is hashed once; its top bits name a bin and each bin keeps its
least hash. An empty bin takes the value of an occupied bin that a seeded order
of its own ranks first, which is what probing with a universal hash until an
occupied bin is met selects. Of each bin the low-order bits are stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import checkpointed

#: Bins, as a power of two; bits kept of a bin; words of a shingle.
BIN_BITS, KEPT_BITS, WORDS = 7, 8, 5
BINS = 1 << BIN_BITS
_SHIFT = 64 - BIN_BITS


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is not expanded again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, _SHIFT)


def _shingles(text: Column) -> Column:
    """array<bigint>: a hash of every WORDS words in a row; of fewer words, one of all; of none, empty."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def rolled(h: Column) -> Column:
        slid = F.transform(F.sequence(F.lit(1), F.size(h) - WORDS + 1), lambda i: F.xxhash64(F.slice(h, i, WORDS)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < WORDS, F.array(F.xxhash64(h))).otherwise(slid)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), rolled)


def _bins(hashes: Column) -> Column:
    """The BINS low-order values, or null of no hashes.

    One top value a bin is sorted in with the hashes, so that the first value of
    every run is the least of its bin and a bin of the top value alone is empty.
    """
    tops = [((j << _SHIFT) | ((1 << _SHIFT) - 1)) for j in range(BINS)]
    tops = F.array(*[F.lit(t - (1 << 64) if t >= 1 << 63 else t).cast("bigint") for t in tops])

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def empty(x: Column) -> Column:
        return F.shiftleft(x, BIN_BITS) == F.lit(-(1 << BIN_BITS)).cast("bigint")

    def densified(mins: Column) -> Column:
        return _let(
            F.filter(mins, lambda x: ~empty(x)),
            lambda full: F.transform(
                mins,
                lambda x: F.when(
                    empty(x),
                    F.array_min(F.transform(full, lambda m: F.struct(F.xxhash64(_bin(x), _bin(m)).alias("o"), m.alias("m"))))["m"],
                ).otherwise(x),
            ),
        )

    low = lambda full: F.transform(full, lambda x: x.bitwiseAND(F.lit((1 << KEPT_BITS) - 1).cast("bigint")).cast("smallint"))
    return _let(hashes, lambda h: F.when(F.size(h) > 0, low(_let(_let(F.sort_array(F.concat(h, tops)), least), densified))))


def sketch(text: Column) -> Column:
    """array<smallint> of BINS values; null for a text without words. A null text is empty."""
    return _bins(_shingles(F.coalesce(text, F.lit(""))))


def packed(sketch: Column) -> Column:
    """Lowercase hex; the empty string for a null sketch."""
    return F.coalesce(F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), KEPT_BITS // 4, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, corrected for bits that agree by chance. Two null sketches are alike, one is unlike any other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / float(BINS)
    chance = 2.0**-KEPT_BITS
    fair = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance)))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(fair)


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, next_key) of rows (key): the next lower key, the highest after the lowest.

    Keys are dealt by range and checkpointed; a window runs within each range, and
    one row a range carries the first key of the next.
    """
    dealt = checkpointed(ids.distinct().orderBy(F.desc("key")).withColumn("_part", F.spark_partition_id()))
    firsts = dealt.groupBy("_part").agg(F.max("key").alias("_first"))
    after = F.coalesce(F.lead("_first").over(Window.orderBy("_part")), F.max("_first").over(Window.partitionBy()))
    edges = firsts.select("_part", after.alias("_after"))
    within = Window.partitionBy("_part").orderBy(F.desc("key"))
    return dealt.join(F.broadcast(edges), "_part").select("key", F.coalesce(F.lead("key").over(within), F.col("_after")).alias("next_key"))


def edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, edited, next_sketch) of every row.

    The last floor(n/3) code points are replaced by the first as many of the next
    document. Null texts are empty; a null doc_id is the lowest of all. Of rows
    that share a doc_id, the next document is the one with the least start, then
    the least sketch. Both joins take texts dealt by doc_id, so Spark deals them once. An empty table gives no rows.
    """
    lowest = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(lowest).cast("bigint")).alias("key")
    body = F.coalesce("text", F.lit("")).alias("text")
    base = docs.select(key, body).select("key", "text", sketch(F.col("text")).alias("sketch"))
    cut = F.floor(F.length("text") / 3).cast("int")
    need = docs.select(key, body).groupBy("key").agg(F.max(cut).alias("need"))
    want = need.join(next_ids(docs.select(key)), "key").select(F.col("key").alias("for_key"), "next_key", "need")
    heads = (
        want.join(base, want["next_key"] == base["key"])
        .select("for_key", F.struct(F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"), F.col("sketch").alias("next_sketch")).alias("n"))
        .groupBy("for_key")
        .agg(F.min("n").alias("n"))
    )
    whole = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("n.head"), F.lit(1), cut))
    joined = base.join(heads, base["key"] == heads["for_key"], "left")
    doc_id = F.when(F.col("key") != lowest, F.col("key")).alias("doc_id")
    return joined.select(doc_id, "text", "sketch", F.coalesce(whole, F.lit("")).alias("edited"), F.col("n.next_sketch").alias("next_sketch"))


def op8(docs: DataFrame) -> DataFrame:
    rows = edited(docs).withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        packed(F.col("sketch")).alias("fingerprint"),
        packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
