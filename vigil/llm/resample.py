"""Target-distribution importance resampling by hashed n-gram features.

A task numbers the words of a slice of texts, sorts the suffixes of the word ids
(a suffix ends with its text, and is told apart by at most `longest` words), and
walks neighbours that share n words as one run: a run is hashed once, and its
bucket goes to all its places. Counts of buckets over the corpus and the target
give each bucket a gain; a document's weight is the sum of its features' gains,
and the largest of weight plus Gumbel noise of a digest are drawn.

Defined results: null and empty texts have no features and weight 0; a null
doc_id counts as an empty one in the digest and as the lowest in ties; equal rows
are told apart by their place; an empty corpus or target counts as zeros. Extra
columns of any name stay out of the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import written

from .words import slices
from .workers import tidy

#: Lengths of features, buckets, the draw's seed and share, and the fewest words of a document that may be drawn.
SHORTEST, LONGEST, BUCKETS, SEED, PERCENT, WORDS = 1, 1, 10_000, 2024, 10, 20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def suffixes(ids: np.ndarray, text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): places of ids sorted by the words that follow within their text, `longest` at most, and how many a place shares with the one before it."""
    n = len(ids)
    columns = []
    for depth in range(longest):
        later = np.full(n, -1, np.int64)
        inside = np.flatnonzero(text[depth:] == text[: max(n - depth, 0)])
        later[inside] = ids[inside + depth]
        columns.append(later)
    order, shared, same = np.lexsort(columns[::-1]), np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for c in columns:
        same &= (c[order[1:]] == c[order[:-1]]) & (c[order[1:]] >= 0)
        shared[1:] += same
    return order, shared


class Features:
    """Buckets of all features of some texts: `bucket`, dealt to texts by `bounds`; `words` of each text."""

    def __init__(self, texts: list[bytes], shortest: int, longest: int, buckets: int):
        raw = b"\n".join(texts).translate(_LOWER)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        begins = np.zeros(len(texts), np.int64)
        np.cumsum(sizes[:-1] + 1, out=begins[1:])
        solid = np.zeros(len(raw) + 2, np.int8)
        solid[1:-1] = _WORD[np.frombuffer(raw, np.uint8)]
        step = np.diff(solid)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        text = np.searchsorted(begins, starts, "right") - 1
        self.words = np.bincount(text, minlength=len(texts))
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        names = list(known)
        order, shared = suffixes(ids, text, longest)
        room = np.searchsorted(text, text, "right") - np.arange(len(text))  # words of its text from a place on
        owner, bucket = [], []
        for n in range(shortest, longest + 1):
            held = room[order] >= n
            places = order[held]
            # A place of fewer words shares fewer with the next, so it never cuts a run of n.
            fresh = shared[held] < n
            first = places[fresh]
            hashed = np.fromiter((zlib.crc32(b" ".join(names[k] for k in ids[p : p + n].tolist())) % buckets for p in first.tolist()), np.int32, len(first))
            owner.append(text[places])
            bucket.append(hashed[np.cumsum(fresh) - 1])
        owner, bucket = np.concatenate(owner), np.concatenate(bucket)
        self.bucket = bucket[np.argsort(owner, kind="stable")].astype(np.int32)
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)


def features(docs: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets: array<int>) of docs (doc_id, text): the bucket of every feature, repeats kept."""
    if not 1 <= shortest <= longest:
        raise ValueError("features have at least one word")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b.column("text")):
                f = Features(texts, shortest, longest, buckets)
                lists = pa.ListArray.from_arrays(pa.array(f.bounds), pa.array(f.bucket))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(texts)), pa.array(f.words.astype(np.int64)), lists], ["doc_id", "n_words", "buckets"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(lambda b: tidy(made(b)), f"doc_id {kind}, n_words bigint, buckets array<int>")


def counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in rows (buckets). A task adds up its rows, so that what meets is one number a bucket and task; the result has `buckets` numbers at any size."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(added, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, both smoothed by one."""
    n = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of features rows."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("buckets")
            total = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy()])])
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(np.diff(at).astype(np.int64)), pa.array(total[at[1:]] - total[at[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(made, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from a digest of seed and doc_id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.left(key, F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("bigint")


def drawn(rows: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """rows (doc_id, n_words, n_features, weight, score) plus rank among the documents of enough words; null beyond the share that is drawn.

    Rows are dealt by ranges of the score, each range is numbered alone, and adds
    the sizes of the ranges before it.
    """
    fit = F.col("n_words") >= words
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("n_features"), F.col("_id")]
    able = rows.where(fit).withColumn("_id", F.monotonically_increasing_id())
    placed = written(able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop("_id"), "ranks")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # One row a partition.
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    most = placed.count() * percent // 100
    place = F.col("_before") + within + 1
    ranked = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.when(place <= most, place).cast("bigint"))
    rest = rows.where(~fit).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*rows.columns, "rank").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all docs (doc_id, text), drawn to be like target (text)."""
    rows = written(features(docs, shortest, longest, buckets), "features")
    aims = features(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), shortest, longest, buckets)
    scored = weighed(rows, gains(counts(rows, buckets), counts(aims, buckets))).withColumn("score", F.col("weight") + noise(seed))
    return drawn(scored, percent, words).select("doc_id", "n_features", "weight", "score", "rank")


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark)


#: For a second engine: crc32 bit by bit over a word's bytes in hexadecimal.
_BYTE = "('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::bigint"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode(w))), lambda i: {_BYTE})), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_TOKENS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""with dw as (select doc_id, unnest({_TOKENS}) as w from documents), bw as (select unnest({_TOKENS}) as w from benchmark),
 dn as (select doc_id, w, count(*) as n from dw group by all), bn as (select w, count(*) as n from bw group by w),
 known as (select w, {_CRC} % {BUCKETS} as b from (select w from dn union select w from bn)),
 s as (select b, sum(n)::bigint as s from dn join known using (w) group by b), t as (select b, sum(n)::bigint as t from bn join known using (w) group by b),
 totals as (select (select coalesce(sum(s), 0) from s)::bigint as ss, (select coalesce(sum(t), 0) from t)::bigint as tt),
 gain as (select b, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + {BUCKETS})::double / ((s + 1) * (tt + {BUCKETS})::double)))::bigint as g from s left join t using (b), totals),
 weights as (select doc_id, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from dn join known using (w) join gain using (b) group by doc_id),
 scored as (select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || coalesce(d.doc_id::varchar, '')), 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score from documents d left join weights w on d.doc_id = w.doc_id),
 placed as (select *, case when n_features >= {WORDS} then row_number() over (partition by n_features >= {WORDS} order by score desc, doc_id) end as place from scored)
 select doc_id, n_features, weight, score, case when place <= (select count(*) from scored where n_features >= {WORDS}) * {PERCENT} // 100 then place end as rank from placed"""
