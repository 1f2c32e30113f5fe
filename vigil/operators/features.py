"""Feature operators: scaling, sequences, cleaning, character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import numbered

#: Rows of a sequence that one task orders.
RUN = 1 << 16
#: Characters whose n-grams are counted together.
SLICE = 1 << 21
#: Keys of n-grams up to which a slice counts in a table; beyond it sorts.
TABLE = 1 << 22


def min_max(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """Columns scaled to 0..1 within `by`; a constant column gives 0."""
    ends = df.groupBy(by).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    span = lambda c: F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
    out = df.join(ends, by).withColumns({f"{c}_scaled": F.when(span(c) == 0, 0.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / span(c)) for c in columns})
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def inverse_min_max(scaled: F.Column, low: F.Column, high: F.Column) -> F.Column:
    return scaled * (high - low) + low


def sequences(df: DataFrame, by: str, order: str, value: str, length: int) -> DataFrame:
    """Full windows of the last `length` values, with the value that follows (null at the end).

    `order` is unique in `by`. Rows are numbered and dealt in runs; a run borrows the
    rows before it and the one after it, so a key of any size is many tasks.
    """
    rows = numbered(df.select(by, order, value), by, order)
    n = F.col("_n")
    lent = rows.withColumn("_run", F.explode(F.sequence(F.floor((n - 1) / RUN), F.floor((n + length - 1) / RUN))))
    w = Window.partitionBy(by, "_run").orderBy("_n")
    made = lent.withColumns({"steps": F.collect_list(value).over(w.rowsBetween(-(length - 1), 0)), "target": F.lead(value).over(w)})
    return made.where((F.col("_run") == F.floor(n / RUN)) & (F.size("steps") == length)).select(by, order, "steps", "target")


def vector_sequences(df: DataFrame, by: str, order: str, columns: tuple[str, ...], length: int) -> DataFrame:
    """sequences() of vectors: steps is an array of the last `length` rows' columns, target those of the row that follows."""
    return sequences(df.withColumn("_vector", F.array(*[F.col(c).cast("double") for c in columns])), by, order, "_vector", length)


def time_cut(df: DataFrame, order: str, share: float = 0.8) -> int:
    """The place in `order` up to which rows count as the past."""
    ends = df.agg(F.min(order), F.max(order)).first()
    return 0 if ends[0] is None else int(ends[0] + (ends[1] - ends[0]) * share)


def ranges(df: DataFrame, *columns: str) -> list[tuple[float, float]]:
    """The least and the largest value of each column; nothing gives 0 to 0."""
    found = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]).first()
    return [(found[2 * i] or 0.0, found[2 * i + 1] or 0.0) for i in range(len(columns))]


def scaled_vectors(steps: Column, spans: list[tuple[float, float]]) -> Column:
    """Vectors with each place scaled by its range; a range of one value gives 0. Later values may lie outside 0 to 1."""
    one = lambda v: F.array(*[((F.get(v, F.lit(i)) - lo) / (hi - lo)) if hi > lo else F.lit(0.0) for i, (lo, hi) in enumerate(spans)])
    return F.transform(steps, one)


def followed(df: DataFrame, by: str, order: str, value: Column, rows: int) -> DataFrame:
    """(by, order, followed): whether value holds for any of the next `rows` rows of the key; null for the last ones, which have fewer.

    Rows are numbered, and each lends its value to the places before it, so no key is one task.
    """
    placed = numbered(df.select(by, order, F.coalesce(value, F.lit(False)).alias("_v")), by, order)
    back = F.explode(F.sequence(F.col("_n") - rows, F.col("_n") - 1))
    lent = placed.select(F.col(by).alias("_by"), back.alias("_at"), "_v").groupBy("_by", "_at").agg(F.max("_v").alias("followed"), F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") == rows)
    return placed.join(lent, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_n") == F.col("_at")), "left").select(by, order, "followed")


def aligned(df: DataFrame, columns: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, then columns in this order as doubles: missing and null ones are 0, others go."""
    have = set(df.columns)
    return df.select(*keep, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c) for c in columns])


def encoded(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns as the rank of their value by code point, from 0; null stays. Distinct values are few against rows and are ranked without them."""
    for c in columns:
        values = numbered(df.select(c).where(F.col(c).isNotNull()).distinct().withColumn("_all", F.lit(0)), "_all", c).select(F.col(c).alias("_v"), F.col("_n").alias("_rank"))
        df = df.join(values, F.col(c) == F.col("_v"), "left").withColumn(c, F.col("_rank")).drop("_v", "_rank")
    return df


def cleaned(df: DataFrame, label: str, *numbers: str) -> DataFrame:
    """Rows with infinities as null dropped if any number is null; label 0 for normal traffic, else 1."""
    finite = {c: F.when(~F.isnan(c) & ~F.col(c).isin(float("inf"), float("-inf")), F.col(c)) for c in numbers}
    normal = F.lower(F.col(label)).isin("norm", "normal") | F.col(label).contains("Benign")
    return df.withColumns(finite).na.drop(subset=list(numbers)).withColumn("label", F.when(normal, 0).otherwise(1))


def grams_of(text: Column, low: int = 2, high: int = 4) -> Column:
    """All character n-grams of the lower-cased text, short ones first. The text is cut into characters once, so time is linear in it."""

    def of(chars: Column) -> Column:
        places = lambda n: F.sequence(F.lit(0), F.size(chars) - n)
        one = lambda n: F.transform(places(n), lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))
        return F.concat(*[F.when(F.size(chars) >= n, one(n)).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)])

    return F.flatten(F.transform(F.array(F.split(F.lower(F.coalesce(text, F.lit(""))), "")), of))


def char_ngrams(df: DataFrame, key: str, text: str, low: int = 2, high: int = 4) -> DataFrame:
    """(key, gram, n): counts of character n-grams of the lower-cased text."""
    return df.select(key, F.explode(grams_of(F.col(text), low, high)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))


def _once(key: np.ndarray, ends: np.ndarray, n: int, owner: np.ndarray) -> np.ndarray:
    """One place for each gram of each row: the last one, which its row's own places leave in owner. ends: where rows end."""
    last = np.zeros(len(key), bool)
    place, begin = np.arange(len(key), dtype=np.int32), 0
    for end in ends.tolist():
        k, p = key[begin : end - n + 1], place[begin : end - n + 1]
        if len(k):
            owner[k] = p
            np.equal(owner[k], p, out=last[begin : end - n + 1])
        begin = end
    return last


def _counted(points: np.ndarray, row: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """(gram, n, docs) of texts as code points and the row of each; a gram lies within a row.

    A gram's key is the rank of its head among the grams one shorter, and the rank
    of its last point, so keys fit 64 bits at any length. Few keys are counted in a
    table, many are sorted.
    """
    if not len(points):
        return
    present = np.flatnonzero(np.bincount(points))
    letter = np.zeros(present[-1] + 1, np.int64)
    letter[present] = np.arange(len(present))
    tail, rank, heads = letter[points], letter[points], len(present)
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
    for n in range(2, high + 1):
        m = len(points) - n + 1
        if m <= 0:
            return
        inside = row[:m] == row[n - 1 :]
        key = rank[:m] * len(present) + tail[n - 1 :]
        most = heads * len(present)
        if most <= TABLE:
            key[~inside] = most
            count = np.bincount(key, minlength=most + 1)[:most]
            found = np.flatnonzero(count)
            if not len(found):
                return
            owner = np.empty(most + 1, np.int32)
            last = _once(key, ends, n, owner)
            count, docs = count[found], np.bincount(key[last], minlength=most + 1)[found]
            owner[key] = np.arange(m, dtype=np.int32)
            at = owner[found]
            owner[found] = np.arange(len(found), dtype=np.int32)
            rank = owner[key].astype(np.int64)
        else:
            places = np.flatnonzero(inside)
            if not len(places):
                return
            order = places[np.argsort(key[places], kind="stable")]
            k, d = key[order], row[order]
            fresh = np.append(True, k[1:] != k[:-1])
            starts = np.flatnonzero(fresh)
            rank = np.zeros(m, np.int64)
            rank[order] = np.cumsum(fresh) - 1
            docs = np.add.reduceat((fresh | np.append(True, d[1:] != d[:-1])).astype(np.int64), starts)
            at, count = order[starts], np.diff(np.append(starts, len(k)))
        heads = len(at)
        # A place whose gram leaves its row may have any rank: grams that start there leave it too.
        rank[~inside] = 0
        if n < low:
            continue
        grams = points[at[:, None] + np.arange(n)]
        size = 1 + (grams >= 0x80).astype(np.int32) + (grams >= 0x800) + (grams >= 0x10000)
        to = np.append(np.int32(0), np.cumsum(size.sum(axis=1), dtype=np.int32))
        text = grams.astype("<u4").tobytes().decode("utf-32-le").encode()
        names = pa.StringArray.from_buffers(len(at), pa.py_buffer(to.tobytes()), pa.py_buffer(text))
        yield pa.RecordBatch.from_arrays([names, pa.array(count), pa.array(docs)], ["gram", "n", "docs"])


def gram_totals(df: DataFrame, text: str, low: int = 2, high: int = 4) -> DataFrame:
    """(gram, n, docs): how often a gram of at least two characters occurs and in how many rows.

    Tasks count slices of about SLICE characters by packed keys, so only a slice's
    distinct grams become rows, and those are combined before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for t in b.column(0).to_pylist():
                held.append(np.frombuffer((t or "").encode("utf-32-le"), "<u4").astype(np.int64))
                size += len(held[-1])
                if size >= SLICE:
                    yield from _counted(np.concatenate(held), np.repeat(np.arange(len(held)), [*map(len, held)]), low, high)
                    held, size = [], 0
            if size:
                yield from _counted(np.concatenate(held), np.repeat(np.arange(len(held)), [*map(len, held)]), low, high)

    grams = df.select(F.lower(F.col(text)).alias("text")).mapInArrow(run, "gram string, n bigint, docs bigint")
    return grams.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
