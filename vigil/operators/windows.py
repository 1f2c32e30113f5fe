"""Trailing time windows, half-open on the left: an entry counts while t > now - width."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from vigil.session import checkpointed

#: A key's time line is cut into spans of so many window widths.
WIDTHS = 64


def _runs(df: DataFrame, by: str, *order: str) -> DataFrame:
    """df with _part: rows of a key lie in runs along a unique order, each run in one partition; a key of any size is many runs."""
    return checkpointed(df.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, by: str, order: tuple[str, ...], **made: tuple[str, Column, bool]) -> DataFrame:
    """df plus running values of each key along a unique order: name=(max or sum, value, whether the row itself counts).

    A key is not one task: each of its runs is scanned alone and takes what the runs before it give, one row a run.
    """
    how = {"max": F.max, "sum": F.sum}
    dealt = _runs(df.withColumns({f"_{n}": v for n, (_, v, _) in made.items()}), by, *order)
    runs = dealt.groupBy(by, "_part").agg(*[how[f](f"_{n}").alias(f"_all_{n}") for n, (f, _, _) in made.items()])
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), *[how[f](f"_all_{n}").over(before).alias(f"_from_{n}") for n, (f, _, _) in made.items()])
    # Only the first key of a partition goes on from the one before it, so this is one row a partition at most.
    carried = F.broadcast(carried.where(reduce(Column.__or__, [F.col(f"_from_{n}").isNotNull() for n in made])))
    own = Window.partitionBy(by, "_part").orderBy(*order).rowsBetween
    rows = dealt.withColumns({f"_own_{n}": how[f](f"_{n}").over(own(Window.unboundedPreceding, 0 if itself else -1)) for n, (f, _, itself) in made.items()})
    rows = rows.join(carried, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")), "left")
    both = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    return rows.select(*df.columns, *[both[f](F.col(f"_own_{n}"), F.col(f"_from_{n}")).alias(n) for n, (f, _, _) in made.items()])


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    """df plus _n: the place of a row among its key's, from 0, along a unique order."""
    return running(df, by, order, _n=("sum", F.lit(1).cast("bigint"), False))


def trailing(df: DataFrame, key: str, t: str, seconds: int, made: dict[str, Callable[[WindowSpec], Column]], untimed: bool = False) -> DataFrame:
    """df plus columns over the rows of the same key in (t - seconds, t], t in microseconds.

    A key is not one task: its rows are dealt by spans of time, and rows close to
    the end of a span are lent to the next one. Rows without a time go, or stay
    among themselves if `untimed`.
    """
    width = seconds * 1_000_000
    span = width * WIDTHS
    own, reach = F.floor(F.col(t) / span), F.floor((F.col(t) + (width - 1)) / span)
    lent = df.withColumn("_own", own).withColumn("_span", (F.explode_outer if untimed else F.explode)(F.sequence(F.col("_own"), reach)))
    w = Window.partitionBy(key, "_span").orderBy(t).rangeBetween(-(width - 1), 0)
    out = lent.withColumns({n: f(w) for n, f in made.items()})
    return out.where("_own <=> _span").drop("_own", "_span")


def rate(n: Column, first: Column, now: Column) -> Column:
    """Requests a second over the window; of fewer than two requests, their number."""
    return F.when(n < 2, n.cast("double")).otherwise(n / F.greatest((now - first) / 1e6, F.lit(0.1)))


def request_windows(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """requests (source_ip, ts_us) plus n and rate over the window."""
    out = trailing(requests, "source_ip", "ts_us", seconds, {"n": lambda w: F.count(F.lit(1)).over(w), "_first": lambda w: F.min("ts_us").over(w)})
    return out.withColumn("rate", rate(F.col("n"), F.col("_first"), F.col("ts_us"))).drop("_first")


def over_limit(requests: DataFrame, limits: dict[str, int], seconds: int = 60) -> DataFrame:
    """requests (event_id, source_ip, category, ts_us, seq) beyond their address's limit, with n and limit: the first category seen fixes the limit."""
    first = requests.groupBy("source_ip").agg(F.min_by("category", F.struct("ts_us", "seq")).alias("_c"))
    limit = F.coalesce(*[F.when(F.col("_c") == c, F.lit(n)) for c, n in limits.items()])
    rows = requests.join(first, "source_ip").withColumn("limit", limit).drop("_c")
    return trailing(rows, "source_ip", "ts_us", seconds, {"n": lambda w: F.count(F.lit(1)).over(w)}).where(F.col("n") > F.col("limit"))


def since_success(rows: DataFrame, seconds: int = 60) -> DataFrame:
    """Failed rows (source_ip, success, ts_us, seq) plus n: failures in the window since the address's last success."""
    last = running(rows, "source_ip", ("ts_us", "seq"), _ok=("sum", F.col("success").cast("bigint"), True))
    failed = last.where(~F.col("success")).withColumn("_key", F.concat_ws("|", "source_ip", "_ok"))
    return trailing(failed, "_key", "ts_us", seconds, {"n": lambda w: F.count(F.lit(1)).over(w)}).drop("_key", "_ok")


def flood(requests: DataFrame, seconds: int = 10, over: int = 50, critical: int = 100) -> DataFrame:
    """request_windows plus is_flood, confidence and severity, without the spike test."""
    n = F.col("n")
    return request_windows(requests, seconds).withColumns({
        "is_flood": n >= over,
        "confidence": F.when(n >= over, F.least(F.lit(95), 70 + (n - over) * 2)).otherwise(0).cast("bigint"),
        "severity": F.when(n >= critical, "critical").when(n >= over, "high").otherwise("low"),
    })


def brute(attempts: DataFrame, seconds: int = 60, most: int = 5, rapid_us: int = 1_000_000) -> DataFrame:
    """Failed attempts (source_ip, username, ts_us, seq) plus count, distinct users so far, gap and the verdict.

    Users never leave the count, attempts do; a first attempt has no gap.
    """
    place = F.struct("ts_us", "seq")
    firsts = attempts.groupBy("source_ip", "username").agg(F.min(place).alias("_first"))
    marked = attempts.join(firsts, ["source_ip", "username"]).withColumn("_new", (place == F.col("_first")).cast("bigint")).drop("_first")
    rows = running(marked, "source_ip", ("ts_us", "seq"), _last=("max", F.col("ts_us"), False), users=("sum", F.col("_new"), True))
    rows = rows.withColumn("gap_us", F.col("ts_us") - F.col("_last"))
    rows = trailing(rows, "source_ip", "ts_us", seconds, {"n": lambda w: F.count(F.lit(1)).over(w)}).drop("_new", "_last")
    n, users = F.col("n"), F.col("users")
    rapid = F.coalesce(F.col("gap_us") < rapid_us, F.lit(False)) & (n >= 3)
    base = F.when(n >= most, F.least(F.lit(95), 60 + (n - most) * 5)).otherwise(0)
    return rows.withColumns({
        "is_brute": (n >= most) | rapid | (users >= 5),
        "confidence": F.greatest(base, F.when(rapid, 85).otherwise(0), F.when(users >= 5, 80).otherwise(0)).cast("bigint"),
        "severity": F.when(rapid | (users >= 5) | (n >= 10), "high").when(n >= most, "medium").otherwise("low"),
    })
