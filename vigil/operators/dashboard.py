"""Dashboard questions: timelines, summaries, rings, running scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.compat import half_up

from .actions import DROPPED, lookup, newest
from .windows import running

# What a severity adds to an address's score.
SCORES = {"low": 10, "medium": 25, "high": 50, "critical": 100}


def timeline(alerts: DataFrame, n: int = 50) -> DataFrame:
    """The newest n of both feeds, newest first: alerts, and the requests dropped for them. Each alert gives its entries in one pass."""
    entry = lambda *c: F.struct(*[x.alias(name) for x, name in zip(c, ("id", "kind", "message", "source", "ts_us"), strict=True)])
    a = entry(F.concat(F.lit("alert-"), "alert_id"), F.when(F.col("severity") == "critical", "error").otherwise("alert"), F.col("title"), F.col("source"), F.col("ts_us"))
    label = F.replace(F.try_element_at(lookup(DROPPED), F.col("rule_id")), F.lit("_"), F.lit(" "))
    said = F.concat(F.lit("Blocked "), label, F.lit(" from "), F.coalesce("source_ip", F.lit("unknown IP")))
    d = F.when(label.isNotNull(), entry(F.concat(F.lit("dropped-"), "alert_id"), F.lit("network"), said, F.lit("Response Engine"), F.col("ts_us")))
    return alerts.select(F.inline(F.filter(F.array(a, d), lambda x: x.isNotNull()))).orderBy(F.desc("ts_us"), "id").limit(n)


def sector_summary(verdicts: DataFrame) -> DataFrame:
    """Packets, threats and whether the last verdict was critical, by sector."""
    bad = F.col("status").isin("blocked", "quarantined", "isolated")
    last = F.max_by("threat_level", F.struct("ts_us", "seq"))
    return verdicts.groupBy("sector").agg(F.count(F.lit(1)).alias("packets"), F.count_if(bad).alias("threats"), (last == "critical").alias("last_critical"))


def threat_rate(verdicts: DataFrame) -> DataFrame:
    total, blocked = F.count(F.lit(1)), F.count_if(F.col("status") == "blocked")
    return verdicts.agg(total.alias("total"), F.count_if(F.col("status") == "allowed").alias("allowed"), blocked.alias("blocked"), F.when(total > 0, half_up(blocked * 100.0 / total, 1)).otherwise(0.0).alias("percent"))


def traffic(verdicts: DataFrame, slot_us: int = 1_000_000, last: int = 20) -> DataFrame:
    """Traffic and threats of the last slots that have any."""
    slot = (F.floor(F.col("ts_us") / slot_us) * slot_us).cast("bigint")
    return verdicts.groupBy(slot.alias("slot_us")).agg(F.count(F.lit(1)).alias("traffic"), F.count_if(F.col("status") == "blocked").alias("threats")).orderBy(F.desc("slot_us")).limit(last)


def threat_scores(actions: DataFrame, *tie: str) -> DataFrame:
    """Rows (ip, severity, ts_us, seq) plus the address's running score and what it triggers; feedback of blocks is the state machine's."""
    add = F.coalesce(*[F.when(F.col("severity") == s, F.lit(v)) for s, v in SCORES.items()], F.lit(10))
    scored = running(actions, "ip", ("ts_us", "seq", *tie), score=("sum", add, True))
    act = F.when(F.col("score") >= 100, "block_critical").when(F.col("score") >= 75, "block_high").when(F.col("score") >= 50, "throttle").otherwise("monitor")
    return scored.withColumn("action", act)


def high_threat(actions: DataFrame, least: int = 50) -> DataFrame:
    add = F.coalesce(*[F.when(F.col("severity") == s, F.lit(v)) for s, v in SCORES.items()], F.lit(10))
    return actions.groupBy("ip").agg(F.sum(add).alias("score")).where(F.col("score") >= least)


def ip_stats(blocks: DataFrame, limits: DataFrame, audit: DataFrame, scores: DataFrame, least: int = 50) -> DataFrame:
    """(name, n, ip) over blocks (ip), limits (ip, throttled), audit rows and scores (ip, score): blocked, throttled and audit counts, and each address of a high score with it."""
    one = lambda df, f, name: df.agg(f.alias("n")).select(F.lit(name).alias("name"), F.col("n").cast("bigint").alias("n"), F.lit(None).cast("string").alias("ip"))
    parts = [one(blocks, F.count_distinct("ip"), "blocked_count"), one(limits, F.count_if("throttled"), "throttled_count"), one(audit, F.count(F.lit(1)), "audit_log_size")]
    high = scores.where(F.col("score") >= least).select(F.lit("high_threat_ips").alias("name"), F.col("score").cast("bigint").alias("n"), "ip")
    return reduce(DataFrame.unionByName, [*parts, high])


def health_counts(**frames: DataFrame) -> DataFrame:
    """(name, n): rows of each frame."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()])


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, share) of a training set."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def epoch_loss(losses: DataFrame) -> DataFrame:
    """(epoch, mean_loss) of rows (epoch, loss)."""
    return losses.groupBy("epoch").agg(F.avg("loss").alias("mean_loss"))


def scaled(points: DataFrame) -> DataFrame:
    """Points of a device with network as a share of the device's largest, at least 100."""
    top = points.groupBy("device").agg(F.greatest(F.max("network"), F.lit(100.0)).alias("top"))
    return points.join(top, "device").select("device", "seq", (F.col("network") / F.col("top")).alias("share"))


def axis(points: DataFrame, ticks: int = 6, least_us: int = 30_000_000) -> DataFrame:
    """(device, tick, at_us): evenly spaced ticks over each device's span of at least 30 s."""
    ends = points.groupBy("device").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).withColumn("b", F.greatest("b", F.col("a") + least_us))
    return ends.select("device", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))).alias("tick"), "a", "b").select("device", "tick", (F.col("a") + F.floor((F.col("b") - F.col("a")) * F.col("tick") / (ticks - 1))).cast("bigint").alias("at_us"))


def latest(points: DataFrame) -> DataFrame:
    return newest(points, 1, "device")


def first_seen(points: DataFrame) -> DataFrame:
    """(device, seq): each device once, by its first point."""
    return points.groupBy("device").agg(F.min("seq").alias("seq"))


def requests_per_second(tel: DataFrame) -> DataFrame:
    """requests over the seconds since the service's last sample; none for the first. Services are few, so their samples are scanned in runs."""
    rows = running(tel.where("requests is not null").select("event_id", "service", "requests", "ts_us", "seq"), "service", ("ts_us", "seq"), _last=("max", F.col("ts_us"), False))
    gap = (F.col("ts_us") - F.col("_last")) / 1e6
    return rows.where(gap > 0).select("event_id", "service", (F.col("requests") / gap).alias("rps"))
