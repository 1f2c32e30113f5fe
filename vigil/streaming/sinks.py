"""Sinks that a repeated micro-batch leaves as they were, and the streams of all topics.

A micro-batch that Spark runs again after a crash has the number it had. Each
writes partitions of that number and replaces them if they are there, so what a
batch wrote in part or twice counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import alerts, joins, ledger, rules

from .processors import published


def _replace(batch: DataFrame, path: str, number: int, by: tuple[str, ...]) -> None:
    numbered = batch.withColumn("batch", F.lit(number).cast("bigint"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(path)


def stored(batch: DataFrame, number: int, path: str, t: str = "ts_us") -> None:
    """Writes a micro-batch to the event store, by day and batch. Rows without a time go to the day null."""
    _replace(batch.withColumn("day", F.date_format(F.timestamp_micros(t), "yyyy-MM-dd")), path, number, ("day",))


def store(rows: DataFrame, path: str, checkpoint: str, t: str = "ts_us", every: str = "5 seconds"):
    """Starts a query that appends to a Parquet store, partitioned by day; days prune scans, rings over it are views."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(lambda b, n: stored(b, n, path, t)).start()


def counted(batch: DataFrame, number: int, path: str, *by: str) -> None:
    """Writes a micro-batch's counts."""
    _replace(batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), path, number, ())


def totals(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """Counts of all micro-batches."""
    return spark.read.parquet(path).groupBy(*by).agg(F.sum("n").alias("n"))


def settled(spark: SparkSession, path: str, into: str, upto: int, *by: str) -> None:
    """Folds the counts of micro-batches up to a number into one row a key, in a store of their own; to be read with the later ones."""
    totals_of = spark.read.parquet(path).where(F.col("batch") <= upto).groupBy(*by).agg(F.sum("n").alias("n"))
    _replace(totals_of, into, upto, ())


def topics(events: DataFrame, decisions: DataFrame, audits: DataFrame, changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(topic, key, ts_us, body) of streams, for all topics.

    events: telemetry rows; decisions: of the perimeter; audits: of the ledger;
    changes: of node status; nodes (node_id, sector, status): the nodes that
    attacks are routed to, a table.
    """
    body = lambda *c: F.to_json(F.struct(*c)).alias("body")
    named = lambda topic, key: [F.lit(topic).alias("topic"), F.col(key).alias("key"), F.col("ts_us")]
    told = alerts.alerts(rules.single(events))
    routed = joins.route_attacks(events.where(rules.login_failed()).select("event_id", "domain", "ts_us"), nodes).withColumn("ts_us", F.lit(None).cast("bigint"))
    parts = [
        events.select(*named("telemetry", "event_id"), body("service", "event_type")),
        told.select(*named("alert", "alert_id"), body("rule_id", "title", "severity", "source")),
        changes.select(*named("device:status", "node_id"), body("status", "sector")),
        changes.where("registered").select(*named("node_registered", "node_id"), body("sector")),
        routed.select(*named("attack_routed", "event_id"), body("node_id")),
        published(decisions).select("topic", F.col("source_ip").alias("key"), "ts_us", "body"),
        ledger.heard(audits).select("topic", F.col("ip").alias("key"), "ts_us", "body"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def publish(batch: DataFrame, number: int, send: Callable[[str, int, DataFrame], None], known: tuple[str, ...]) -> None:
    """Hands a micro-batch's rows of each topic to send(topic, number, rows), once for a topic with rows: a receiver that keeps the number can tell a repetition."""
    batch.persist()
    try:
        for r in batch.select("topic").distinct().collect():
            if r.topic in known:
                send(r.topic, number, batch.where(F.col("topic") == r.topic))
    finally:
        batch.unpersist()
