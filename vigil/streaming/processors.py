"""Structured Streaming sources, sinks and the operators with little state; stateful.py has the perimeter and the ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.session import checkpointed
from vigil.sources.telemetry import EVENT

#: A key without rows for so long is forgotten.
IDLE_MS = 24 * 3600 * 1000
#: What subscribers hear of.
TOPICS = ("telemetry", "alert", "device:status", "ip:dropped", "ip:blocked", "ip:unblocked", "ip:rate_limited", "ip:cleared", "attack_blocked", "attack_routed", "node_registered")


def cooldown(rows: DataFrame, key: str, t: str, us: int, order: tuple[str, ...] = ("seq",), idle_ms: int = IDLE_MS) -> DataFrame:
    """Rows of a stream kept greedily, each at least `us` after the last kept one of its key; keys without rows for idle_ms are forgotten."""
    schema, names = rows.schema, rows.columns

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        every = pd.concat(list(frames)).sort_values([t, *order])
        for r in every.to_dict("records"):
            if last is None or r[t] - last >= us:
                kept.append(r)
                last = r[t]
        if last is not None:
            state.update((int(last),))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(kept, columns=names)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(rows: DataFrame, t: str, slot: str, late: str) -> DataFrame:
    """Requests and failed logins of each slot, closed by the watermark."""
    timed = rows.withColumn("_at", F.timestamp_micros(t)).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", slot).alias("slot")).agg(F.count(F.lit(1)).alias("traffic"), F.count_if(F.col("event_type") == "auth_failure").alias("failures"))


def sliding(rows: DataFrame, t: str, width: str, step: str, late: str, *by: str) -> DataFrame:
    """(window, by, n): rows of each sliding window, closed by the watermark; rows behind it are left out."""
    timed = rows.withColumn("_at", F.timestamp_micros(t)).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width, step).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(rows: DataFrame, t: str, gap: str, late: str, *by: str) -> DataFrame:
    """(session, by, n, failures): rows of a key that follow each other within `gap`, closed by the watermark."""
    timed = rows.withColumn("_at", F.timestamp_micros(t)).withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap).alias("session"), *by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "auth_failure").alias("failures"))


def once(rows: DataFrame, t: str, late: str, key: str = "event_id") -> DataFrame:
    """Events without those whose id came before, within the watermark."""
    return rows.withColumn("_at", F.timestamp_micros(t)).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def ingested(spark: SparkSession, folder: str, schema: T.StructType = EVENT, files: int = 100) -> DataFrame:
    """A stream of events from JSON-lines files of a folder; a line that does not parse is kept in _corrupt_record."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.readStream.schema(full).option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", files).json(folder)


def sampled(spark: SparkSession, per_second: int = 2) -> DataFrame:
    """Host metrics of an agent that samples twice a second, made from the rate source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    wave = lambda k: F.pmod(F.xxhash64(F.lit(k), "value"), F.lit(1000)) / 10.0
    return ticks.select(F.concat(F.lit("agent-"), F.col("value").cast("string")).alias("event_id"), F.unix_micros("timestamp").alias("ts_us"), F.col("value").alias("seq"), wave("cpu").alias("cpu"), wave("memory").alias("memory"))


def subscribed(rows: DataFrame, *topics: str) -> DataFrame:
    """Rows of a stream (topic, ...) that a subscriber of some topics hears."""
    return rows.where(F.col("topic").isin(*topics))


def published(decisions: DataFrame) -> DataFrame:
    """(topic, source_ip, ts_us, body) of what perimeter decisions tell subscribers: dropped requests, blocks, their end, limits and attacks that were blocked."""
    audit, dropped = F.split("audit", ","), F.col("dropped")
    heard = {
        "ip:dropped": dropped != "", "ip:blocked": F.array_contains(audit, "block") | F.array_contains(audit, "extend_block"), "ip:unblocked": F.array_contains(audit, "unblock") | F.array_contains(audit, "auto_unblock"),
        "ip:rate_limited": F.col("decision") == "rate_limited", "attack_blocked": F.col("decision").isin("sql_injection", "xss", "path_injection", "brute_force", "flooding"), "ip:cleared": F.array_contains(audit, "clear_all"),
    }
    topics = F.filter(F.array(*[F.when(test, F.lit(topic)) for topic, test in heard.items()]), lambda x: x.isNotNull())
    return decisions.select(F.explode(topics).alias("topic"), "source_ip", "ts_us", F.to_json(F.struct("decision", "dropped", "audit", "score")).alias("body"))


def with_block_list(read: Callable[[], DataFrame], seconds: int = 5) -> Callable[[DataFrame, float], DataFrame]:
    """A function of a micro-batch and the time that adds is_blocked, from a block list (ip) that is read anew once it is `seconds` old.

    Each reading is a version of its own in the checkpoint folder, so the list
    outlives its source: if that cannot be read, the last version holds. Before
    the first reading nothing is blocked. add.version() tells (number, time read).
    """
    held: dict[str, Any] = {"at": None, "list": None, "version": 0}

    def add(batch: DataFrame, now_s: float) -> DataFrame:
        if held["at"] is None or now_s - held["at"] >= seconds:
            try:
                held.update(list=checkpointed(read().select("ip").where("ip is not null").distinct()), at=now_s, version=held["version"] + 1)
            except Exception:  # noqa: BLE001 - the list lives elsewhere; without it the last one holds
                if held["list"] is None:
                    return batch.withColumn("is_blocked", F.lit(False))
        marks = held["list"].select(F.col("ip").alias("_ip"), F.lit(True).alias("_mark"))
        return batch.join(marks, F.col("source_ip") == F.col("_ip"), "left").withColumn("is_blocked", F.coalesce("_mark", F.lit(False))).drop("_ip", "_mark")

    add.version = lambda: (held["version"], held["at"])  # type: ignore[attr-defined]
    return add


def blocked_requests(requests: DataFrame, intervals: DataFrame, longest_s: int, late: str = "0 seconds") -> DataFrame:
    """Requests (event_id, source_ip, ts_us) of a stream that a block (ip, start_us, end_us) of another stream covers.

    An interval join of two streams: both have watermarks, and no block is longer
    than longest_s, so Spark keeps a request until no block that covers it can come,
    and a block until its last request. Blocks of an address do not overlap, so a
    request comes once.
    """
    r = requests.select("event_id", "source_ip", "ts_us", F.timestamp_micros("ts_us").alias("_at")).withWatermark("_at", late)
    b = intervals.select("ip", "start_us", "end_us", F.timestamp_micros("start_us").alias("_from")).withWatermark("_from", late)
    near = (F.col("_from") <= F.col("_at")) & (F.col("_at") <= F.col("_from") + F.expr(f"interval {longest_s} seconds"))
    held = (F.col("source_ip") == F.col("ip")) & near & (F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") <= F.col("end_us"))
    return r.join(b, held).select("event_id", "source_ip", "ts_us")


class Feed:
    """A query that can be paused and goes on where it stopped, by its checkpoint."""

    def __init__(self, start: Callable[[], object]):
        self._start, self.query = start, start()

    def pause(self) -> None:
        self.query.stop()

    def resume(self) -> None:
        self.query = self._start()


def polled(rows: DataFrame, checkpoint: str, seen: Callable[[DataFrame, int], None], every: str = "5 seconds"):
    """Starts a query that looks at new rows once a period."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(seen).start()


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of a stream that grow with each batch; written in update mode."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def broadcast_topics(rows: DataFrame, checkpoint: str, publish: Callable[[str, DataFrame], None], topics: tuple[str, ...], every: str = "100 milliseconds"):
    """Starts a query that hands each micro-batch's rows of a topic to publish(topic, rows)."""

    def send(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for topic in topics:
            publish(topic, batch.where(F.col("topic") == topic))
        batch.unpersist()

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(send).start()


def append_store(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends to a Parquet store; rings over it are views."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def clear_store(rows: DataFrame, path: str) -> None:
    """An empty store with the schema of rows."""
    rows.limit(0).write.mode("overwrite").parquet(path)
