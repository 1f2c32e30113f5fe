"""Queries of scans, windows and sinks: events written and read again, windows that slide or follow gaps, counts by batch."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import shared_dir
from vigil.sources import telemetry
from vigil.streaming import processors, sinks

from .catalog import HOUR_US, col, lit
from .console import pair
from .sql import TEL


def _folder(df: DataFrame, name: str) -> str:
    return os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")


def envelopes(tel: DataFrame, *more: str) -> DataFrame:
    """Telemetry rows as stored events, and more columns: payload holds the metrics and texts that are there."""
    payload = F.struct("cpu", "query", "username", "requests")
    return tel.select("event_id", "source_ip", "domain", "service", "event_type", payload.alias("payload"), F.floor(col("ts_us") / 1_000_000).cast("bigint").alias("timestamp"), *more)


def scanned(events: DataFrame) -> DataFrame:
    """What is told of events that were read from files: the envelope, and cpu only where it is a JSON number."""
    return events.select("event_id", "source_ip", "event_type", "timestamp", telemetry.typed_metric("payload", "cpu").alias("cpu"), F.try_variant_get("payload", "$.query", "string").alias("query"))


_SCANNED = f"with {TEL} select event_id, source_ip, event_type, ts_us // 1000000 as timestamp, cpu, query from tel"


@pair("scan_json_lines", _SCANNED)
def _(tel: DataFrame) -> DataFrame:
    path = _folder(tel, "json-lines")
    envelopes(tel).write.json(path)
    return scanned(telemetry.json_lines(tel.sparkSession, path).where("_corrupt_record is null"))


#: Events of a file that holds one array.
PER_ARRAY = 2_000


@pair("scan_json_arrays", _SCANNED)
def _(tel: DataFrame) -> DataFrame:
    path = _folder(tel, "json-arrays")
    rows = envelopes(tel, "seq").withColumn("part", F.floor(col("seq") / PER_ARRAY))
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("event_id", "source_ip", "domain", "service", "event_type", "payload", "timestamp"))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return scanned(telemetry.json_array(tel.sparkSession, f"{path}/*"))


@pair("scan_csv", f"with {TEL} select event_id, domain, memory, network, requests from tel where network is not null")
def _(tel: DataFrame) -> DataFrame:
    path = _folder(tel, "csv")
    rows = tel.where("network is not null").select("event_id", "domain", "memory", "network", "requests")
    rows.write.option("header", True).csv(path)
    kinds = {"event_id": T.StringType(), "domain": T.StringType(), "memory": T.DoubleType(), "network": T.DoubleType(), "requests": T.LongType()}
    return telemetry.csv_table(tel.sparkSession, path, T.StructType([T.StructField(c, k) for c, k in kinds.items()]))


# Windows, as the streams have them, over a table.
pair(
    "sliding_windows",
    f"""with {TEL}, w as (select source_ip, unnest([ts_us // {HOUR_US} * {HOUR_US}, ts_us // {HOUR_US} * {HOUR_US} - {HOUR_US}]) as start_us from tel)
 select start_us, source_ip, count(*) as n from w group by all""",
)(lambda tel: processors.sliding(tel, "ts_us", "2 hours", "1 hour", "0 seconds", "source_ip").select(F.unix_micros("window.start").alias("start_us"), "source_ip", "n"))

pair(
    "session_windows",
    f"""with {TEL}, g as (select *, coalesce(ts_us - lag(ts_us) over (partition by source_ip order by ts_us) >= {6 * HOUR_US}, true)::int as fresh from tel), s as (select *, sum(fresh) over (partition by source_ip order by ts_us) as run from g)
 select source_ip, min(ts_us) as start_us, max(ts_us) + {6 * HOUR_US} as end_us, count(*) as n, count(*) filter (event_type = 'auth_failure') as failures from s group by source_ip, run""",
)(lambda tel: processors.sessions(tel, "ts_us", "6 hours", "0 seconds", "source_ip").select("source_ip", F.unix_micros("session.start").alias("start_us"), F.unix_micros("session.end").alias("end_us"), "n", "failures"))


# Counts of micro-batches, one of which ran twice.
@pair("counted_batches", f"with {TEL} select event_type, service, count(*)::bigint as n from tel group by all")
def _(tel: DataFrame) -> DataFrame:
    path = _folder(tel, "counts")
    for number in (0, 1, 1, 2):
        sinks.counted(tel.where(col("seq") % 3 == lit(number)), number, path, "event_type", "service")
    return sinks.totals(tel.sparkSession, path, "event_type", "service")


# The event store by day, and a ring over it.
@pair("stored_ring", f"with {TEL} select event_id, seq, strftime(make_timestamp(ts_us), '%Y-%m-%d') as day from tel order by seq desc limit 1000")
def _(tel: DataFrame) -> DataFrame:
    path = _folder(tel, "store")
    for number in (0, 1, 0):
        sinks.stored(tel.drop("payload").where(col("seq") % 2 == lit(number)), number, path)
    return tel.sparkSession.read.parquet(path).orderBy(F.desc("seq")).limit(1000).select("event_id", "seq", col("day").cast("string").alias("day"))
