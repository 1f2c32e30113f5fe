"""Temporal, substring and membership joins over blocks, nodes and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.compat import first_part

from .rules import SQL_PARTS, XSS_PARTS
from .windows import running

# Seconds an address is blocked, by severity.
DURATIONS = {"low": 60, "medium": 300, "high": 600, "critical": 900}


def block_intervals(blocks: DataFrame) -> DataFrame:
    """(ip, start_us, end_us) from rows (ip, severity, ts_us), where a block in force is extended and not started anew.

    Overlapping blocks of an address merge: one starts when the latest end before it has passed.
    """
    seconds = F.coalesce(*[F.when(F.col("severity") == s, F.lit(d).cast("bigint")) for s, d in DURATIONS.items()], F.lit(DURATIONS["medium"]).cast("bigint"))
    return merged(blocks.select("ip", "ts_us", (F.col("ts_us") + seconds * 1_000_000).alias("end_us")))


def merged(rows: DataFrame) -> DataFrame:
    """Disjoint intervals of rows (ip, ts_us, end_us)."""
    seen = running(rows, "ip", ("ts_us", "end_us"), _last=("max", F.col("end_us"), False))
    runs = running(seen, "ip", ("ts_us", "end_us"), _run=("sum", F.coalesce(F.col("ts_us") > F.col("_last"), F.lit(True)).cast("int"), True))
    return runs.groupBy("ip", "_run").agg(F.min("ts_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_run")


def _covered(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """requests plus whether an interval of their address holds their time.

    Intervals of an address do not overlap, so the last one that began decides, and
    it is the one that ends last: a running maximum over both in order of time, with
    no pair of rows.
    """
    r = requests.withColumns({"_start": F.lit(None).cast("bigint"), "_end": F.lit(None).cast("bigint"), "_row": F.lit(1)})
    same = {c: F.lit(None).cast(t) for c, t in requests.dtypes if c not in ("source_ip", "ts_us")}
    i = intervals.select(F.col("ip").alias("source_ip"), F.col("start_us").alias("ts_us"), F.col("start_us").alias("_start"), F.col("end_us").alias("_end")).withColumns({**same, "_row": F.lit(0)})
    both = running(r.unionByName(i), "source_ip", ("ts_us", "_row", *same), _until=("max", F.col("_end"), True))
    return both.where("_row = 1").withColumn("_in", F.coalesce(F.col("ts_us") <= F.col("_until"), F.lit(False))).drop("_start", "_end", "_row", "_until")


def blocked(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    return _covered(requests, intervals).where("_in").drop("_in")


def unblocked(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    return _covered(requests, intervals).where("not _in").drop("_in")


def heartbeats(tel: DataFrame, nodes: DataFrame, most_nodes: int = 10_000) -> DataFrame:
    """(event_id, node_id): the first registered node whose id the service contains.

    Services are few against events, so each distinct one meets the nodes once. The
    nodes are broadcast if they number at most most_nodes; else they meet the
    services' substrings of their lengths in an equi-join.
    """
    services = tel.select("service").where("service is not null").distinct()
    if nodes.limit(most_nodes + 1).count() <= most_nodes:
        pairs = services.join(F.broadcast(nodes), F.col("service").contains(F.col("node_id")))
    else:
        starts = F.sequence(F.lit(1), F.length("service"))
        parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("service") - i + 1), lambda n: F.col("service").substr(i, n))))
        pairs = services.withColumn("node_id", F.explode(F.array_distinct(parts))).join(nodes, "node_id")
    first = pairs.groupBy("service").agg(F.min_by("node_id", "registered_seq").alias("node_id"))
    return tel.join(first, "service").select("event_id", "node_id")


#: Nodes that travel to every task at most.
FEW_NODES = 10_000


def route_attacks(attacks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(event_id, node_id): every attack meets the online nodes of its sector.

    Sectors are few, so attacks are not dealt by them: up to FEW_NODES online nodes
    go to every task as one array a sector; beyond, attacks of a sector are dealt to
    shares of its nodes.
    """
    return _routed(attacks, nodes).select("event_id", F.explode("nodes").alias("node_id"))


def _routed(attacks: DataFrame, nodes: DataFrame) -> DataFrame:
    """attacks plus nodes: online nodes of the sector, all of them, or, of very many, a share of them in each row, and _all: how many there are."""
    online = nodes.where("status = 'online'").select("node_id", F.col("sector").alias("_sector"))
    counted = online.groupBy("_sector").agg(F.count(F.lit(1)).alias("_all"))
    if online.limit(FEW_NODES + 1).count() <= FEW_NODES:
        listed = online.groupBy("_sector").agg(F.array_sort(F.collect_list("node_id")).alias("nodes"), F.count(F.lit(1)).alias("_all"))
        return attacks.join(F.broadcast(listed), F.col("domain") == F.col("_sector")).drop("_sector")
    share = F.pmod(F.xxhash64("node_id"), F.lit(-(-online.count() // FEW_NODES) * 16))
    listed = online.groupBy("_sector", share.alias("_share")).agg(F.array_sort(F.collect_list("node_id")).alias("nodes")).join(counted, "_sector")
    salted = attacks.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(-(-online.count() // FEW_NODES) * 16 - 1).cast("bigint"))))
    return salted.join(listed, (F.col("domain") == F.col("_sector")) & (salted["_share"] == listed["_share"])).select(*attacks.columns, "nodes", "_all")


def node_status(beats: DataFrame, now_us: int, after_s: int = 30) -> DataFrame:
    """(node_id, sector, last_seen, status) from rows (service, domain, ts_us)."""
    last = beats.groupBy(F.col("service").alias("node_id")).agg(F.max("ts_us").alias("last_seen"), F.max_by("domain", F.struct("ts_us", "seq")).alias("sector"))
    return last.withColumn("status", F.when(F.lit(now_us) - F.col("last_seen") > after_s * 1_000_000, "offline").otherwise("online"))


def status_changes(beats: DataFrame, until_us: int, after_s: int = 30) -> DataFrame:
    """(node_id, sector, status, ts_us, registered): each time a node of rows (service, domain, ts_us, seq) comes online or, after_s after its last row, goes offline.

    registered marks a node's first row. Silences that outlast until_us are not over yet. A node's rows are scanned in runs.
    """
    after = after_s * 1_000_000
    rows = beats.where("service is not null and ts_us is not null").select("service", "domain", "ts_us", "seq")
    seen = running(rows, "service", ("ts_us", "seq"), _last=("max", F.col("ts_us"), False))
    back = (F.col("ts_us") - F.col("_last")) > after
    said = lambda status, at, first: F.struct(F.lit(status).alias("status"), at.alias("ts_us"), F.lit(first).alias("registered"))
    told = F.when(F.col("_last").isNull(), F.array(said("online", F.col("ts_us"), True))).when(back, F.array(said("offline", F.col("_last") + after, False), said("online", F.col("ts_us"), False)))
    changes = seen.select(F.col("service").alias("node_id"), F.col("domain").alias("sector"), F.inline(told))
    last = rows.groupBy(F.col("service").alias("node_id")).agg(F.max("ts_us").alias("_end"), F.max_by("domain", F.struct("ts_us", "seq")).alias("sector")).where(F.lit(until_us) - F.col("_end") > after)
    gone = last.select("node_id", "sector", F.lit("offline").alias("status"), (F.col("_end") + after).alias("ts_us"), F.lit(False).alias("registered"))
    return changes.unionByName(gone)


def online_fraction(nodes: DataFrame) -> DataFrame:
    """One row: online nodes, all nodes and their fraction as text; 0/0 without nodes."""
    online, total = F.count_if(F.col("status") == "online"), F.count(F.lit(1))
    return nodes.agg(online.alias("online"), total.alias("total")).withColumn("text", F.concat(F.col("online").cast("string"), F.lit("/"), F.col("total").cast("string")))


def fan_out(attacks: DataFrame, nodes: DataFrame, blocks: str = "query") -> DataFrame:
    """(event_id, node_id, result, nodes): what each online node of the sector makes of an attack, and how many nodes it went to.

    A node that is told of an attack stops it if its text has a pattern (`blocks`
    names the column), and lets others pass.
    """
    result = F.when(F.coalesce(first_part(F.col(blocks), SQL_PARTS + XSS_PARTS).isNotNull(), F.lit(False)), "blocked").otherwise("passed")
    return _routed(attacks, nodes).select("event_id", F.explode("nodes").alias("node_id"), result.alias("result"), F.col("_all").alias("nodes"))


def sector_counts(nodes: DataFrame) -> DataFrame:
    """One row: online nodes of the three sectors, zeros kept."""
    return nodes.agg(*[F.count_if((F.col("sector") == s) & (F.col("status") == "online")).alias(s) for s in ("healthcare", "agriculture", "urban")])
