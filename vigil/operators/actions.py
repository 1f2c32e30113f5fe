"""Response actions and dropped-request records from alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import checkpointed

from .normalize import attacker_ip, coerced

# Actions of each rule in order; anything else is told to operators only.
PLAYBOOKS = {
    "sql_injection": ("block_ip", "alert_only"),
    "brute_force": ("block_ip", "throttle"),
    "rate_spike": ("throttle",),
    "high_cpu": ("alert_only",),
    "high_memory": ("isolate_service",),
    "high_network": ("throttle",),
    "ml_web_gatekeeper": ("block_ip", "alert_only"),
    "ml_network_shield": ("throttle", "alert_only"),
    "ml_agri_guardian": ("isolate_service", "alert_only"),
    "ml_health_sentinel": ("isolate_service", "alert_only"),
    "manual_response": ("block_ip", "throttle"),
}
DROPPED = {"sql_injection": "sql_injection", "brute_force": "brute_force", "rate_spike": "flooding"}
BLOCK_REASONS = {"sql_injection": "sql_injection", "brute_force": "brute_force", "rate_spike": "flooding"}
LEDGER_SEVERITY = {"critical": "critical", "high": "high", "warning": "medium", "medium": "medium", "low": "low"}
#: Rules whose evidence names an address.
ADDRESSED = ("sql_injection", "brute_force", "rate_spike")


def lookup(pairs: dict[str, str]):
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def actions(alerts: DataFrame) -> DataFrame:
    """(alert_id, rule_id, step, action, target, status, severity, ts_us, seq): playbook steps.

    A target is blocked or isolated by its first step in order of seq, alert and
    step; later ones are skipped. Steps without an address are left out. The steps
    are cut off from the alerts, which are worked out once.
    """
    plays = alerts.sparkSession.createDataFrame([(r, i, a) for r, xs in PLAYBOOKS.items() for i, a in enumerate(xs)], "rule_id string, step int, action string")
    rows = alerts.join(F.broadcast(plays), "rule_id", "left").withColumns({"action": F.coalesce("action", F.lit("alert_only")), "step": F.coalesce("step", F.lit(0))})
    ip = F.when(F.col("rule_id").isin(*ADDRESSED), attacker_ip(F.col("source_ip"))).otherwise("unknown")
    target = F.when(F.col("action") == "alert_only", "operators").when(F.col("action") == "isolate_service", F.when(F.col("rule_id").startswith("ml_"), F.col("source")).otherwise(F.coalesce("service", "source"))).otherwise(ip)
    rows = rows.withColumn("target", target).where("target != 'unknown'")
    return _settled(checkpointed(rows.select("alert_id", "rule_id", "step", "action", "target", "severity", "ts_us", "seq")))


def _settled(rows: DataFrame) -> DataFrame:
    """rows plus status. The least step of a target comes from a combining aggregate and meets its own row alone, so a target of very many steps is no hot key."""
    once = F.col("action").isin("block_ip", "isolate_service")
    least = rows.where(once).groupBy("action", "target").agg(F.min(F.struct("seq", "alert_id", "step")).alias("f"))
    firsts = least.select("action", "f.alert_id", "f.step", F.lit(True).alias("_first"))
    status = F.when(once & F.col("_first").isNull(), "skipped").otherwise("success")
    return rows.join(firsts, ["action", "alert_id", "step"], "left").select("alert_id", "rule_id", "step", "action", "target", status.alias("status"), "severity", "ts_us", "seq")


def dropped(alerts: DataFrame) -> DataFrame:
    """Dropped records of the three mapped rules; the evidence carries no path and no attempt count, so they show as such."""
    pairs = alerts.sparkSession.createDataFrame(list(DROPPED.items()), "rule_id string, attack_type string")
    return alerts.join(F.broadcast(pairs), "rule_id").select(
        "alert_id", "attack_type", "source_ip", F.lit("/unknown").alias("endpoint"), F.when(F.col("attack_type") == "flooding", "GET").otherwise("POST").alias("method"),
        coerced(F.col("severity"), ("low", "medium", "high", "critical"), "high").alias("severity"), F.lit(0).cast("bigint").alias("attempt_count"), "ts_us", "seq",
    )


def dropped_stats(rows: DataFrame, recent: int = 500) -> DataFrame:
    """(attack_type, dropped): one row a type and a total with null; recent counts what the ring of the newest would hold."""
    out = rows.rollup("attack_type").agg(F.count(F.lit(1)).alias("dropped"))
    return out.withColumn("recent", F.when(F.col("attack_type").isNull(), F.least("dropped", F.lit(recent))).cast("bigint"))


def limit_then_filter(rows: DataFrame, kind: str, n: int = 100) -> DataFrame:
    """The newest n, then those of one type."""
    return rows.orderBy(F.desc("seq"), "alert_id").limit(n).where(F.col("attack_type") == kind)


def dropped_writes(requests: DataFrame) -> DataFrame:
    """Dropped records of requests (source_ip, kind, path, method, severity, pattern, attempts, rate, block_limit, block_reason, ts_us, seq) of the five kinds, each with its own details."""
    text = lambda c: F.col(c).cast("string")
    details = {
        "blocked_ip": F.create_map(F.lit("original_block_reason"), text("block_reason")), "rate_limit": F.create_map(F.lit("rate"), text("rate"), F.lit("limit"), text("block_limit")),
        "sql_injection": F.create_map(F.lit("pattern_matched"), F.left("pattern", F.lit(50))), "brute_force": F.create_map(F.lit("attempt_count"), text("attempts")), "flooding": F.create_map(F.lit("rate"), text("rate")),
    }
    usual = {"rate_limit": "medium", "sql_injection": "high", "brute_force": "high", "flooding": "critical"}
    kind = F.col("kind")
    severity = F.when(kind == "rate_limit", "medium").otherwise(F.coalesce("severity", F.try_element_at(lookup(usual), kind), F.lit("high")))
    made = F.coalesce(*[F.when(kind == k, d) for k, d in details.items()])
    return requests.where(kind.isin(*details)).select(
        "source_ip", kind.alias("attack_type"), F.when(kind == "rate_limit", "rate-limited").otherwise("blocked").alias("reason"), F.col("path").alias("endpoint"), "method", severity.alias("severity"), F.to_json(made).alias("details"), "ts_us", "seq",
    )


def told_actions(actions: DataFrame) -> DataFrame:
    """actions without skipped ones that only tell of telemetry."""
    return actions.where(~((F.col("status") == "skipped") & F.lower(F.col("message")).contains("telemetry alert")))


def keyword(actions: DataFrame, word: str) -> DataFrame:
    """actions (label, keywords: array) whose label or a keyword holds the word in any case."""
    low = word.lower()
    return actions.where(F.lower("label").contains(low) | F.exists("keywords", lambda k: F.lower(k).contains(low)))


def ledger_blocks(actions: DataFrame) -> DataFrame:
    """(ip, reason, severity, ts_us) for the ledger from successful block actions."""
    good = actions.where((F.col("action") == "block_ip") & (F.col("status") == "success") & ~F.col("target").isin("", "unknown", "N/A"))
    return good.select(
        F.col("target").alias("ip"),
        F.coalesce(F.try_element_at(lookup(BLOCK_REASONS), F.col("rule_id")), F.lit("abuse")).alias("reason"),
        F.coalesce(F.try_element_at(lookup(LEDGER_SEVERITY), F.col("severity")), F.lit("high")).alias("severity"),
        "ts_us",
    )


def newest(rows: DataFrame, n: int, per: str | None = None) -> DataFrame:
    """Ring of the newest n rows, of each `per` if given."""
    if per is None:
        return rows.orderBy(F.desc("seq")).limit(n)
    w = Window.partitionBy(per).orderBy(F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
