"""Alerts from hits: template lookup, severity, source, description, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.compat import truthy

# Titles and severities of rules.
TEMPLATES = (
    ("sql_injection", "SQL Injection Attempt", "critical"),
    ("rate_spike", "Potential DDoS Attack", "warning"),
    ("high_cpu", "High CPU Usage Alert", "warning"),
    ("high_memory", "Critical Memory Usage", "critical"),
    ("high_network", "High Network Traffic (Data Exfiltration Risk)", "warning"),
    ("brute_force", "Brute Force Attack Detected", "critical"),
)


def templates(spark: SparkSession) -> DataFrame:
    """Six fixed rows; the join below broadcasts them."""
    return spark.createDataFrame(TEMPLATES, "rule_id string, title string, template_severity string")


def alerts(hits: DataFrame) -> DataFrame:
    """One alert a hit. Model rules and critical hits keep their own severity; the evidence of model rules names no source."""
    rows = hits.join(F.broadcast(templates(hits.sparkSession)), "rule_id", "left")
    own = F.col("rule_id").startswith("ml_") | (F.col("severity") == "critical") | F.col("template_severity").isNull()
    return rows.select(
        F.sha2(F.concat_ws("|", "event_id", "rule_id"), 256).alias("alert_id"),
        "event_id", "rule_id",
        F.coalesce("title", "rule_name").alias("title"),
        F.when(own, F.col("severity")).otherwise(F.col("template_severity")).alias("severity"),
        F.coalesce(F.when(~F.col("rule_id").startswith("ml_"), F.coalesce(truthy(F.col("service")), truthy(F.col("source_ip")))), F.lit("Unknown")).alias("source"),
        "source_ip", "service", "value", "detail", "ts_us", "seq",
    )


def described(rows: DataFrame) -> DataFrame:
    """(alert_id, rule_id, description): fixed texts around what was found; counts are whole numbers, metrics stay unformatted."""
    given = lambda c, other="unknown": F.coalesce(c, F.lit(other))
    count, number = given(F.col("value").cast("bigint").cast("string")), given(F.col("value").cast("string"))
    ip, service = given(F.col("source_ip")), given(F.col("service"))
    # The texts of alerts.
    texts = {
        "sql_injection": ("Malicious SQL injection patterns detected in ", given(F.col("detail"), "unknown field"), ". Source IP: ", ip, ". This could be an attempt to extract or manipulate database data."),
        "rate_spike": ("Abnormal request rate detected: ", count, " requests from ", ip, " in the last minute. This could indicate a DDoS attack or aggressive scraping."),
        "high_cpu": ("CPU utilization at ", number, "% on ", service, ". High CPU may cause service degradation or indicate a runaway process."),
        "high_memory": ("Memory usage at ", number, "% on ", service, ". Critical memory pressure may cause service crashes or system instability."),
        "high_network": ("Network traffic spike detected at ", number, " KB/s. This could indicate data exfiltration or a flood attack."),
        "brute_force": ("Multiple failed authentication attempts (", count, ") from ", ip, " targeting user '", given(F.col("detail")), "'. Possible credential stuffing or brute force attack."),
    }
    made = [F.when(F.col("rule_id") == rule, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in text])) for rule, text in texts.items()]
    return rows.select("alert_id", "rule_id", F.coalesce(*made, F.col("title")).alias("description"))


def acknowledged(rows: DataFrame, acks: DataFrame) -> DataFrame:
    """rows plus acknowledged: whether acks (alert_id) holds the alert."""
    marks = acks.select("alert_id").distinct().withColumn("_ack", F.lit(True))
    return rows.join(marks, "alert_id", "left").withColumn("acknowledged", F.coalesce("_ack", F.lit(False))).drop("_ack")


def stats(rows: DataFrame) -> DataFrame:
    active = ~F.col("acknowledged")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"),
        F.count_if(active & (F.col("severity") == "critical")).alias("critical"), F.count_if(active & (F.col("severity") == "warning")).alias("warning"),
    )


def dismissed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows without those that ids (alert_id) names."""
    return rows.join(ids.select("alert_id").distinct(), "alert_id", "left_anti")


def cleared(rows: DataFrame) -> DataFrame:
    """rows that are not acknowledged."""
    return rows.where(~F.col("acknowledged"))


def of_severity(rows: DataFrame, *severities: str) -> DataFrame:
    return rows.where(F.col("severity").isin(*severities))


def of_device(rows: DataFrame, device: str, column: str = "service") -> DataFrame:
    return rows.where(F.col(column) == device)


def views(rows: DataFrame) -> DataFrame:
    """(view, alert_id): the dashboard's tabs an alert stands in. Blocked: rows whose action is blocked in any case, or that say what blocked them."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    ml = F.col("rule_id").startswith("ml_") | F.col("title").contains("ML:")
    stopped = F.coalesce(F.upper(have("action")) == "BLOCKED", F.lit(False)) | F.coalesce(have("blocked_by") != "", F.lit(False))
    tabs = F.array(F.lit("all"), F.when(F.col("acknowledged"), "acknowledged").otherwise("active"), F.when(ml, "ml"), F.when(stopped, "blocked"))
    return rows.select(F.explode(F.filter(tabs, lambda x: x.isNotNull())).alias("view"), "alert_id")
