"""The catalog: one named query for each operator, over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.compat import first_part, ipv4, protected_ip
from vigil.operators import actions, alerts, dashboard, features, folds, joins, models, normalize, perimeter, rules, windows
from vigil.session import table, written
from vigil.sources.telemetry import telemetry_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DAY, HOUR_US, NOW_US = 86400, 3_600_000_000, 1_706_572_800_000_000


def over(name: str, source: Callable[[SparkSession, str], DataFrame] = telemetry_of) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a query that applies the function to its source."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(source(spark, sf_dir))
        return f

    return add


def of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, name)


def pick(n: int, *values: Column) -> Column:
    """values[seq % n]; null beyond them."""
    return reduce(lambda c, i: F.when(F.col("seq") % n == i, values[i]).otherwise(c), range(len(values)), F.lit(None))


lit, col = F.lit, F.col


@over("ingest_normalize")
def _(tel: DataFrame) -> DataFrame:
    raw = tel.select(
        F.when(col("seq") % 7 == 0, "").otherwise(col("event_id")).alias("event_id"), "source_ip", F.when(col("seq") % 5 != 0, col("domain")).alias("domain"), "service", "event_type",
        F.when(col("seq") % 11 == 0, lit(0)).otherwise(F.floor(col("ts_us") / 1_000_000)).cast("bigint").alias("timestamp"), F.when(col("seq") % 4 > 0, F.concat(lit('{"k": '), col("seq").cast("string"), lit("}"))).alias("payload"),
    )
    return normalize.normalize(raw, 1_710_000_000).withColumns({c: col(c).cast("bigint") for c in ("timestamp", "received_at")})


over("events_page")(lambda tel: tel.orderBy(F.desc("seq")).offset(20).limit(50).select("event_id", "seq"))
over("events_ring_1000")(lambda tel: actions.newest(tel.select("event_id", "seq"), 1000))


@over("client_ip_resolve")
def _(tel: DataFrame) -> DataFrame:
    text = lambda a, n, b: F.concat(lit(a), (col("seq") % n).cast("string"), lit(b))
    forwarded = pick(3, text(" 203.0.113.", 200, " , 10.0.0.1"), lit(""))
    real = F.when(col("seq") % 2 == 0, text(" 198.51.100.", 90, ""))
    peer = F.when(col("seq") % 7 == 0, "").otherwise(col("source_ip"))
    return tel.select("event_id", normalize.client_ip(forwarded, real, F.when(col("seq") % 5 == 0, "192.0.2.7"), peer).alias("client_ip"))


@over("source_ip_resolve")
def _(tel: DataFrame) -> DataFrame:
    a = pick(4, lit("unknown"), lit("127.0.0.1"), lit(""), col("source_ip"))
    return tel.select("event_id", normalize.source_ip(a, pick(3, col("source_ip"), lit("localhost"))).alias("resolved"))


@over("attacker_ip_extract")
def _(tel: DataFrame) -> DataFrame:
    a, b = pick(4, lit("127.0.0.9"), lit("999.1.1.1"), lit("")), pick(3, lit("::1"), col("source_ip"), col("source_ip"))
    return tel.select("event_id", normalize.attacker_ip(a, b).alias("attacker"))


@over("evidence_ip")
def _(tel: DataFrame) -> DataFrame:
    a, b = pick(4, lit("unknown"), lit(""), lit("Unknown")), F.when(col("seq") % 3 > 0, col("source_ip"))
    return tel.select("event_id", normalize.evidence_ip(a, b).alias("ip"))


@over("ipv4_validity")
def _(tel: DataFrame) -> DataFrame:
    ip = pick(6, col("source_ip"), F.concat("source_ip", lit(".1")), lit("256.1.1.1"), lit("1..2.3"), lit("a.b.c.d"), lit("010.000.255.1"))
    return tel.select("event_id", ip.alias("ip")).select("event_id", "ip", ipv4(col("ip")).alias("valid"), protected_ip(col("ip")).alias("protected"))


over("rule_sqli_matches")(rules.matched_fields)
over("rule_sqli_pages", of("pages"))(lambda p: p.select("page_id", first_part(col("html"), rules.SQL_PARTS).alias("part")).where("part is not null"))
over("rule_xss_pages", of("pages"))(lambda p: p.select("page_id", first_part(col("html"), rules.XSS_PARTS).alias("part")).where("part is not null"))
over("rule_agent_sqli")(lambda tel: tel.where(rules.agent_sql(col("query"))).select("event_id", "query"))


@over("threat_classify", of("pages"))
def _(pages: DataFrame) -> DataFrame:
    kind, pattern = rules.threat_class(F.regexp_extract("url", r"[?](.*)$", 1), col("url"))
    return pages.select("page_id", kind.alias("kind"), pattern.alias("pattern")).where("kind is not null")


over("rule_high_cpu")(rules.high_cpu)
over("rule_high_memory")(rules.high_memory)
over("rule_high_network")(rules.high_network)
over("rule_rate_spike_24h")(lambda tel: rules.rate_spike(tel, DAY, 8))
over("rule_brute_force_24h")(lambda tel: rules.brute_force(tel, DAY, 5))
over("brute_force_cooldown")(lambda tel: folds.cooldown(rules.brute_force(tel, DAY, 3).select("source_ip", "ts_us", "seq"), ["source_ip"], "ts_us", 6 * HOUR_US))


def daily_hits(tel: DataFrame) -> DataFrame:
    """Hits of the rules, their windows a day long as events are sparse, and of the models."""
    return rules.every_hit(tel, (DAY, 8), (DAY, 5))


over("all_rules")(daily_hits)
over("rule_hit_counts")(lambda tel: daily_hits(tel).groupBy("rule_id", "severity").agg(F.count(lit(1)).alias("hits")))
over("dashboard_rules")(rules.dashboard_hits)


@over("dashboard_rule_cooldown")
def _(tel: DataFrame) -> DataFrame:
    return folds.cooldown(rules.dashboard_hits(tel).select("rule", "device", "ts_us", "seq"), ["rule", "device"], "ts_us", HOUR_US)


def verdicts(tel: DataFrame) -> DataFrame:
    return rules.layered_verdict(rules.model_request(tel))


@over("network_heuristics")
def _(tel: DataFrame) -> DataFrame:
    n = F.size(rules.network_reasons())
    return rules.model_request(tel).select("event_id", n.alias("reasons"), F.least(0.5 + n * 0.15, lit(1.0)).alias("score")).where("reasons > 0")


over("layered_verdict")(lambda tel: verdicts(tel).select("event_id", "sector", "status", "threat_level", "source", "score"))
over("ml_anomalies")(lambda tel: rules.model_hits(verdicts(tel)))


def daily_alerts(tel: DataFrame) -> DataFrame:
    return alerts.alerts(daily_hits(tel))


def acked(tel: DataFrame) -> DataFrame:
    rows = daily_alerts(tel)
    return alerts.acknowledged(rows, rows.where("seq % 5 = 0"))


over("alerts")(daily_alerts)
over("alert_descriptions")(lambda tel: alerts.described(daily_alerts(tel)))
over("alert_stats")(lambda tel: alerts.stats(acked(tel)))
over("alert_views")(lambda tel: alerts.views(acked(tel)))
over("alert_dedup")(lambda tel: folds.cooldown(daily_alerts(tel).select("title", "source", "ts_us", "seq"), ["title", "source"], "ts_us", HOUR_US))


def acted(tel: DataFrame) -> DataFrame:
    return actions.actions(daily_alerts(tel))


def dropped(tel: DataFrame) -> DataFrame:
    return actions.dropped(daily_alerts(tel))


over("playbook_actions")(lambda tel: acted(tel).select("alert_id", "rule_id", "step", "action", "target"))


@over("action_first_wins")
def _(tel: DataFrame) -> DataFrame:
    once = acted(tel).where(col("action").isin("block_ip", "isolate_service"))
    return once.groupBy("action", "target").agg(F.count_if(col("status") == "success").alias("won"), F.count_if(col("status") == "skipped").alias("skipped"))


over("action_counts")(lambda tel: acted(tel).groupBy("rule_id", "action", "status").agg(F.count(lit(1)).alias("n")))
over("ledger_blocks")(lambda tel: actions.ledger_blocks(acted(tel)))
over("dropped_records")(dropped)
over("dropped_stats_rollup")(lambda tel: actions.dropped_stats(dropped(tel)))
over("dropped_limit_then_filter")(lambda tel: actions.limit_then_filter(dropped(tel), "brute_force").select("alert_id", "source_ip", "seq"))


def long_blocks(tel: DataFrame) -> DataFrame:
    """Intervals of failed logins as blocks, their durations times 96 so that they meet the sparse events."""
    severity = pick(4, *[lit(s) for s in joins.DURATIONS])
    base = tel.where("event_type = 'auth_failure'").select(col("source_ip").alias("ip"), severity.alias("severity"), "ts_us")
    seconds = reduce(lambda c, p: F.when(col("severity") == p[0], lit(p[1]).cast("bigint")).otherwise(c), joins.DURATIONS.items(), lit(300).cast("bigint"))
    return joins.merged(base.select("ip", "ts_us", (col("ts_us") + seconds * 96_000_000).alias("end_us")))


over("block_intervals")(long_blocks)
over("blocked_request_semi")(lambda tel: joins.blocked(tel.select("event_id", "source_ip", "ts_us"), long_blocks(tel)))
over("unblocked_request_anti")(lambda tel: joins.unblocked(tel.select("event_id", "source_ip", "ts_us"), long_blocks(tel)))
over("rate_limit_log")(lambda tel: windows.request_windows(tel, DAY).where("n > 6").select("event_id", "source_ip", "n"))
over("request_rate")(lambda tel: windows.request_windows(tel, 3600).select("event_id", "n", "rate"))
over("flood_counts")(lambda tel: windows.flood(tel, 7200, 3, 4).select("event_id", "n", "is_flood", "confidence", "severity"))


@over("flood_ewma", of("events"))
def _(events: DataFrame) -> DataFrame:
    ip = F.concat(lit("10.0."), F.floor(col("user_id") / 256).cast("string"), lit("."), (col("user_id") % 256).cast("string"))
    rows = events.select(ip.alias("source_ip"), F.unix_micros(col("ts").cast("timestamp")).alias("ts_us"), col("event_id").alias("seq"), "value")
    after = folds.baseline(rows, "value")
    return after.groupBy("source_ip").agg(F.max_by("baseline", F.struct("ts_us", "seq")).alias("baseline"))


@over("brute_tracker")
def _(tel: DataFrame) -> DataFrame:
    rows = rules.failed_auth(tel).select("source_ip", "ts_us", "seq", col("service").alias("username"))
    return windows.brute(rows, DAY, 5, 600_000_000).select("source_ip", "seq", "n", "gap_us", "is_brute", "confidence", "severity")


@over("distinct_users_running")
def _(tel: DataFrame) -> DataFrame:
    rows = rules.failed_auth(tel).select("source_ip", "ts_us", "seq", F.concat(lit("u"), (col("seq") % 7).cast("string")).alias("username"))
    return windows.brute(rows, DAY).select("source_ip", "seq", "users")


@over("threat_score_running")
def _(tel: DataFrame) -> DataFrame:
    rows = daily_alerts(tel).select(col("source_ip").alias("ip"), "severity", "ts_us", "seq", "rule_id")
    return dashboard.threat_scores(rows, "rule_id").select("ip", "seq", "rule_id", "score", "action")


over("high_threat_ips")(lambda tel: dashboard.high_threat(daily_alerts(tel).select(col("source_ip").alias("ip"), "severity"), 1000))


def nodes(tel: DataFrame) -> DataFrame:
    return joins.node_status(tel, NOW_US, 3600)


over("node_status")(lambda tel: nodes(tel).select("node_id", "sector", "last_seen", "status"))
over("sector_online_counts")(lambda tel: joins.sector_counts(nodes(tel)))


@over("heartbeat_contains_join")
def _(tel: DataFrame) -> DataFrame:
    ids = nodes(tel).select("node_id", col("node_id").alias("registered_seq"))
    return joins.heartbeats(tel, ids)


over("attack_routing")(lambda tel: joins.route_attacks(tel.where("event_type = 'auth_failure'"), nodes(tel)))


@over("device_health")
def _(tel: DataFrame) -> DataFrame:
    damage = F.when(col("event_type") == "auth_failure", F.when(col("seq") % 2 == 0, 10).otherwise(15)).otherwise(0)
    rows = tel.where(col("event_type").isin("auth_failure", "telemetry")).select(col("service").alias("device"), damage.alias("damage"), "ts_us", "seq")
    last = F.max_by(F.struct("health", "status"), F.struct("ts_us", "seq")).alias("z")
    return folds.device_health(rows).groupBy("device").agg(last).select("device", "z.health", "z.status")


over("chart_ring_120")(lambda tel: actions.newest(normalize.chart_point(tel), 120, "device"))
over("chart_scaled")(lambda tel: dashboard.scaled(normalize.chart_point(tel)))
over("chart_axis")(lambda tel: dashboard.axis(normalize.chart_point(tel)))
over("latest_point")(lambda tel: dashboard.latest(normalize.chart_point(tel)).select("device", "seq", "cpu"))
over("distinct_devices")(lambda tel: dashboard.first_seen(normalize.chart_point(tel)))
over("rps")(dashboard.requests_per_second)
over("timeline_top50")(lambda tel: dashboard.timeline(daily_alerts(tel)))
over("sector_summary")(lambda tel: dashboard.sector_summary(verdicts(tel)))
over("threat_rate")(lambda tel: dashboard.threat_rate(verdicts(tel)))
over("traffic_per_slot")(lambda tel: dashboard.traffic(verdicts(tel), HOUR_US))
over("minmax_scaled")(lambda tel: features.min_max(tel.where("network is not null"), "domain", "network").select("event_id", "network_scaled"))
over("sequence_windows")(lambda tel: features.sequences(tel.where("network is not null"), "domain", "seq", "network", 20))


@over("label_clean")
def _(tel: DataFrame) -> DataFrame:
    label = pick(4, lit("norm"), lit("BenignTraffic"), lit("DDoS"), lit("Mirai"))
    network = F.when(col("seq") % 13 == 0, lit(float("inf"))).when(col("seq") % 17 == 0, lit(float("nan"))).otherwise(col("network"))
    return features.cleaned(tel.select("event_id", label.alias("label"), network.alias("network"), "memory"), "label", "network", "memory")


@over("char_ngram_counts", of("documents"))
def _(docs: DataFrame) -> DataFrame:
    return features.gram_totals(docs, "text").orderBy(F.desc("n"), "gram").limit(100)


def requests_of(tel: DataFrame) -> DataFrame:
    """Perimeter requests: time is compressed so that windows fill."""
    login = col("event_type").isin("auth_failure", "auth_attempt")
    made = {
        "source_ip": F.concat(lit("10.0.0."), (col("seq") % 16).cast("string")), "ts_us": (col("ts_us") / 40).cast("bigint"), "seq": col("seq"),
        "path": F.when(login, "/login").when(col("seq") % 3 == 0, "/api/x").otherwise("/"), "query": F.coalesce("query", lit("")), "method": F.when(login, "POST").otherwise("GET"),
        "status": F.when(col("event_type") == "auth_failure", 401).otherwise(200), "username": F.concat(lit("u"), (col("seq") % 9).cast("string")),
    }
    return tel.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in perimeter.REQUEST.fields])


over("perimeter_pipeline")(lambda tel: perimeter.pipeline(requests_of(tel)))


@over("block_lifecycle")
def _(tel: DataFrame) -> DataFrame:
    rows = tel.where("event_type = 'auth_failure'").select(
        col("source_ip").alias("ip"), "ts_us", "seq", F.when(col("seq") % 5 == 0, "unblock").otherwise("block").alias("op"),
        pick(4, *[lit(s) for s in joins.DURATIONS]).alias("severity"), F.when(col("seq") % 9 == 0, lit(0)).otherwise(lit(86400)).alias("seconds"),
    )
    return perimeter.lifecycle(rows)


@over("web_forest")
def _(tel: DataFrame) -> DataFrame:
    rows = tel.where("query is not null").select("event_id", "query", F.coalesce(first_part(col("query"), rules.GATEKEEPER_PARTS + rules.XSS_PARTS + ("--",)), lit("")).alias("hit"))
    # Events are few files; what is made of them is dealt out, and written as it is read several times.
    rows = rows.repartition(2 * tel.sparkSession.sparkContext.defaultParallelism, "event_id")
    rows = written(models.grams(rows, "query").withColumn("label", (col("hit") != "").cast("int")).select("event_id", "grams", "label"), "grams")
    model = models.web_forest(rows.where(F.pmod(F.xxhash64("event_id"), lit(5)) > 0))
    return models.verdict(model, rows).select("event_id", "label", col("prediction").cast("int").alias("prediction"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits to alerts to actions: steps of each rule, severity and action."""
    return acted(telemetry_of(spark, sf_dir)).groupBy("rule_id", "severity", "action").agg(F.count(lit(1)).alias("steps"))


QUERIES["alert_actions"] = flagship
