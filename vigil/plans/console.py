"""Queries of the console: display texts, filters, counts, commands, ledgers and feeds, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.compat import fixed_point
from vigil.operators import actions, alerts, commands, dashboard, features, folds, joins, models, normalize, perimeter, rules, windows
from vigil.sources import telemetry
from vigil.sources.telemetry import telemetry_of

from .catalog import DAY, NOW_US, QUERIES, acked, col, daily_alerts, lit, nodes, over, pick
from .sql import ACKED, ACTIONS, ALERTS, NODES, SQL, TEL, VERDICT, chain, first_index, q, window


def pair(name: str, sql: str, source: Callable[[SparkSession, str], DataFrame] = telemetry_of) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a query and its SQL."""
    SQL[name] = sql
    return over(name, source)


def text(*parts: str | Column) -> Column:
    return F.concat(*[p if isinstance(p, Column) else lit(p) for p in parts])


def number(c: Column) -> Column:
    return c.cast("string")


def switch(values: list[str], n: int) -> str:
    return f"case seq % {n} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


# Display texts.
pair("password_mask", f"with {TEL} select event_id, repeat('*', length(username)) as masked from tel where username is not null")(lambda tel: tel.where("username is not null").select("event_id", normalize.masked(col("username")).alias("masked")))
pair("enum_coercion", f"with {TEL} select event_id, case when seq % 3 = 0 then 'abuse' else 'manual' end as reason, case when seq % 5 = 1 then 'low' else 'high' end as severity from tel")(
    lambda tel: tel.select("event_id", normalize.coerced(pick(3, lit("abuse"), lit("odd")), ("manual", "abuse", "flooding", "brute_force", "sql_injection"), "manual").alias("reason"), normalize.coerced(pick(5, lit("odd"), lit("low")), ("low", "medium", "high", "critical"), "high").alias("severity"))
)
pair("sector_badge", f"""with {TEL}, b as (select event_id, {switch(["'ml_health_sentinel'", "'ml_agri_guardian'", "'high_cpu'", "null"], 4)} as rule, {switch(["null", "'urban'", "'agriculture'"], 3)} as sector from tel)
 select event_id, case when contains(coalesce(rule, ''), 'health') or contains(coalesce(sector, ''), 'health') then 'healthcare' when contains(coalesce(rule, ''), 'agri') or contains(coalesce(sector, ''), 'agri') then 'agriculture'
 when contains(coalesce(rule, ''), 'urban') or contains(coalesce(sector, ''), 'urban') then 'urban' end as badge from b""")(
    lambda tel: tel.select("event_id", normalize.sector_badge(pick(4, lit("ml_health_sentinel"), lit("ml_agri_guardian"), lit("high_cpu")), pick(3, lit(None).cast("string"), lit("urban"), lit("agriculture"))).alias("badge"))
)
_AGO = "case when s < 0 then 'just now' when s < 60 then floor(s)::bigint || 's ago' when s < 3600 then floor(s / 60)::bigint || 'm ago' {d} end"
_CARD, _LINE = _AGO.format(d="when s < 86400 then floor(s / 3600)::bigint || 'h ago' else floor(s / 86400)::bigint || 'd ago'"), _AGO.format(d="else floor(s / 3600)::bigint || 'h ago'")
pair("relative_time", f"with {TEL}, t as (select event_id, (seq * seq * 37 % 200000 - 50)::double as s from tel) select event_id, {_CARD} as card, {_LINE} as line from t")(
    lambda tel: tel.withColumn("s", (col("seq") * col("seq") * 37 % 200_000 - 50).cast("double")).select("event_id", normalize.relative_time(col("s")).alias("card"), normalize.relative_time(col("s"), card=False).alias("line"))
)
pair("rate_display", f"with {TEL} select event_id, case when seq % 5000 > 999 then (floor((seq % 5000) / 100.0::double + 0.5) / 10.0::double) || 'k/min' else seq % 5000 || '/min' end as shown from tel")(lambda tel: tel.select("event_id", normalize.rate_text(col("seq") % 5000).alias("shown")))
pair("attack_labels", f"with {TEL} select event_id, upper(replace(event_type, '_', ' ')) as label from tel")(lambda tel: tel.select("event_id", normalize.attack_label(col("event_type")).alias("label")))
pair("host_units", f"with {TEL} select event_id, round(seq * 123456789 / 1073741824.0::double, 1) as gb, round(seq * 98765 / 1048576.0::double, 1) as mb from tel")(lambda tel: tel.select("event_id", normalize.gigabytes(col("seq") * 123_456_789).alias("gb"), normalize.megabytes(col("seq") * 98_765).alias("mb")))
pair("iso_times", f"with {TEL} select event_id, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as at from tel")(lambda tel: tel.select("event_id", normalize.iso_time(col("ts_us")).alias("at")))
pair("block_records", f"""with {TEL}, b as (select event_id as ip, ts_us, case when seq % 4 = 0 then 0 else ts_us + seq % 900 * 1000000 end as e from tel) select ip, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' as blocked_at,
 case when e = 0 then 'permanent' else strftime(make_timestamp(e), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' end as expires_at, case when e = 0 then -1 else greatest(0, floor((e - {NOW_US}) / 1000000.0::double)) end::bigint as remaining_seconds from b""")(
    lambda tel: normalize.block_record(tel.select(col("event_id").alias("ip"), col("ts_us").alias("blocked_us"), F.when(col("seq") % 4 == 0, 0).otherwise(col("ts_us") + col("seq") % 900 * 1_000_000).alias("expires_us")), NOW_US)
)
pair("fixed_point_text", f"with {TEL} select event_id, printf('%.1f', cpu) as cpu, printf('%.2f', memory) as memory, printf('%.0f', network) as network from tel where network is not null and memory is not null")(
    lambda tel: tel.where("network is not null and memory is not null").select("event_id", fixed_point(col("cpu"), 1).alias("cpu"), fixed_point(col("memory"), 2).alias("memory"), fixed_point(col("network"), 0).alias("network"))
)
pair("evidence_truncation", "select page_id, left(html, 100) as value, left(html, 50) as pattern, left(html, 200) as query from pages", lambda s, d: s.read.parquet(f"{d}/pages.parquet"))(
    lambda p: p.select("page_id", F.left("html", lit(100)).alias("value"), F.left("html", lit(50)).alias("pattern"), F.left("html", lit(200)).alias("query"))
)
pair("payload_merge", f"""with {TEL}, e as (select event_id, 'query' as k, query as v from tel where query is not null union all select event_id, 'username', username from tel where username is not null and seq % 7 <> 0 union all select event_id, 'username', 'seen' from tel where seq % 7 = 0 union all select event_id, 'seq', seq::varchar from tel)
 select event_id, k as field, v as value from e""")(
    lambda tel: tel.select("event_id", F.explode(F.map_concat(F.map_filter("payload", lambda k, _: (k != "username") | (col("seq") % 7 != 0)), F.map_filter(F.create_map(lit("username"), lit("seen")), lambda k, v: col("seq") % 7 == 0), F.create_map(lit("seq"), number(col("seq"))))).alias("field", "value"))
)

# Draws in place of random numbers.
_U = "cast('0x' || substr(md5('{s}:' || event_id), 1, 12) as bigint) / 281474976710656.0::double"
pair("probabilistic_block", f"with {TEL} select event_id, {_U.format(s='waf')} < 0.85 as waf_blocks, {_U.format(s='model')} < 0.8 as model_blocks, {_U.format(s='login')} < 0.05 as login_succeeds from tel")(
    lambda tel: tel.select("event_id", (normalize.draw(col("event_id"), "waf") < 0.85).alias("waf_blocks"), (normalize.draw(col("event_id"), "model") < 0.8).alias("model_blocks"), (normalize.draw(col("event_id"), "login") < 0.05).alias("login_succeeds"))
)
pair("seeded_shuffle", f"with {TEL} select event_id from tel order by md5('shuffle:' || event_id), event_id limit 500")(lambda tel: tel.select("event_id").orderBy(F.md5(text("shuffle:", col("event_id")).cast("binary")), "event_id").limit(500))
pair("train_test_split", f"with {TEL} select case when {_U.format(s='split')} < 0.8 then 'train' else 'test' end as part, count(*) as n from tel group by 1")(
    lambda tel: tel.groupBy(F.when(normalize.draw(col("event_id"), "split") < 0.8, "train").otherwise("test").alias("part")).agg(F.count(lit(1)).alias("n"))
)

# Filters.
PATHS = ["'/health'", "'/auth/token'", "'/login'", "'/api/login'", "'/api/x'", "'/'"]
_PATHS = f"p as (select event_id, seq, event_type, case when seq % 10 = 0 then '127.0.0.8' else source_ip end as ip, {switch(PATHS, 6)} as path, case when seq % 4 = 0 then 'GET' else 'POST' end as method, case seq % 3 when 0 then 401 when 1 then 403 else 200 end as status from tel)"


def paths(tel: DataFrame) -> DataFrame:
    made = pick(6, *[lit(p.strip("'")) for p in PATHS])
    return tel.select("event_id", "seq", F.when(col("seq") % 10 == 0, "127.0.0.8").otherwise(col("source_ip")).alias("ip"), made.alias("path"), F.when(col("seq") % 4 == 0, "GET").otherwise("POST").alias("method"), pick(3, lit(401), lit(403)).alias("status")).withColumn("status", F.coalesce("status", lit(200)))


pair("bypass_filter", f"with {TEL}, {_PATHS} select event_id from p where path not in ({', '.join(q(b) for b in perimeter.BYPASS)}) and not (ip in ('127.0.0.1', 'localhost', '::1') or starts_with(ip, '127.'))")(lambda tel: normalize.checked(paths(tel), perimeter.BYPASS).select("event_id"))
pair("rate_category", f"with {TEL}, {_PATHS} select event_id, case when starts_with(path, '/auth') or starts_with(path, '/login') then 'auth' when starts_with(path, '/api') then 'api' else 'default' end as category from p")(lambda tel: paths(tel).select("event_id", normalize.rate_category(col("path")).alias("category")))
pair("auth_failure_capture", f"with {TEL}, {_PATHS} select event_id, ip from p where method = 'POST' and ({' or '.join(f'starts_with(path, {q(x)})' for x in perimeter.LOGIN_PATHS)}) and status in (401, 403)")(lambda tel: normalize.failed_logins(paths(tel), perimeter.LOGIN_PATHS).select("event_id", "ip"))
pair("alert_severity_filter", f"with {ALERTS} select alert_id, severity from alerts where severity in ('critical', 'high')")(lambda tel: alerts.of_severity(daily_alerts(tel), "critical", "high").select("alert_id", "severity"))
pair("device_telemetry", f"with {TEL} select event_id, cpu from tel where service = 'node-3'")(lambda tel: alerts.of_device(tel, "node-3").select("event_id", "cpu"))
pair("told_actions", f"with {ACTIONS} select alert_id, step from acted where not (status = 'skipped' and seq % 2 = 0)")(
    lambda tel: actions.told_actions(actions.actions(daily_alerts(tel)).withColumn("message", F.when(col("seq") % 2 == 0, "a Telemetry Alert").otherwise("done"))).select("alert_id", "step")
)
pair("sqli_payload_map", f"""with {TEL}, f as (select event_id, 'agent' as field, case when seq % 6 = 0 then 'x; DROP table y' else 'plain' end as text from tel union all select event_id, 'note', case when seq % 4 = 0 then 'a%27 or b' end from tel union all select event_id, 'query', query from tel)
 select event_id, string_agg(field || ':' || p, ',' order by list_position(['query', 'agent', 'note'], field)) as found from (select *, {first_index('text', rules.SQL_PATTERNS)} as p from f) where p is not null group by event_id""")(
    lambda tel: tel.withColumn("m", F.create_map(lit("query"), col("query"), lit("agent"), F.when(col("seq") % 6 == 0, "x; DROP table y").otherwise("plain"), lit("note"), F.when(col("seq") % 4 == 0, "a%27 or b")))
    .select("event_id", F.array_join(F.transform(rules.matches(col("m")), lambda x: F.concat_ws(":", x["field"], x["pattern"])), ",").alias("found"))
    .where("found != ''")
)
pair("known_attack_records", f"""with {TEL}, e as (select event_id, {switch(["'sqli_attack'", "'sqli_blocked'", "'sql_injection_attempt'"], 4)} as t, case when seq % 2 = 0 then '/p' || seq % 5 end as path, seq % 3 = 0 as done from tel)
 select event_id, 'SQL Injection attempt detected on ' || coalesce(path, 'unknown endpoint') as description, case when done then 'Already neutralized' else 'Immediate IP Block' end as recommendation from e where t is not null""")(
    lambda tel: rules.known_attacks(tel.select("event_id", pick(4, *[lit(t) for t in rules.ATTACK_TYPES]).alias("event_type"), F.map_filter(F.create_map(lit("path"), F.when(col("seq") % 2 == 0, text("/p", number(col("seq") % 5))), lit("action"), F.when(col("seq") % 3 == 0, "BLOCKED").otherwise("SEEN")), lambda _, v: v.isNotNull()).alias("payload")))
)

# Alerts.
pair("ml_in_alerts", f"with {ALERTS} select alert_id, rule_id, title, severity, source from alerts where starts_with(rule_id, 'ml_')")(lambda tel: daily_alerts(tel).where(col("rule_id").startswith("ml_")).select("alert_id", "rule_id", "title", "severity", "source"))
pair("alert_dismissed", f"with {ALERTS} select alert_id from alerts where seq % 4 <> 0")(lambda tel: (lambda rows: alerts.dismissed(rows, rows.where("seq % 4 = 0")).select("alert_id"))(daily_alerts(tel)))
pair("alert_cleared", f"with {ACKED} select alert_id from acked where not acknowledged")(lambda tel: alerts.cleared(acked(tel)).select("alert_id"))
pair("alert_blocked_view", f"with {ACKED} select alert_id from acked where seq % 3 = 0 or seq % 5 = 1")(
    lambda tel: alerts.views(acked(tel).withColumns({"action": F.when(col("seq") % 3 == 0, "Blocked").otherwise("seen"), "blocked_by": F.when(col("seq") % 5 == 1, "WAF").otherwise("")})).where("view = 'blocked'").select("alert_id")
)
pair("last_n_reversed", f"with {ALERTS} select alert_id, seq from alerts order by seq desc, alert_id limit 50")(lambda tel: daily_alerts(tel).orderBy(F.desc("seq"), "alert_id").limit(50).select("alert_id", "seq"))

# Requests to the models, and their sector layer.
_REQUEST = f"""{TEL}, made as (select *, case when seq % 6 = 0 then 'urban' end as pd, case when seq % 4 = 0 then (seq % 90)::double end as sc, case when seq % 3 = 0 then [seq::double, 2.0::double] else []::double[] end as sd from tel)"""


def requested(tel: DataFrame) -> DataFrame:
    return rules.model_request(tel.withColumns({"payload_domain": F.when(col("seq") % 6 == 0, "urban"), "syn_count": F.when(col("seq") % 4 == 0, (col("seq") % 90).cast("double")), "sensor_data": F.when(col("seq") % 3 == 0, F.array(col("seq").cast("double"), lit(2.0)))}))


pair("model_request", f"with {_REQUEST} select event_id, coalesce(pd, domain, 'general') as sector, coalesce(nullif(query, ''), nullif(username, ''), '') as text, sd as sensor_data, coalesce(requests, 0) * 100.0::double as rate, coalesce(sc, network, 0.0)::double as syn, coalesce(requests, 5)::double as number from made")(
    lambda tel: requested(tel).select("event_id", "sector", "text", "sensor_data", "rate", "syn", "number")
)
pair("sector_verdict", f"""with {VERDICT} select v.event_id, case when v.status = 'blocked' then 'blocked' when v.sector = 'agriculture' and v.seq % 5 = 0 then 'isolated' when v.sector = 'healthcare' and v.seq % 10 > 7 then 'quarantined' else 'allowed' end as status,
 case when v.status = 'blocked' then 'critical' when v.sector = 'agriculture' and v.seq % 5 = 0 then 'medium' when v.sector = 'healthcare' and v.seq % 10 > 7 then 'critical' else 'low' end as threat_level, case when v.status = 'blocked' then v.source when v.sector = 'agriculture' and v.seq % 5 = 0 then 'Agri-Guardian' end as source from verdicts v""")(
    lambda tel: rules.layered_verdict(rules.model_request(tel), tel.select("event_id", (col("seq") % 5 == 0).alias("agri_attack"), (col("seq") % 10 / 10.0).alias("health_probability"))).select("event_id", "status", "threat_level", "source")
)
pair("sector_hits", f"with {VERDICT} select event_id, 'ml_network_shield' as rule_id, 'ML: AI Detection' as rule_name, 'critical' as severity, 0.85::double as confidence from verdicts where status <> 'blocked' and sector = 'healthcare' and seq % 10 > 7")(
    lambda tel: rules.model_hits(rules.layered_verdict(rules.model_request(tel), tel.select("event_id", lit(False).alias("agri_attack"), (col("seq") % 10 / 10.0).alias("health_probability"))).where("status = 'quarantined'")).select("event_id", "rule_id", "rule_name", "severity", "confidence")
)
pair("column_alignment", f"with {TEL} select event_id, 0.0::double as flow, coalesce(memory, 0.0::double) as memory, coalesce(cpu, 0.0::double) as cpu, coalesce(requests, 0)::double as requests from tel")(lambda tel: features.aligned(tel, ("flow", "memory", "cpu", "requests"), ("event_id",)))
pair("label_encoded", f"with {TEL} select event_id, (dense_rank() over (order by event_type) - 1)::bigint as event_type, (dense_rank() over (order by service) - 1)::bigint as service from tel")(lambda tel: features.encoded(tel.select("event_id", "event_type", "service"), "event_type", "service"))
pair("minmax_inverse", f"with {TEL}, s as (select event_id, (network - min(network) over (partition by domain)) / (max(network) over (partition by domain) - min(network) over (partition by domain)) as x from tel where network is not null) select event_id, x * (500.0::double - 20.0::double) + 20.0::double as back from s")(
    lambda tel: features.min_max(tel.where("network is not null"), "domain", "network").select("event_id", features.inverse_min_max(col("network_scaled"), lit(20.0), lit(500.0)).alias("back"))
)
pair("class_balance", f"with {TEL}, c as (select (event_type = 'auth_failure')::int as label from tel) select label, count(*) as n, count(*) / (select count(*) from c)::double as share from c group by label")(lambda tel: dashboard.class_balance(tel.select((col("event_type") == "auth_failure").cast("int").alias("label")), "label"))
pair("epoch_loss", f"with {TEL} select seq % 10 as epoch, avg(cpu / (1 + seq % 10)) as mean_loss from tel where cpu is not null group by 1")(lambda tel: dashboard.epoch_loss(tel.where("cpu is not null").select((col("seq") % 10).alias("epoch"), (col("cpu") / (1 + col("seq") % 10)).alias("loss"))))
pair("training_concat", f"with {TEL}, t as (select cpu as x, 0 as label from tel where cpu is not null union all select 255.0::double, 1 from tel where seq % 3 = 0 and cpu is not null) select label, count(*) as n, sum(x) as total from t group by label")(
    lambda tel: (lambda rows: rows.select("x", lit(0).alias("label")).unionByName(rows.where("seq % 3 = 0").select(lit(255.0).alias("x"), lit(1).alias("label"))).groupBy("label").agg(F.count(lit(1)).alias("n"), F.sum("x").alias("total")))(tel.where("cpu is not null").select(col("cpu").alias("x"), "seq"))
)


def _vectors(length: int) -> tuple[str, Callable[[DataFrame], DataFrame]]:
    sector = {20: "healthcare", 10: "urban"}[length]
    sql = f"with {TEL}, w as (select event_id, list(network) over (partition by domain order by seq rows between {length - 1} preceding and current row) as v from tel where network is not null and domain = '{sector}') select event_id, v as steps from w where len(v) = {length}"
    made = lambda tel: features.sequences(tel.where(f"network is not null and domain = '{sector}'"), "domain", "seq", "network", length).select(text("evt-", number(col("seq"))).alias("event_id"), "steps")
    return sql, made


for _n in (20, 10):
    _sql, _made = _vectors(_n)
    pair(f"last_{_n}_vectors", _sql)(_made)

# Windows.
_CATEGORY = f"c as (select event_id, source_ip, ts_us, seq, {switch(['{!r}'.format(c) for c in perimeter.LIMITS], 3)} as category from tel)"
pair("limiter_first_category", f"""with {TEL}, {_CATEGORY}, f as (select *, {chain("first_value(category) over (partition by source_ip order by ts_us, seq)", {'default': 4, 'api': 3, 'auth': 2}, 'null')} as lim, count(*) {window(DAY)} as n from c) select event_id, n, lim as "limit" from f where n > lim""")(
    lambda tel: windows.over_limit(tel.select("event_id", "source_ip", "ts_us", "seq", pick(3, *[lit(c) for c in perimeter.LIMITS]).alias("category")), {"default": 4, "api": 3, "auth": 2}, DAY).select("event_id", "n", "limit")
)
pair("failures_since_success", f"""with {TEL}, a as (select source_ip, ts_us, seq, event_type = 'auth_attempt' and coalesce(success, false) as ok from tel where event_type in ('auth_failure', 'auth_attempt')), g as (select *, sum(ok::int) over (partition by source_ip order by ts_us, seq rows unbounded preceding) as run from a)
 select source_ip, seq, count(*) over (partition by source_ip, run order by ts_us range between {DAY * 1_000_000 - 1} preceding and current row) as n from g where not ok""")(
    lambda tel: windows.since_success(tel.where("event_type in ('auth_failure', 'auth_attempt')").select("source_ip", "ts_us", "seq", ((col("event_type") == "auth_attempt") & F.coalesce("success", lit(False))).alias("success")), DAY).select("source_ip", "seq", "n")
)
pair("agent_flood", f"""with recursive {TEL}, s as (select source_ip, ts_us, seq, row_number() over (partition by source_ip order by ts_us, seq) as rn from tel), r as (
 select source_ip, seq, rn, [ts_us] as times, null::bigint as until, false as limited from s where rn = 1
 union all select x.source_ip, x.seq, x.rn, x.times, case when x.held then x.until when len(x.times) > 4 then x.ts_us + {DAY * 2 * 1_000_000} end, x.held or len(x.times) > 4 from (
  select s.source_ip, s.seq, s.rn, s.ts_us, r.until, coalesce(s.ts_us <= r.until, false) as held, case when coalesce(s.ts_us <= r.until, false) then r.times else list_append(list_filter(r.times, lambda t: s.ts_us - t < {DAY * 1_000_000}), s.ts_us) end as times from r join s on s.source_ip = r.source_ip and s.rn = r.rn + 1) x)
 select source_ip, seq, limited from r""")(lambda tel: perimeter.agent_flood(tel.select("source_ip", "ts_us", "seq"), DAY, 4, 2 * DAY).select("source_ip", "seq", "limited"))
SQL["block_lifecycle"] = f"""with recursive {TEL}, c as (select source_ip as ip, ts_us, seq, case when seq % 5 = 0 then 'unblock' else 'block' end as op, {switch([q(s) for s in joins.DURATIONS], 4)} as severity,
 case when seq % 9 = 0 then 0 else ts_us + 86400000000 end as until, row_number() over (partition by source_ip order by ts_us, seq) as rn from tel where event_type = 'auth_failure'),
 r as (select ip, 0::bigint as ts_us, 0::bigint as seq, 0::bigint as rn, ''::varchar as action, null::bigint as expires_us, 0::bigint as blocks, 'low' as severity from c where rn = 1
 union all select ip, ts_us, seq, rn, concat_ws(',', case when over then 'auto_unblock' end, case when op = 'block' then case when e is null then 'block' else 'extend_block' end when e is not null then 'unblock' end),
  case when op = 'block' then case when e is null then until else greatest(e, until) end end, case when op = 'block' then case when e is null then 1 else blocks + 1 end else blocks end,
  case when op <> 'block' then s0 when e is null then s1 when list_position(['low', 'medium', 'high', 'critical'], s1) > list_position(['low', 'medium', 'high', 'critical'], s0) then s1 else s0 end
  from (select c.ip, c.ts_us, c.seq, c.rn, c.op, c.until, c.severity as s1, r.severity as s0, r.blocks, r.expires_us is not null and r.expires_us <> 0 and c.ts_us > r.expires_us as over,
   case when r.expires_us is not null and not (r.expires_us <> 0 and c.ts_us > r.expires_us) then r.expires_us end as e from r join c on c.ip = r.ip and c.rn = r.rn + 1) x)
 select ip, ts_us, seq, action, expires_us, blocks, severity from r where rn > 0"""

# Counts.
pair("health_counts", f"with {ALERTS}, {NODES} select 'events' as name, count(*) as n from tel union all select 'alerts', count(*) from alerts union all select 'nodes', count(*) from nodes")(lambda tel: dashboard.health_counts(events=tel, alerts=daily_alerts(tel), nodes=nodes(tel)))
pair("online_fraction", f"with {TEL}, {NODES} select count(*) filter (status = 'online') as online, count(*) as total, count(*) filter (status = 'online') || '/' || count(*) as text from nodes")(lambda tel: joins.online_fraction(nodes(tel)))
# Commands, lists and histories.
OPS = ["'block'", "'unblock'", "'isolate'", "'throttle'", "'block'", "'restore'", "'unthrottle'", "'isolate'", "'block'"]


def command_rows(tel: DataFrame) -> DataFrame:
    return tel.select("seq", F.when(col("seq") % 500 == 499, "reset").otherwise(pick(9, *[lit(o.strip("'")) for o in OPS])).alias("op"), text("t", number(F.floor(col("seq") / 9) % 11)).alias("target"))


_KINDS = {op: on for on, (off, *_) in commands.PAIRS.items() for op in (on, off)}
_STATUS = " ".join(f"when '{on}' then case when before = '{on}' then '{again}' else '{done}' end when '{off}' then case when before = '{on}' then '{undone}' else '{nothing}' end" for on, (off, done, again, undone, nothing) in commands.PAIRS.items())
pair("manual_commands", f"""with {TEL}, c as (select seq, case when seq % 500 = 499 then 'reset' else {switch(OPS, 9)} end as op, 't' || (seq // 9) % 11 as target from tel), e as (select *, coalesce(sum((op = 'reset')::int) over (order by seq rows between unbounded preceding and 1 preceding), 0) as epoch, {chain('op', _KINDS, q('reset'))} as kind from c),
 b as (select *, lag(op) over (partition by kind, epoch, target order by seq) as before from e) select seq, op, target, case op {_STATUS} else 'reset' end as status from b""")(lambda tel: commands.manual(command_rows(tel)))
pair("blocked_everywhere", f"with {TEL} select distinct source_ip as ip from tel where event_type = 'auth_failure' or seq % 50 = 0")(lambda tel: (lambda t: commands.blocked_everywhere(t.where("event_type = 'auth_failure'"), t.where("seq % 50 = 0")))(tel.withColumn("ip", col("source_ip"))))
pair("history_append", f"with {TEL}, h as (select service as name, max(seq) as seq from tel where seq % 2 = 0 and service < 'node-3' group by 1), f as (select service as name, min(seq) as seq from tel group by 1) select * from h union all select * from f where name not in (select name from h)")(
    lambda tel: (lambda t: commands.appended(t.where("seq % 2 = 0 and name < 'node-3'").groupBy("name").agg(F.max("seq").alias("seq")), t, "name"))(tel.select(col("service").alias("name"), "seq"))
)
pair("set_members", f"with {TEL} select source_ip as name from tel group by 1 having arg_max(seq % 3 <> 0, seq)")(lambda tel: commands.members(tel.select(col("source_ip").alias("name"), "seq", (col("seq") % 3 != 0).alias("present"))))
KINDS = ["blocked_ip", "rate_limit", "sql_injection", "brute_force", "flooding"]
_DETAILS = """case kind when 'blocked_ip' then '{"original_block_reason":"abuse"}' when 'rate_limit' then '{"rate":"' || rate || '","limit":"100"}' when 'sql_injection' then '{"pattern_matched":"' || left(repeat('x', (seq % 80)::int), 50) || '"}' when 'brute_force' then '{"attempt_count":"' || seq % 12 || '"}' else '{"rate":"' || rate || '"}' end"""
pair("dropped_writes", f"""with {TEL}, d as (select source_ip, {switch([q(k) for k in KINDS], 6)} as kind, case when seq % 2 = 0 then 'low' end as severity, seq % 40 + 0.5::double as rate, ts_us, seq from tel)
 select source_ip, kind as attack_type, case when kind = 'rate_limit' then 'rate-limited' else 'blocked' end as reason, '/x' as endpoint, 'GET' as method, case when kind = 'rate_limit' then 'medium' else coalesce(severity, case kind when 'flooding' then 'critical' else 'high' end) end as severity, {_DETAILS} as details, ts_us, seq from d where kind is not null""")(
    lambda tel: actions.dropped_writes(tel.select("source_ip", pick(6, *[lit(k) for k in KINDS]).alias("kind"), lit("/x").alias("path"), lit("GET").alias("method"), F.when(col("seq") % 2 == 0, "low").alias("severity"), F.repeat(lit("x"), (col("seq") % 80).cast("int")).alias("pattern"), (col("seq") % 12).alias("attempts"), (col("seq") % 40 + 0.5).alias("rate"), lit(100).alias("block_limit"), lit("abuse").alias("block_reason"), "ts_us", "seq"))
)


@over("detection_reports")
def _(tel: DataFrame) -> DataFrame:
    rows = tel.where("event_type in ('auth_failure', 'auth_attempt')")
    return perimeter.reports(rows.select(text("10.0.0.", number(col("seq") % 16)).alias("ip"), (col("ts_us") / 40).cast("bigint").alias("ts_us"), "seq", F.when(col("seq") % 11 == 0, "threat").otherwise("auth").alias("op"), "username", F.coalesce("success", lit(False)).alias("success"), lit(25).alias("points")))


# Feeds.
pair("batch_items", f"""with {TEL} select seq // 4 as batch_id, (seq % 4)::int as index, seq % 5 <> 0 as ok, case when seq % 5 <> 0 then event_id end as event_id, case when seq % 5 = 0 then 'not an event: {{"event_id":"' || event_id || '"}}' end as error from tel where seq // 4 * 4 + 3 <= (select max(seq) from tel) and seq >= 4""")(
    lambda tel: telemetry.batch(
        tel.where("seq >= 4").groupBy(F.floor(col("seq") / 4).alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("seq", F.when(col("seq") % 5 == 0, F.to_json(F.struct("event_id"))).otherwise(F.to_json(F.struct("event_id", "source_ip", "event_type"))).alias("j")))).alias("l")).where(F.size("l") == 4)
        .select("batch_id", text("[", F.array_join(F.transform("l", lambda x: x["j"]), ","), "]").alias("body"))
    ).select("batch_id", "index", "ok", col("event.event_id").alias("event_id"), "error")
)
pair("topic_counts", f"with {ALERTS}, {NODES} select 'telemetry' as topic, count(*) as n from tel union all select 'alert', count(*) from alerts union all select 'node_registered', count(*) from nodes union all select 'device:status', count(*) from nodes union all select 'attack_routed', count(*) from tel t join nodes n on t.domain = n.sector and n.status = 'online' where t.event_type = 'auth_failure'")(
    lambda tel: topics(tel).groupBy("topic").agg(F.count(lit(1)).alias("n"))
)


def topics(tel: DataFrame) -> DataFrame:
    """(topic, body) of what subscribers hear of events, alerts, nodes and routed attacks."""
    told = {"telemetry": tel.select("event_id", "service"), "alert": daily_alerts(tel).select("alert_id", "title", "severity"), "node_registered": nodes(tel).select("node_id", "sector"), "device:status": nodes(tel).select("node_id", "status"), "attack_routed": joins.route_attacks(tel.where("event_type = 'auth_failure'"), nodes(tel))}
    out = None
    for topic, rows in told.items():
        one = rows.select(lit(topic).alias("topic"), F.to_json(F.struct("*")).alias("body"))
        out = one if out is None else out.unionByName(one)
    return out


pair("scenario_replay", "select step, (1000000000 + o * 1000000)::bigint as ts_us from (values ('probe', 0.0), ('login', 1.5), ('inject', 4.0), ('flood', 8.5)) t(step, o)", lambda s, _: s.createDataFrame([("probe", 0.0), ("login", 1.5), ("inject", 4.0), ("flood", 8.5)], "step string, offset_s double"))(lambda steps: telemetry.replayed(1_000_000_000, steps).select("step", "ts_us"))
pair("metric_walk", f"""with {TEL}, d as (select service, list(cpu order by ts_us, seq) as xs from tel where cpu is not null group by service) select service, list_reduce(xs, lambda a, x: a + (x - a) * 0.3::double, 50.0::double) as level from d""")(
    lambda tel: folds.walk(tel.where("cpu is not null").select("service", "ts_us", "seq", "cpu"), "service", "cpu", 50.0, 0.3).groupBy("service").agg(F.max_by("level", F.struct("ts_us", "seq")).alias("level"))
)
