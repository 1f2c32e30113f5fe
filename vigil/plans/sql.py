"""SQL of the catalog's queries, for a second engine on the same tables."""

from __future__ import annotations

from vigil.operators import actions, alerts, dashboard, joins, rules

HOUR = 3_600_000_000


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def first_index(column: str, patterns: tuple[str, ...]) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, {q('(?i)' + p)}) then {i}" for i, p in enumerate(patterns)) + " end"


def first_part(column: str, parts: tuple[str, ...]) -> str:
    return "case " + " ".join(f"when contains(lower({column}), {q(p)}) then {q(p)}" for p in parts) + " end"


def chain(column: str, pairs: dict[str, object], other: str) -> str:
    return f"case {column} " + " ".join(f"when {q(k)} then {q(v) if isinstance(v, str) else v}" for k, v in pairs.items()) + f" else {other} end"


IPV4 = "regexp_full_match({c}, '0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.]0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}') and not regexp_matches('.' || {c} || '.', '[.][.]')"

TEL = """tel as (select 'evt-' || event_id as event_id, '10.0.' || cast(floor(user_id / 256) as bigint) || '.' || user_id % 256 as source_ip,
 case user_id % 4 when 0 then 'healthcare' when 1 then 'agriculture' when 2 then 'urban' else 'general' end as domain, 'node-' || user_id % 12 as service,
 case event_type when 'error' then 'auth_failure' when 'signup' then 'auth_attempt' when 'click' then 'telemetry' when 'view' then 'http_request' else 'database_query' end as event_type,
 case when event_type = 'click' then least(value, 100.0) end as cpu, case when event_type = 'click' then cast(json_extract_string(props, '$.k') as double) end as memory,
 case when event_type = 'click' then value * 5 end as network, case when event_type = 'click' then cast(json_extract_string(props, '$.k') as bigint) end as requests,
 case when event_type in ('view', 'purchase') then case event_id % 9 when 0 then '1 OR 1=1 --' when 1 then 'admin''--' when 2 then '<script>alert(1)</script>' else 'q=' || event_id end end as query,
 case when event_type in ('error', 'signup') then case when event_id % 23 = 0 then 'root'' or 1=1 --' else 'user-' || user_id % 50 end end as username,
 case when event_type = 'signup' then event_id % 3 = 0 end as success, epoch_us(ts) as ts_us, event_id as seq from events)"""

HIT = "event_id, {r} as rule_id, {n} as rule_name, {s} as severity, {c}::double as confidence, source_ip, {v} as service, {x}::double as value, {d} as detail, ts_us, seq"
_SQLI_N = f"((({first_index('query', rules.SQL_PATTERNS)}) is not null)::int + (({first_index('username', rules.SQL_PATTERNS)}) is not null)::int)"
_SQLI_D = f"nullif(concat_ws(', ', case when ({first_index('query', rules.SQL_PATTERNS)}) is not null then 'query' end, case when ({first_index('username', rules.SQL_PATTERNS)}) is not null then 'username' end), '')"


def hit(rule: str, name: str, severity: str, confidence: str, value: str, service: str = "service", detail: str = "null::varchar") -> str:
    return HIT.format(r=q(rule), n=name, s=severity, c=confidence, v=service, x=value, d=detail)


FAILED = "event_type = 'auth_failure' or (event_type = 'auth_attempt' and not coalesce(success, true))"
SQLI = f"select {hit('sql_injection', q('SQL Injection Detection'), q('critical'), '0.85', 'n', detail='d')} from (select *, {_SQLI_N} as n, {_SQLI_D} as d from tel) where n > 0"
CPU = f"select {hit('high_cpu', q('High CPU Usage'), 'case when cpu < 95 then ' + q('warning') + ' else ' + q('critical') + ' end', '0.95', 'cpu')} from tel where cpu > 85"
MEMORY = f"select {hit('high_memory', q('High Memory Usage'), q('critical'), '0.95', 'memory')} from tel where memory > 90"
NETWORK = f"select {hit('high_network', q('Network Traffic Spike'), q('warning'), '0.8', 'network')} from tel where network > 900"


def window(seconds: int) -> str:
    return f"over (partition by source_ip order by ts_us range between {seconds * 1_000_000 - 1} preceding and current row)"


def spike(seconds: int, over: int) -> str:
    return f"select {hit('rate_spike', q('Abnormal Request Rate'), q('warning'), '0.75', 'n', 'null::varchar')} from (select *, count(*) {window(seconds)} as n from tel) where n > {over}"


def brute(seconds: int, least: int) -> str:
    return f"select {hit('brute_force', q('Brute Force Attack'), q('critical'), '0.9', 'n', 'null::varchar', 'username')} from (select *, count(*) {window(seconds)} as n from tel where {FAILED}) where n >= {least}"


VERDICT = f"""{TEL}, req as (select event_id, domain as sector, coalesce(nullif(query, ''), nullif(username, ''), '') as text, coalesce(requests, 0) * 100.0::double as rate, coalesce(network, 0.0) as syn, coalesce(requests, 5)::double as number, source_ip, service, ts_us, seq from tel),
 reasons as (select *, (rate > 5000)::int + (syn > 50)::int + (number > 60)::int as n, ({first_part('text', rules.GATEKEEPER_PARTS)}) is not null as web from req),
 verdicts as (select event_id, sector, case when web or n > 0 then 'blocked' else 'allowed' end as status, case when web or n > 0 then 'critical' else 'low' end as threat_level,
 case when web then 'Web Gatekeeper' when n > 0 then 'Network Shield' end as source, case when web then 0.99::double when n > 0 then least(0.5::double + n * 0.15::double, 1.0::double) end as score, source_ip, service, ts_us, seq from reasons)"""

ML = "select event_id, 'ml_' || replace(lower(source), ' ', '_') as rule_id, 'ML: ' || source as rule_name, threat_level as severity, score as confidence, source_ip, service, null::double as value, null::varchar as detail, ts_us, seq from verdicts where status = 'blocked'"


def hits(rate_s: int = 86400, over: int = 8, brute_s: int = 86400, least: int = 5) -> str:
    return f"{VERDICT}, hits as ({' union all '.join((SQLI, spike(rate_s, over), CPU, MEMORY, NETWORK, brute(brute_s, least), ML))})"


TEMPLATES = "templates(rule_id, title, template_severity) as (values " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in alerts.TEMPLATES) + ")"
ALERTS = f"""{hits()}, {TEMPLATES}, alerts as (select sha256(event_id || '|' || h.rule_id) as alert_id, event_id, h.rule_id, coalesce(title, rule_name) as title,
 case when starts_with(h.rule_id, 'ml_') or severity = 'critical' or template_severity is null then severity else template_severity end as severity,
 case when starts_with(h.rule_id, 'ml_') then 'Unknown' else coalesce(nullif(service, ''), nullif(source_ip, ''), 'Unknown') end as source, source_ip, service, value, detail, ts_us, seq from hits h left join templates t on h.rule_id = t.rule_id)"""
ACKED = f"{ALERTS}, acked as (select *, seq % 5 = 0 as acknowledged from alerts)"

_PLAYS = ", ".join(f"({q(r)}, {i}, {q(a)})" for r, xs in actions.PLAYBOOKS.items() for i, a in enumerate(xs))
ACTIONS = f"""{ALERTS}, plays(rule_id, step, action) as (values {_PLAYS}),
 steps as (select a.*, coalesce(p.step, 0) as step, coalesce(p.action, 'alert_only') as action from alerts a left join plays p on a.rule_id = p.rule_id),
 aimed as (select *, case when action = 'alert_only' then 'operators' when action = 'isolate_service' then case when starts_with(rule_id, 'ml_') then source else coalesce(service, source) end
   when rule_id in ('sql_injection', 'brute_force', 'rate_spike') and {IPV4.format(c='source_ip')} and not starts_with(source_ip, '127.') then source_ip else 'unknown' end as target from steps),
 acted as (select alert_id, rule_id, step, action, target,
   case when action in ('block_ip', 'isolate_service') and row_number() over (partition by action, target order by seq, alert_id, step) > 1 then 'skipped' else 'success' end as status, severity, ts_us, seq
   from aimed where target <> 'unknown')"""
DROPPED = f"""{ALERTS}, pairs(rule_id, attack_type) as (values {', '.join(f'({q(a)}, {q(b)})' for a, b in actions.DROPPED.items())}),
 dropped as (select alert_id, attack_type, source_ip, '/unknown' as endpoint, case when attack_type = 'flooding' then 'GET' else 'POST' end as method,
 case when severity in ('low', 'medium', 'high', 'critical') then severity else 'high' end as severity, 0::bigint as attempt_count, ts_us, seq from alerts join pairs using (rule_id))"""

BLOCKS = f"""{TEL}, blocks as (select source_ip as ip, case seq % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as severity, ts_us from tel where event_type = 'auth_failure'),
 ends as (select ip, ts_us, ts_us + ({chain('severity', joins.DURATIONS, '300')})::bigint * 96000000 as end_us from blocks),
 runs as (select *, coalesce(ts_us > max(end_us) over (partition by ip order by ts_us, end_us rows between unbounded preceding and 1 preceding), true)::int as fresh from ends),
 numbered as (select *, sum(fresh) over (partition by ip order by ts_us, end_us) as run from runs),
 intervals as (select ip, min(ts_us) as start_us, max(end_us) as end_us from numbered group by ip, run)"""

NODES = """nodes as (select *, row_number() over (order by node_id) as registered_seq from (select service as node_id, max(ts_us) as last_seen, arg_max(domain, (ts_us, seq)) as sector,
 case when 1706572800000000 - max(ts_us) > 3600000000 then 'offline' else 'online' end as status from tel group by service))"""

_HALF = lambda x, s: f"floor({x} * {s}.0::double + 0.5) / {s}.0::double"
CHART = f"""{TEL}, chart as (select service as device, 'Node ' || substr(service, 6) as device_name, ts_us, seq, {_HALF('coalesce(cpu, 50.0)', 10)} as cpu, {_HALF('coalesce(memory, 50.0)', 10)} as memory,
 {_HALF('coalesce(network, 100.0)', 1)} as network, coalesce(requests, 100) as requests, strftime(make_timestamp(ts_us), '%H:%M:%S') as label from tel)"""


def greedy(key: str, source: str, us: int) -> str:
    """CTEs that keep rows of source (key columns, t, id) at least `us` after the last kept one."""
    keys = [k.strip() for k in key.split(",")]
    same = " and ".join(f"s.{k} = r.{k}" for k in keys)
    listed = ", ".join(f"s.{k}" for k in keys)
    return f"""s as ({source}), r as (select {key}, t, id from (select *, row_number() over (partition by {key} order by t, id) as rn from s) where rn = 1
 union all select * from (select distinct on ({', '.join('r.' + k for k in keys)}) {listed}, s.t, s.id from r join s on {same} and s.t >= r.t + {us} order by {', '.join('r.' + k for k in keys)}, s.t, s.id))"""


_SCORE = chain("severity", dashboard.SCORES, "10")

SQL: dict[str, str] = {
    "ingest_normalize": f"""with {TEL}, raw as (select case when seq % 7 = 0 then '' else event_id end as event_id, source_ip, case when seq % 5 = 0 then null else domain end as domain, service, event_type, case when seq % 11 = 0 then 0 else ts_us // 1000000 end as timestamp, case when seq % 4 > 0 then '{{"k": ' || seq || '}}' end as payload from tel)
 select coalesce(nullif(event_id, ''), sha256(source_ip || '|' || service || '|' || event_type || '|' || timestamp)) as event_id, source_ip, coalesce(domain, 'general') as domain, service, event_type, coalesce(nullif(timestamp, 0), 1710000000)::bigint as timestamp, 1710000000::bigint as received_at, coalesce(payload, '{{}}') as payload from raw""",
    "events_page": f"with {TEL} select event_id, seq from tel order by seq desc limit 50 offset 20",
    "events_ring_1000": f"with {TEL} select event_id, seq from tel order by seq desc limit 1000",
    "client_ip_resolve": f"""with {TEL}, h as (select event_id, case when seq % 3 = 0 then ' 203.0.113.' || seq % 200 || ' , 10.0.0.1' when seq % 3 = 1 then '' end as xff, case when seq % 2 = 0 then ' 198.51.100.' || seq % 90 end as xri, case when seq % 5 = 0 then '192.0.2.7' end as cf, case when seq % 7 = 0 then '' else source_ip end as peer from tel)
 select event_id, coalesce(case when xff <> '' then trim(string_split(xff, ',')[1]) end, case when xri <> '' then trim(xri) end, case when cf <> '' then trim(cf) end, nullif(peer, ''), 'unknown') as client_ip from h""",
    "source_ip_resolve": f"""with {TEL}, h as (select event_id, case seq % 4 when 0 then 'unknown' when 1 then '127.0.0.1' when 2 then '' else source_ip end as a, case when seq % 3 = 0 then source_ip when seq % 3 = 1 then 'localhost' end as b from tel)
 select event_id, coalesce(case when a <> '' and a not in ('unknown', 'Unknown', '127.0.0.1', 'localhost') then a end, case when b <> '' and b not in ('unknown', 'Unknown', '127.0.0.1', 'localhost') then b end, nullif(a, ''), 'unknown') as resolved from h""",
    "attacker_ip_extract": f"""with {TEL}, h as (select event_id, case seq % 4 when 0 then '127.0.0.9' when 1 then '999.1.1.1' when 2 then '' end as a, case when seq % 3 > 0 then source_ip else '::1' end as b from tel)
 select event_id, coalesce(case when {IPV4.format(c='a')} and not starts_with(a, '127.') then a end, case when {IPV4.format(c='b')} and not starts_with(b, '127.') then b end, 'unknown') as attacker from h""",
    "evidence_ip": f"""with {TEL}, h as (select event_id, case seq % 4 when 0 then 'unknown' when 1 then '' when 2 then 'Unknown' end as a, case when seq % 3 > 0 then source_ip end as b from tel)
 select event_id, coalesce(case when a <> '' and a not in ('unknown', 'Unknown') then a end, case when b <> '' and b not in ('unknown', 'Unknown') then b end, 'unknown') as ip from h""",
    "ipv4_validity": f"""with {TEL}, h as (select event_id, case seq % 6 when 0 then source_ip when 1 then source_ip || '.1' when 2 then '256.1.1.1' when 3 then '1..2.3' when 4 then 'a.b.c.d' else '010.000.255.1' end as ip from tel)
 select event_id, ip, {IPV4.format(c='ip')} as valid, ip in ('127.0.0.1', 'localhost', '::1') or starts_with(ip, '127.') as protected from h""",
    "rule_sqli_matches": f"""with {TEL}, f as (select event_id, 'query' as field, query as text from tel union all select event_id, 'username', username from tel)
 select event_id, field, pattern, left(text, 100) as value from (select *, {first_index('text', rules.SQL_PATTERNS)} as pattern from f) where pattern is not null""",
    "rule_sqli_pages": f"select page_id, part from (select page_id, {first_part('html', rules.SQL_PARTS)} as part from pages) where part is not null",
    "rule_xss_pages": f"select page_id, part from (select page_id, {first_part('html', rules.XSS_PARTS)} as part from pages) where part is not null",
    "rule_agent_sqli": f"with {TEL} select event_id, query from tel where regexp_matches(query, {q('(?i)' + '|'.join(rules.AGENT_PATTERNS))})",
    "threat_classify": f"""select page_id, case when x is not null then 'xss' when s is not null then 'sql_injection' when p is not null then 'path_injection' end as kind, coalesce(p, x, s) as pattern from (
 select page_id, {first_part("regexp_extract(url, '[?](.*)$', 1)", rules.SQL_PARTS)} as s, {first_part("regexp_extract(url, '[?](.*)$', 1)", rules.XSS_PARTS)} as x, coalesce({first_part('url', rules.SQL_PARTS)}, {first_part('url', rules.XSS_PARTS)}) as p from pages) where coalesce(p, x, s) is not null""",
    "rule_high_cpu": f"with {TEL} {CPU}",
    "rule_high_memory": f"with {TEL} {MEMORY}",
    "rule_high_network": f"with {TEL} {NETWORK}",
    "rule_rate_spike_24h": f"with {TEL} {spike(86400, 8)}",
    "rule_brute_force_24h": f"with {TEL} {brute(86400, 5)}",
    "brute_force_cooldown": f"with recursive {TEL}, b as ({brute(86400, 3)}), {greedy('source_ip', 'select source_ip, ts_us as t, seq as id from b', 6 * HOUR)} select source_ip, t as ts_us, id as seq from r",
    "all_rules": f"with {hits()} select * from hits",
    "rule_hit_counts": f"with {hits()} select rule_id, severity, count(*) as hits from hits group by rule_id, severity",
    "dashboard_rules": f"""with {TEL}, d as (select 'rule-cpu-high' as rule, service as device, 'warning' as severity, ts_us, seq from tel where cpu > 85 union all select 'rule-mem-critical', service, 'critical', ts_us, seq from tel where memory > 90
 union all select 'rule-net-spike', service, 'warning', ts_us, seq from tel where network > 800 union all select 'rule-req-flood', service, 'warning', ts_us, seq from tel where requests > 400) select * from d""",
    "network_heuristics": f"with {VERDICT} select event_id, n::int as reasons, least(0.5::double + n * 0.15::double, 1.0::double) as score from reasons where n > 0",
    "layered_verdict": f"with {VERDICT} select event_id, sector, status, threat_level, source, score from verdicts",
    "ml_anomalies": f"with {VERDICT} {ML}",
    "alerts": f"with {ALERTS} select * from alerts",
    "alert_descriptions": f"""with {ALERTS} select alert_id, rule_id, case rule_id
 when 'sql_injection' then 'Malicious SQL injection patterns detected in ' || coalesce(detail, 'unknown field') || '. Source IP: ' || coalesce(source_ip, 'unknown') || '. This could be an attempt to extract or manipulate database data.'
 when 'rate_spike' then 'Abnormal request rate detected: ' || value::bigint || ' requests from ' || coalesce(source_ip, 'unknown') || ' in the last minute. This could indicate a DDoS attack or aggressive scraping.'
 when 'high_cpu' then 'CPU utilization at ' || value || '% on ' || coalesce(service, 'unknown') || '. High CPU may cause service degradation or indicate a runaway process.'
 when 'high_memory' then 'Memory usage at ' || value || '% on ' || coalesce(service, 'unknown') || '. Critical memory pressure may cause service crashes or system instability.'
 when 'high_network' then 'Network traffic spike detected at ' || value || ' KB/s. This could indicate data exfiltration or a flood attack.'
 when 'brute_force' then 'Multiple failed authentication attempts (' || value::bigint || ') from ' || coalesce(source_ip, 'unknown') || ' targeting user ''' || coalesce(detail, 'unknown') || '''. Possible credential stuffing or brute force attack.'
 else title end as description from alerts""",
    "alert_stats": f"with {ACKED} select count(*) as total, count(*) filter (not acknowledged) as active, count(*) filter (not acknowledged and severity = 'critical') as critical, count(*) filter (not acknowledged and severity = 'warning') as warning from acked",
    "alert_views": f"with {ACKED} select 'all' as view, alert_id from acked union all select case when acknowledged then 'acknowledged' else 'active' end, alert_id from acked union all select 'ml', alert_id from acked where starts_with(rule_id, 'ml_') or contains(title, 'ML:')",
    "alert_dedup": f"with recursive {ALERTS}, {greedy('title, source', 'select title, source, ts_us as t, seq as id from alerts', HOUR)} select title, source, t as ts_us, id as seq from r",
    "dashboard_rule_cooldown": f"""with recursive {TEL}, d as (select 'rule-cpu-high' as rule, service as device, ts_us as t, seq as id from tel where cpu > 85 union all select 'rule-mem-critical', service, ts_us, seq from tel where memory > 90
 union all select 'rule-net-spike', service, ts_us, seq from tel where network > 800), {greedy('rule, device', 'select * from d', HOUR)} select rule, device, t as ts_us, id as seq from r""",
    "alert_actions": f"with {ACTIONS} select rule_id, severity, action, count(*) as steps from acted group by all",
    "playbook_actions": f"with {ACTIONS} select alert_id, rule_id, step, action, target from acted",
    "action_first_wins": f"with {ACTIONS} select action, target, count(*) filter (status = 'success') as won, count(*) filter (status = 'skipped') as skipped from acted where action in ('block_ip', 'isolate_service') group by action, target",
    "action_counts": f"with {ACTIONS} select rule_id, action, status, count(*) as n from acted group by rule_id, action, status",
    "ledger_blocks": f"""with {ACTIONS} select a.target as ip, {chain('a.rule_id', actions.BLOCK_REASONS, q('abuse'))} as reason, {chain('a.severity', actions.LEDGER_SEVERITY, q('high'))} as severity, a.ts_us from acted a where a.action = 'block_ip' and a.status = 'success'""",
    "dropped_records": f"with {DROPPED} select * from dropped",
    "dropped_stats_rollup": f"with {DROPPED} select attack_type, count(*) as dropped, case when attack_type is null then least(count(*), 500) end as recent from dropped group by rollup(attack_type)",
    "dropped_limit_then_filter": f"with {DROPPED}, n as (select * from dropped order by seq desc, alert_id limit 100) select alert_id, source_ip, seq from n where attack_type = 'brute_force'",
    "block_intervals": f"with {BLOCKS} select * from intervals",
    "blocked_request_semi": f"with {BLOCKS} select event_id, source_ip, ts_us from tel t where exists (select 1 from intervals i where i.ip = t.source_ip and t.ts_us between i.start_us and i.end_us)",
    "unblocked_request_anti": f"with {BLOCKS} select event_id, source_ip, ts_us from tel t where not exists (select 1 from intervals i where i.ip = t.source_ip and t.ts_us between i.start_us and i.end_us)",
    "rate_limit_log": f"with {TEL} select event_id, source_ip, n from (select *, count(*) {window(86400)} as n from tel) where n > 6",
    "request_rate": f"with {TEL}, w as (select event_id, ts_us, count(*) {window(3600)} as n, min(ts_us) {window(3600)} as f from tel) select event_id, n, case when n < 2 then n::double else n / greatest((ts_us - f) / 1000000.0::double, 0.1::double) end as rate from w",
    "flood_counts": f"""with {TEL}, w as (select event_id, count(*) {window(7200)} as n from tel) select event_id, n, n >= 3 as is_flood, case when n >= 3 then least(95, 70 + (n - 3) * 2) else 0 end::bigint as confidence, case when n >= 4 then 'critical' when n >= 3 then 'high' else 'low' end as severity from w""",
    "flood_ewma": """select '10.0.' || cast(floor(user_id / 256) as bigint) || '.' || user_id % 256 as source_ip, list_reduce(list(value order by ts, event_id), lambda b, x: case when b > 0 then b * 0.9::double + x * 0.1::double else x end, 0.0::double) as baseline from events group by user_id""",
    "brute_tracker": f"""with {TEL}, a as (select source_ip, ts_us, seq, service as username from tel where {FAILED}), w as (select *, count(*) {window(86400)} as n, ts_us - lag(ts_us) over (partition by source_ip order by ts_us, seq) as gap_us from a)
 select source_ip, seq, n, gap_us, n >= 5 or (coalesce(gap_us < 600000000, false) and n >= 3) as is_brute, greatest(case when n >= 5 then least(95, 60 + (n - 5) * 5) else 0 end, case when coalesce(gap_us < 600000000, false) and n >= 3 then 85 else 0 end)::bigint as confidence,
 case when (coalesce(gap_us < 600000000, false) and n >= 3) or n >= 10 then 'high' when n >= 5 then 'medium' else 'low' end as severity from w""",
    "distinct_users_running": f"""with {TEL}, a as (select source_ip, ts_us, seq, 'u' || seq % 7 as username from tel where {FAILED}), f as (select *, (row_number() over (partition by source_ip, username order by ts_us, seq) = 1)::bigint as fresh from a)
 select source_ip, seq, sum(fresh) over (partition by source_ip order by ts_us, seq rows unbounded preceding)::bigint as users from f""",
    "threat_score_running": f"with {ALERTS}, s as (select source_ip as ip, seq, rule_id, sum({_SCORE}) over (partition by source_ip order by ts_us, seq, rule_id rows unbounded preceding)::bigint as score from alerts) select ip, seq, rule_id, score, case when score >= 100 then 'block_critical' when score >= 75 then 'block_high' when score >= 50 then 'throttle' else 'monitor' end as action from s",
    "high_threat_ips": f"with {ALERTS} select source_ip as ip, sum({_SCORE})::bigint as score from alerts group by source_ip having sum({_SCORE}) >= 1000",
    "node_status": f"with {TEL}, {NODES} select node_id, sector, last_seen, status from nodes",
    "sector_online_counts": f"with {TEL}, {NODES} select count(*) filter (sector = 'healthcare' and status = 'online') as healthcare, count(*) filter (sector = 'agriculture' and status = 'online') as agriculture, count(*) filter (sector = 'urban' and status = 'online') as urban from nodes",
    "heartbeat_contains_join": f"with {TEL}, {NODES} select event_id, node_id from (select t.event_id, n.node_id, row_number() over (partition by t.event_id order by n.registered_seq) as rn from tel t join nodes n on contains(t.service, n.node_id)) where rn = 1",
    "attack_routing": f"with {TEL}, {NODES} select t.event_id, n.node_id from tel t join nodes n on t.domain = n.sector and n.status = 'online' where t.event_type = 'auth_failure'",
    "device_health": f"""with {TEL}, d as (select service as device, list(case when event_type = 'auth_failure' then case when seq % 2 = 0 then 10 else 15 end else 0 end order by ts_us, seq) as ds from tel where event_type in ('auth_failure', 'telemetry') group by service)
 select device, list_reduce(list_transform(ds, lambda x: {{'d': x, 'h': 100, 's': 'online'}}), lambda a, b: {{'d': b.d, 'h': case when b.d > 0 then greatest(0, a.h - b.d) else least(100, a.h + 5) end,
 's': case when b.d > 0 then case when a.h - b.d < 30 then 'compromised' when a.h - b.d < 70 then 'warning' else a.s end else case when a.h < 100 and least(100, a.h + 5) > 70 then 'online' else a.s end end}}, {{'d': 0, 'h': 100, 's': 'online'}}) as z from d""",
    "chart_ring_120": f"with {CHART} select device, device_name, ts_us, seq, cpu, memory, network, requests, label from (select *, row_number() over (partition by device order by seq desc) as rn from chart) where rn <= 120",
    "chart_scaled": f"with {CHART} select device, seq, network / greatest(max(network) over (partition by device), 100.0::double) as share from chart",
    "chart_axis": f"with {CHART}, e as (select device, min(ts_us) as a, greatest(max(ts_us), min(ts_us) + 30000000) as b from chart group by device) select device, tick::int as tick, (a + floor((b - a) * tick / 5.0::double))::bigint as at_us from e, range(0, 6) t(tick)",
    "latest_point": f"with {CHART} select device, arg_max(seq, seq) as seq, arg_max(cpu, seq) as cpu from chart group by device",
    "distinct_devices": f"with {CHART} select device, min(seq) as seq from chart group by device",
    "rps": f"with {TEL}, w as (select event_id, service, requests, (ts_us - lag(ts_us) over (partition by service order by ts_us, seq)) / 1000000.0::double as gap from tel where requests is not null) select event_id, service, requests / gap as rps from w where gap > 0",
    "timeline_top50": f"""with {DROPPED}, u as (select 'alert-' || alert_id as id, case when severity = 'critical' then 'error' else 'alert' end as kind, title as message, source, ts_us from alerts
 union all select 'dropped-' || alert_id, 'network', 'Blocked ' || replace(attack_type, '_', ' ') || ' from ' || source_ip, 'Response Engine', ts_us from dropped) select * from u order by ts_us desc, id limit 50""",
    "sector_summary": f"with {VERDICT} select sector, count(*) as packets, count(*) filter (status in ('blocked', 'quarantined', 'isolated')) as threats, arg_max(threat_level, (ts_us, seq)) = 'critical' as last_critical from verdicts group by sector",
    "threat_rate": f"with {VERDICT} select count(*) as total, count(*) filter (status = 'allowed') as allowed, count(*) filter (status = 'blocked') as blocked, floor(count(*) filter (status = 'blocked') * 100.0::double / count(*) * 10.0::double + 0.5) / 10.0::double as percent from verdicts",
    "traffic_per_slot": f"with {VERDICT} select (ts_us // {HOUR}) * {HOUR} as slot_us, count(*) as traffic, count(*) filter (status = 'blocked') as threats from verdicts group by 1 order by 1 desc limit 20",
    "minmax_scaled": f"with {TEL} select event_id, (network - min(network) over (partition by domain)) / (max(network) over (partition by domain) - min(network) over (partition by domain)) as network_scaled from tel where network is not null",
    "sequence_windows": f"with {TEL}, w as (select domain, seq, list(network) over (partition by domain order by seq rows between 19 preceding and current row) as steps, lead(network) over (partition by domain order by seq) as target from tel where network is not null) select domain, seq, steps, target from w where len(steps) = 20",
    "label_clean": f"""with {TEL}, r as (select event_id, case seq % 4 when 0 then 'norm' when 1 then 'BenignTraffic' when 2 then 'DDoS' else 'Mirai' end as label, case when seq % 13 = 0 then 'inf'::double when seq % 17 = 0 then 'nan'::double else network end as network, memory from tel)
 select event_id, case when lower(label) in ('norm', 'normal') or contains(label, 'Benign') then 0 else 1 end as label, network, memory from r where isfinite(network) and memory is not null""",
    "char_ngram_counts": "with d as (select doc_id, string_split(lower(text), '') as c from documents where length(text) > 1), g as (select doc_id, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) as gram from d union all select doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) from d where len(c) > 2 union all select doc_id, unnest(list_transform(range(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])) from d where len(c) > 3) select gram, count(*) as n, count(distinct doc_id) as docs from g group by gram order by n desc, gram limit 100",
}
SQL["device_health"] = SQL["device_health"].replace(" as z from d", " as z from d").replace(" select device, list_reduce", ", z as (select device, list_reduce") + ") select device, z.h::bigint as health, z.s as status from z"
