"""Queries of the response side: the ledger's commands and statistics, rules over payload maps, routing and node status, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import actions, dashboard, joins, ledger, rules

from .catalog import NOW_US, acted, col, daily_alerts, lit, nodes, pick
from .console import pair
from .sql import ACTIONS, ALERTS, NODES, TEL, chain, first_part, q


def ledger_commands(tel: DataFrame) -> DataFrame:
    """Failed and tried logins as commands of an operator."""
    seq = col("seq")
    op = F.when(seq % 100 == 3, "clear").when(seq % 5 == 0, "unblock").when(seq % 7 == 0, "throttle").otherwise("block")
    made = {
        "ip": F.when(seq % 100 != 3, col("source_ip")),
        "ts_us": col("ts_us"),
        "seq": seq,
        "op": op,
        "reason": F.when(seq % 2 == 1, "abuse"),
        "severity": pick(4, *[lit(s) for s in joins.DURATIONS]),
        "seconds": F.when(seq % 9 == 0, 0).when(seq % 3 > 0, 172_800),
        "limit": F.when(seq % 2 == 0, seq % 30),
        "triggered_by": F.when(seq % 4 == 1, "rule"),
    }
    rows = tel.where("event_type in ('auth_failure', 'auth_attempt')")
    return rows.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in ledger.COMMAND.fields])


COMMANDS = f"""{TEL}, c as (select case when seq % 100 <> 3 then source_ip end as ip, ts_us, seq,
  case when seq % 100 = 3 then 'clear' when seq % 5 = 0 then 'unblock' when seq % 7 = 0 then 'throttle' else 'block' end as op,
  case when seq % 2 = 1 then 'abuse' end as reason, case seq % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as severity,
  case when seq % 9 = 0 then 0 when seq % 3 > 0 then 172800 end as seconds, case when seq % 2 = 0 then seq % 30 end as lim, case when seq % 4 = 1 then 'rule' end as by_whom
  from tel where event_type in ('auth_failure', 'auth_attempt')),
 e as (select *, coalesce(sum((op = 'clear')::int) over (order by ts_us, seq rows between unbounded preceding and 1 preceding), 0) as epoch from c),
 ends as (select k.ip, k.epoch, coalesce(x.ts_us, (select max(ts_us) from c)) as ts_us, case when x.ts_us is null then 'stop' else 'end' end as op
  from (select distinct ip, epoch from e where op <> 'clear') k left join e x on x.epoch = k.epoch and x.op = 'clear'),
 steps as (select *, row_number() over (partition by ip, epoch order by last, ts_us, seq) as rn from (
  select ip, epoch, ts_us, seq, op, coalesce(reason, 'manual') as reason, severity, coalesce(seconds, {chain('severity', joins.DURATIONS, '300')})::bigint as dur, lim, by_whom, 0 as last from e where op <> 'clear'
  union all select ip, epoch, ts_us, null, op, null, null, null, null, null, 1 from ends)),
 r as (select ip, epoch, 0::bigint as rn, null::bigint as exp, 0::bigint as since, ''::varchar as reason, ''::varchar as severity,
   []::struct(action varchar, reason varchar, severity varchar, duration bigint, triggered_by varchar, details varchar, ts_us bigint, seq bigint)[] as told from steps where rn = 1
  union all select ip, epoch, rn, case op when 'block' then case when e0 is null then until else greatest(e0, until) end when 'unblock' then null else e0 end,
   case when op = 'block' and e0 is null then ts_us else since end, case when op = 'block' and e0 is null then r1 else r0 end,
   case when op <> 'block' then s0 when e0 is null then s1 when list_position(['low', 'medium', 'high', 'critical'], s1) > list_position(['low', 'medium', 'high', 'critical'], s0) then s1 else s0 end,
   list_concat(case when over then [{{'action': 'auto_unblock', 'reason': r0, 'severity': s0, 'duration': null, 'triggered_by': 'expiry', 'details': '{{"was_blocked_for":' || (exp - since) // 1000000 || '}}', 'ts_us': exp, 'seq': null}}] else [] end,
    case when op = 'block' then [{{'action': case when e0 is null then 'block' else 'extend_block' end, 'reason': r1, 'severity': s1, 'duration': dur, 'triggered_by': coalesce(by_whom, 'system'), 'details': '{{}}', 'ts_us': ts_us, 'seq': seq}}]
     when op = 'unblock' and e0 is not null then [{{'action': 'unblock', 'reason': r0, 'severity': s0, 'duration': null, 'triggered_by': coalesce(by_whom, 'manual'), 'details': '{{"was_blocked_for":' || (ts_us - since) // 1000000 || '}}', 'ts_us': ts_us, 'seq': seq}}]
     when op = 'throttle' then [{{'action': 'throttle', 'reason': 'rate_limit', 'severity': 'medium', 'duration': coalesce(nullif(dur, -1), 300), 'triggered_by': 'system', 'details': '{{"new_limit":' || coalesce(lim, 10) || '}}', 'ts_us': ts_us, 'seq': seq}}]
     when op = 'end' and e0 is not null then [{{'action': 'cleared', 'reason': '', 'severity': '', 'duration': null, 'triggered_by': '', 'details': '', 'ts_us': ts_us, 'seq': null}}] else [] end)
   from (select s.ip, s.epoch, s.rn, s.op, s.ts_us, s.seq, case when s.op = 'throttle' then s.raw else s.dur end as dur, s.lim, s.by_whom, r.since, r.exp, r.reason as r0, r.severity as s0, s.reason as r1, s.severity as s1, coalesce(r.exp <> 0 and s.ts_us > r.exp, false) as over,
     case when not coalesce(r.exp <> 0 and s.ts_us > r.exp, false) then r.exp end as e0, case when s.dur > 0 then s.ts_us + s.dur * 1000000 else 0 end as until
     from r join (select *, case when op = 'throttle' then case when seq % 9 = 0 then 0 when seq % 3 > 0 then 172800 else -1 end end as raw from steps) s on s.ip = r.ip and s.epoch = r.epoch and s.rn = r.rn + 1)),
 told as (select ip, epoch, unnest(told) as x from r),
 audit as (select x.action as action, ip, x.reason as reason, x.severity as severity, x.duration as duration, x.triggered_by as triggered_by, x.details as details, null::bigint as cleared, x.ts_us as ts_us, x.seq as seq from told where x.action <> 'cleared'
  union all select 'clear_all', 'ALL', 'manual', 'info', null, 'admin', '{{}}', (select count(*) from told t where t.epoch = e.epoch and t.x.action = 'cleared'), ts_us, seq from e where op = 'clear')"""

pair("ledger_commands", f"with recursive {COMMANDS} select * from audit")(lambda tel: ledger.ledger(ledger_commands(tel)))
_TOPICS = {"block": "ip:blocked", "extend_block": "ip:blocked", "unblock": "ip:unblocked", "auto_unblock": "ip:unblocked", "throttle": "ip:rate_limited", "clear_all": "ip:cleared"}
pair("ledger_topics", f"with recursive {COMMANDS} select {chain('action', _TOPICS, q(''))} as topic, count(*) as n from audit group by 1")(
    lambda tel: ledger.heard(ledger.ledger(ledger_commands(tel))).groupBy("topic").agg(F.count(lit(1)).alias("n"))
)


# Checks that fail on some events.
def _per_request(r: dict) -> dict | None:
    """Network bytes a request; a sample of no requests cannot be told."""
    load = None if r["network"] is None else r["network"] / r["requests"]
    return None if load is None or load <= 20 else {"rule_name": "Heavy Requests", "severity": "warning", "confidence": 0.5, "value": load}


def _named_root(r: dict) -> dict | None:
    """Logins as root; an event without a user name is not one that it knows."""
    return {"rule_name": "Root Login", "severity": "critical", "confidence": 0.9, "detail": r["username"]} if r["username"].startswith("root") else None


_CHECKED = "event_id, {rule} as rule_id, {name} as rule_name, {severity} as severity, {confidence}::double as confidence, source_ip, service, {value}::double as value, {detail}::varchar as detail, ts_us, seq, {error}::varchar as error"
_HEAVY = _CHECKED.format(rule="'per_request'", name="'Heavy Requests'", severity="'warning'", confidence="0.5", value="network / requests", detail="null", error="null")
_ROOT = _CHECKED.format(rule="'root_login'", name="'Root Login'", severity="'critical'", confidence="0.9", value="null", detail="username", error="null")
_FAILS = [_CHECKED.format(rule=f"'{rule}'", name="null", severity="null", confidence="null", value="null", detail="null", error=f"'{error}'") for rule, error in (("per_request", "ZeroDivisionError: float division by zero"), ("root_login", "AttributeError: ''NoneType'' object has no attribute ''startswith''"))]
pair(
    "rule_errors",
    f"""with {TEL} select {_HEAVY} from tel where requests > 0 and network / requests > 20 union all select {_FAILS[0]} from tel where requests = 0
 union all select {_ROOT} from tel where starts_with(username, 'root') union all select {_FAILS[1]} from tel where username is null""",
)(lambda tel: rules.guarded(tel, {"per_request": _per_request, "root_login": _named_root}, ("network", "requests", "username")))


# Statistics of the ledger: commands of operators, and the scores of alerts.
_SCORE = chain("severity", dashboard.SCORES, "10")


def _stats(tel: DataFrame) -> DataFrame:
    audit = ledger.ledger(ledger_commands(tel))
    blocks = audit.where("action = 'block'")
    limits = audit.where("action = 'throttle'").groupBy("ip").agg(F.lit(True).alias("throttled"))
    add = F.coalesce(*[F.when(col("severity") == s, lit(v)) for s, v in dashboard.SCORES.items()], lit(10))
    return dashboard.ip_stats(blocks, limits, audit, daily_alerts(tel).groupBy(col("source_ip").alias("ip")).agg(F.sum(add).alias("score")), 1000)


pair(
    "ip_stats",
    f"""with recursive {COMMANDS}, {ALERTS.removeprefix(TEL + ", ")} select 'blocked_count' as name, count(distinct ip) as n, null::varchar as ip from audit where action = 'block'
 union all select 'throttled_count', count(distinct ip), null from audit where action = 'throttle' union all select 'audit_log_size', count(*), null from audit
 union all select 'high_threat_ips', sum({_SCORE})::bigint, source_ip from alerts group by source_ip having sum({_SCORE}) >= 1000""",
)(_stats)


# Sector attacks: what the events table holds, told as a payload map.
def sector_events(tel: DataFrame) -> DataFrame:
    kind = pick(4, *[lit(k) for k in (*rules.SECTOR_NAMES, "healthcare_attack")])
    payload = F.when(col("query").isNull(), F.create_map(lit("action"), col("event_type"))).otherwise(F.create_map(lit("blocked_by"), F.when(col("query").contains("script"), "ML_X").when(~col("query").contains("--"), col("service"))))
    return tel.select("event_id", kind.alias("event_type"), payload.alias("payload"))


pair(
    "rule_sector",
    f"""with {TEL}, e as (select event_id, case seq % 4 when 0 then 'iomt_attack' when 1 then 'sensor_attack' when 2 then 'traffic_attack' end as kind, case when query is null then '' when contains(query, 'script') then 'ML_X' when not contains(query, '--') then service end as by_whom from tel)
 select event_id, case when contains(by_whom, 'ML') then 'ml_' else 'rule_' end || kind as rule_id, case when contains(by_whom, 'ML') then 'ML: ' else '' end || {chain('kind', rules.SECTOR_NAMES, q(''))} as rule_name, 'critical' as severity,
 case when contains(by_whom, 'ML') then 0.95::double else 1.0::double end as confidence from e where kind is not null and by_whom is not null""",
)(lambda tel: rules.sector_attack(sector_events(tel)))

# Actions that were taken, found by a word in their label or keywords.
pair(
    "action_keyword",
    f"""with {ACTIONS} select alert_id, step, action || ' ' || target as label from acted where contains(lower(action || ' ' || target), 'block') or contains(lower(rule_id), 'block') or contains(lower(severity), 'block')""",
)(lambda tel: actions.keyword(acted(tel).select("alert_id", "step", F.concat("action", lit(" "), "target").alias("label"), F.array("rule_id", "severity").alias("keywords")), "Block").select("alert_id", "step", "label"))

# Routing: each node's answer.
pair(
    "attack_fan_out",
    f"""with {TEL}, {NODES} select t.event_id, n.node_id, case when ({first_part('t.username', rules.SQL_PARTS + rules.XSS_PARTS)}) is not null then 'blocked' else 'passed' end as result, count(*) over (partition by t.event_id) as nodes
 from tel t join nodes n on t.domain = n.sector and n.status = 'online' where t.event_type = 'auth_failure'""",
)(lambda tel: joins.fan_out(tel.where("event_type = 'auth_failure'"), nodes(tel), "username"))

# When nodes come and go.
_AFTER = 3600 * 1_000_000
pair(
    "node_status_changes",
    f"""with {TEL}, b as (select service, domain, ts_us, lag(ts_us) over (partition by service order by ts_us, seq) as before, lead(ts_us) over (partition by service order by ts_us, seq) as after from tel)
 select service as node_id, domain as sector, 'online' as status, ts_us, before is null as registered from b where before is null or ts_us - before > {_AFTER}
 union all select service, domain, 'offline', before + {_AFTER}, false from b where ts_us - before > {_AFTER} union all select service, domain, 'offline', ts_us + {_AFTER}, false from b where after is null and {NOW_US} - ts_us > {_AFTER}""",
)(lambda tel: joins.status_changes(tel, NOW_US, 3600))
