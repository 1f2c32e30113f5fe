"""Detection rules: event rows in, one row for each hit out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.compat import first_match, first_part, folded, ignore_case, truthy

from .windows import trailing

# Patterns and thresholds that results depend on.
SQL_PATTERNS = (
    r"(\%27)|(\')|(\-\-)|(\%23)|(#)",
    r"((\%3D)|(=))[^\n]*((\%27)|(\')|(\-\-)|(\%3B)|(;))",
    r"\w*((\%27)|(\'))((\%6F)|o|(\%4F))((\%72)|r|(\%52))",
    r"((\%27)|(\'))union",
    r"exec(\s|\+)+(s|x)p\w+",
    r"UNION(\s+)SELECT",
    r"SELECT.*FROM",
    r"INSERT(\s+)INTO",
    r"DELETE(\s+)FROM",
    r"DROP(\s+)TABLE",
    r"UPDATE(\s+)\w+(\s+)SET",
    r"--",
    r"1=1",
    r"1\s*=\s*1",
    r"OR\s+1=1",
    r";\s*DROP",
)
#: For each pattern, parts of which every text that it matches holds one.
SQL_NEEDS = (("%27", "'", "--", "%23", "#"), ("%3d", "="), ("%27", "'"), ("%27", "'"), ("exec",), ("union",), ("select",), ("insert",), ("delete",), ("drop",), ("update",), ("--",), ("1=1",), ("=",), ("1=1",), (";",))
AGENT_PATTERNS = (
    r"(\b(union|select|insert|update|delete|drop|alter|create|truncate)\b.*\b(from|into|table|database)\b)",
    r"(\bor\b\s+\d+\s*=\s*\d+)",
    r"(\bor\b\s*'[^']*'\s*=\s*'[^']*')",
    r"('.*--)",
    r"(;.*--)",
    r"(\bunion\s+select\b)",
    r"(\bselect\b.*\bfrom\b.*\bwhere\b)",
)
SQL_PARTS = ("' or ", "' and ", "1=1", "1 = 1", "union select", "drop table", "delete from", "--", ";--", "/*", "*/", "exec(", "execute(")
XSS_PARTS = ("<script", "javascript:", "onerror=", "onclick=", "onload=", "eval(")
GATEKEEPER_PARTS = ("1=1", "union select", "drop table", "script>")
ATTACK_TYPES = ("sqli_attack", "sqli_blocked", "sql_injection_attempt")
RATE_SKIPS = ("sqli_attack", "sqli_blocked", "iomt_attack", "sensor_attack", "traffic_attack")
SECTOR_NAMES = {"iomt_attack": "IoMT Device Compromise", "sensor_attack": "IoT Sensor Spoofing", "traffic_attack": "Smart City Traffic Hack"}

HIT = ("event_id", "rule_id", "rule_name", "severity", "confidence", "source_ip", "service", "value", "detail", "ts_us", "seq")
_FOUND = "struct<rule_id:string,rule_name:string,severity:string,confidence:double,value:double,detail:string,service:string>"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def found(rule_id, rule_name, severity, confidence, value=None, detail=None, service="") -> Column:
    """What a rule says of a row. detail: field names or a user, for the alert's text. service: the row's own; None for what an address did."""
    named = (rule_id, "rule_id"), (rule_name, "rule_name"), (severity, "severity"), (confidence, "confidence"), (value, "value"), (detail, "detail"), (F.col("service") if service == "" else service, "service")
    return F.struct(*[_lit(x).alias(n) for x, n in named]).cast(_FOUND)


def _hits(rows: DataFrame) -> DataFrame:
    h = lambda *names: [F.col(f"_hit.{n}").alias(n) for n in names]
    return rows.select("event_id", *h("rule_id", "rule_name", "severity", "confidence"), "source_ip", *h("service", "value", "detail"), "ts_us", "seq")


def payload_of(tel: DataFrame) -> Column:
    """The text values of an event by field; of rows without a payload, the query alone."""
    return F.col("payload") if "payload" in tel.columns else F.map_from_arrays(F.array(F.lit("query")), F.array("query"))


def matches(payload: Column) -> Column:
    """array<struct<field,pattern,value>>: each field of a map of texts with its first matching pattern, in the order of the map."""
    one = lambda e: F.struct(e["key"].alias("field"), first_match(e["value"], SQL_PATTERNS, SQL_NEEDS).alias("pattern"), F.left(e["value"], F.lit(100)).alias("value"))
    return F.filter(F.transform(F.map_entries(payload), one), lambda m: m["pattern"].isNotNull())


def matched_fields(tel: DataFrame) -> DataFrame:
    """(event_id, field, pattern, value) of every match."""
    return tel.select("event_id", F.inline(matches(payload_of(tel))))


def sql_injection(tel: DataFrame) -> DataFrame:
    """Known attack types with confidence 1, then texts with a pattern with 0.85; value is the number of fields, detail their names."""
    rows = tel.withColumn("_hit", sql_found(tel))
    return _hits(rows.where("_hit is not null"))


def sql_found(tel: DataFrame) -> Column:
    """What sql_injection says of a row, null if nothing. The matches are made once, as the one element of an array."""
    known = F.col("event_type").isin(*ATTACK_TYPES)

    def told(m: Column) -> Column:
        names = F.array_join(F.transform(m, lambda x: x["field"]), ", ")
        seen = found("sql_injection", F.when(known, "SQL Injection Attempt").otherwise("SQL Injection Detection"), "critical", F.when(known, 1.0).otherwise(0.85), F.size(m), F.when(names != "", names))
        return F.when(known | (F.size(m) > 0), seen)

    return F.get(F.transform(F.array(F.coalesce(matches(payload_of(tel)), F.array().cast("array<struct<field:string,pattern:int,value:string>>"))), told), F.lit(0))


def known_attacks(events: DataFrame) -> DataFrame:
    """(event_id, description, recommendation) of events (event_id, event_type, payload) of a known attack type."""
    at = F.coalesce(F.try_element_at("payload", F.lit("path")), F.lit("unknown endpoint"))
    done = F.coalesce(F.try_element_at("payload", F.lit("action")) == "BLOCKED", F.lit(False))
    return events.where(F.col("event_type").isin(*ATTACK_TYPES)).select("event_id", F.concat(F.lit("SQL Injection attempt detected on "), at).alias("description"), F.when(done, "Already neutralized").otherwise("Immediate IP Block").alias("recommendation"))


def sector_attack(rows: DataFrame) -> DataFrame:
    """Rows (event_type, payload: map<string,string>) of sector attacks.

    A blocked_by that is null gives nothing; one that is missing counts as empty.
    """
    kind = F.col("event_type")
    by = F.when(F.map_contains_key("payload", F.lit("blocked_by")), F.try_element_at("payload", F.lit("blocked_by"))).otherwise(F.lit(""))
    found = rows.where(kind.isin(*SECTOR_NAMES)).withColumn("_by", by).where("_by is not null")
    name = F.element_at(F.create_map(*[F.lit(x) for p in SECTOR_NAMES.items() for x in p]), kind)
    ml = F.col("_by").contains("ML")
    return found.select(
        "event_id",
        F.concat(F.when(ml, "ml_").otherwise("rule_"), kind).alias("rule_id"),
        F.concat(F.when(ml, "ML: ").otherwise(""), name).alias("rule_name"),
        F.lit("critical").alias("severity"),
        F.when(ml, 0.95).otherwise(1.0).alias("confidence"),
    )


def _metric(name: str, column: str, over: float, title: str, severity, confidence: float) -> Column:
    return F.when(F.col(column) > over, found(name, title, severity, confidence, F.col(column)))


def cpu_found(over: float = 85, critical: float = 95) -> Column:
    return _metric("high_cpu", "cpu", over, "High CPU Usage", F.when(F.col("cpu") < critical, "warning").otherwise("critical"), 0.95)


def memory_found(over: float = 90) -> Column:
    return _metric("high_memory", "memory", over, "High Memory Usage", "critical", 0.95)


def network_found(over: float = 900) -> Column:
    return _metric("high_network", "network", over, "Network Traffic Spike", "warning", 0.80)


def high_cpu(tel: DataFrame, **limits: float) -> DataFrame:
    return _hits(tel.withColumn("_hit", cpu_found(**limits)).where("_hit is not null"))


def high_memory(tel: DataFrame, **limits: float) -> DataFrame:
    return _hits(tel.withColumn("_hit", memory_found(**limits)).where("_hit is not null"))


def high_network(tel: DataFrame, **limits: float) -> DataFrame:
    return _hits(tel.withColumn("_hit", network_found(**limits)).where("_hit is not null"))


def local_found(tel: DataFrame) -> list[Column]:
    """What the rules that look at one event alone say of it."""
    return [sql_found(tel), cpu_found(), memory_found(), network_found()]


def _given(every: list[Column]) -> Column:
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def single(tel: DataFrame) -> DataFrame:
    """Hits of the rules that look at one event alone, in one pass over the events."""
    return _hits(tel.withColumn("_hit", F.explode(_given(local_found(tel)))))


def counted_for_rate() -> Column:
    return F.coalesce(~F.col("event_type").isin(*RATE_SKIPS), F.lit(False)) & truthy(F.col("source_ip")).isNotNull()


def spike_found(n: Column, over: int) -> Column:
    return F.when(n > over, found("rate_spike", "Abnormal Request Rate", "warning", 0.75, n, service=None))


def rate_spike(tel: DataFrame, seconds: int = 60, over: int = 500, strict: bool = False) -> DataFrame:
    """More requests of an address than `over` in the window; strict yields nothing, as the shadowed rule does."""
    rows = trailing(tel.where(counted_for_rate()), "source_ip", "ts_us", seconds, {"_n": lambda w: F.count(F.lit(1)).over(w)})
    return _hits(rows.withColumn("_hit", spike_found(F.col("_n"), over)).where(F.lit(not strict) & F.col("_hit").isNotNull()))


def login_failed() -> Column:
    """auth_failure events, and auth_attempt events whose success is given as false; a missing success counts as true."""
    return F.coalesce((F.col("event_type") == "auth_failure") | ((F.col("event_type") == "auth_attempt") & ~F.coalesce("success", F.lit(True))), F.lit(False))


def failed_auth(tel: DataFrame) -> DataFrame:
    return tel.where(login_failed())


def brute_found(n: Column, least: int, user: Column) -> Column:
    return F.when(n >= least, found("brute_force", "Brute Force Attack", "critical", 0.90, n, user, service=None))


def _user(tel: DataFrame) -> Column:
    return F.col("username") if "username" in tel.columns else F.lit(None).cast("string")


def brute_force(tel: DataFrame, seconds: int = 300, least: int = 5) -> DataFrame:
    """Without the cooldown, see folds.cooldown."""
    rows = trailing(failed_auth(tel), "source_ip", "ts_us", seconds, {"_n": lambda w: F.count(F.lit(1)).over(w)})
    return _hits(rows.withColumn("_hit", brute_found(F.col("_n"), least, _user(tel))).where("_hit is not null"))


def every_hit(tel: DataFrame, rate: tuple[int, int] = (60, 500), brute: tuple[int, int] = (300, 5), modelled: bool = True) -> DataFrame:
    """Hits of all rules, and of the model layers if `modelled`, in one scan of the events.

    rate: seconds and requests, brute: seconds and failures. What one event alone
    says is settled before rows are dealt for the windows, so that its texts and
    metrics do not travel; windows of one width are one pass. agri_attack and
    health_probability are taken where the rows have them, see layered_verdict().
    """
    local = local_found(tel)
    if modelled:
        given = {c for c in ("agri_attack", "health_probability") if c in tel.columns}
        fields = request_fields(tel) | {c: F.col(c) for c in given}
        local.append(F.get(F.transform(F.array(said(fields)), model_found), F.lit(0)))
    narrow = tel.select(
        "event_id", "source_ip", "ts_us", "seq", _given(local).alias("_local"),
        counted_for_rate().alias("_counts"), login_failed().alias("_failed"), F.when(login_failed(), _user(tel)).alias("_user"),
    )
    number = {"_spike": "_counts", "_brute": "_failed"}
    made = {n: (lambda c: lambda w: F.count_if(F.col(c)).over(w))(c) for n, c in number.items()}
    for seconds in sorted({rate[0], brute[0]}):
        narrow = trailing(narrow, "source_ip", "ts_us", seconds, {n: f for n, f in made.items() if (rate if n == "_spike" else brute)[0] == seconds}, untimed=True)
    timed = F.col("ts_us").isNotNull()
    dealt = [
        F.when(timed & F.col("_counts"), spike_found(F.col("_spike"), rate[1])),
        F.when(timed & F.col("_failed"), brute_found(F.col("_brute"), brute[1], F.col("_user"))),
    ]
    return _hits(narrow.withColumn("_hit", F.explode(F.concat("_local", _given(dealt)))))


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"single": single, "rate_spike": rate_spike, "brute_force": brute_force}


def run_rules(tel: DataFrame, rules: dict[str, Callable[[DataFrame], DataFrame]] = RULES, failed: dict[str, str] | None = None) -> DataFrame:
    """All hits of all rules. A rule that Spark cannot resolve over the rows is left out, with its error in `failed`."""
    out = None
    for name, rule in rules.items():
        try:
            made = rule(tel).select(*HIT)
        except (AnalysisException, ParseException) as e:
            if failed is None:
                raise
            failed[name] = str(e)
            continue
        out = made if out is None else out.unionByName(made)
    return _hits(tel.limit(0).withColumn("_hit", found("", "", "", 0.0))) if out is None else out


def guarded(tel: DataFrame, checks: dict[str, Callable[[dict], dict | None]], columns: tuple[str, ...]) -> DataFrame:
    """Hits (HIT) of Python checks plus error: a check that fails on an event gives a row with what failed, and other events and checks go on.

    For rules that no expression says. A check gets the named columns of an event as
    a dict and returns what it found (rule_name, severity, confidence, and value and
    detail where it has them), or None. Checks run batch by batch where the events lie.
    """
    reads = list(dict.fromkeys([*columns, "event_id", "source_ip", "service", "ts_us", "seq"]))
    schema = T.StructType([*[T.StructField(c, T.DoubleType() if c in ("confidence", "value") else T.LongType() if c in ("ts_us", "seq") else T.StringType()) for c in HIT], T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for b in batches:
            out = []
            for row in b.to_pylist():
                for rule, check in checks.items():
                    base = dict.fromkeys([*HIT, "error"]) | {c: row[c] for c in ("event_id", "source_ip", "service", "ts_us", "seq")} | {"rule_id": rule}
                    try:
                        made = check(row)
                        if made is None:
                            continue
                        made = {k: made.get(k) for k in ("rule_name", "severity", "confidence", "value", "detail")}
                        made |= {k: None if made[k] is None else float(made[k]) for k in ("confidence", "value")}
                        out.append(base | made)
                    except Exception as e:  # noqa: BLE001 - whatever a check raises is its own event's error
                        out.append(base | {"error": f"{type(e).__name__}: {e}"[:200]})
            yield from pa.Table.from_pylist(out, schema=kind).to_batches()

    return tel.select(*reads).mapInArrow(run, schema)


def threat_class(query: Column, path: Column) -> tuple[Column, Column]:
    """(type, pattern) of a request: scripts in the query over SQL in it, then the path, whose pattern is the one told."""
    sql_q, xss_q = (F.when(truthy(query).isNotNull(), first_part(query, p)) for p in (SQL_PARTS, XSS_PARTS))
    in_path = F.coalesce(first_part(path, SQL_PARTS), first_part(path, XSS_PARTS))
    kind = F.when(xss_q.isNotNull(), "xss").when(sql_q.isNotNull(), "sql_injection").when(in_path.isNotNull(), "path_injection")
    return kind, F.coalesce(in_path, xss_q, sql_q)


#: Parts of which every text that an agent's pattern matches holds one.
AGENT_NEEDS = ("union", "select", "insert", "update", "delete", "drop", "alter", "create", "truncate", "or", "--")


def agent_sql(text: Column) -> Column:
    """Whether a pattern of the agents is found; texts without a part of one are not searched."""
    held = lambda low: reduce(Column.__or__, [low.contains(x) for x in AGENT_NEEDS])
    return F.get(F.transform(F.array(folded(text)), lambda low: held(low) & text.rlike(ignore_case("|".join(AGENT_PATTERNS)))), F.lit(0))


def dashboard_hits(tel: DataFrame) -> DataFrame:
    """(rule, device, severity, ts_us, seq) of the four dashboard rules."""
    tests = (("rule-cpu-high", F.col("cpu") > 85, "warning"), ("rule-mem-critical", F.col("memory") > 90, "critical"), ("rule-net-spike", F.col("network") > 800, "warning"), ("rule-req-flood", F.col("requests") > 400, "warning"))
    found = F.filter(F.array(*[F.when(t, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, t, s in tests]), lambda x: x.isNotNull())
    return tel.select(F.explode(found).alias("h"), F.col("service").alias("device"), "ts_us", "seq").select("h.rule", "device", "h.severity", "ts_us", "seq")


def request_fields(tel: DataFrame) -> dict[str, Column]:
    own = lambda name, kind: F.col(name).cast(kind) if name in tel.columns else F.lit(None).cast(kind)
    return {
        "sector": F.coalesce(own("payload_domain", "string"), F.col("domain"), F.lit("general")),
        "text": F.coalesce(truthy(F.col("query")), truthy(own("username", "string")), F.lit("")),
        "sensor_data": F.coalesce(own("sensor_data", "array<double>"), F.array().cast("array<double>")),
        "rate": (F.coalesce("requests", F.lit(0)) * 100).cast("double"), "syn": F.coalesce(own("syn_count", "double"), F.col("network"), F.lit(0.0)), "rst": F.lit(0.0),
        "iat": F.lit(500.0), "number": F.coalesce("requests", F.lit(5)).cast("double"),
    }


def model_request(tel: DataFrame) -> DataFrame:
    """Inputs of the model layers for each event. username, payload_domain, syn_count and sensor_data are taken where the rows have them."""
    return tel.select("event_id", *[c.alias(n) for n, c in request_fields(tel).items()], "source_ip", "service", "ts_us", "seq")


def network_reasons(fields: dict[str, Column] | None = None) -> Column:
    """Reasons, in order, that a network sample is an attack."""
    x = lambda name: F.col(name) if fields is None else fields[name]
    tests = ((x("rate") > 5000, "High traffic rate"), (x("syn") > 50, "High SYN count"), (x("rst") > 30, "High RST count"), (x("iat") < 200, "Suspicious packet timing"), (x("number") > 60, "High packet volume"))
    return F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in tests]), lambda x: x.isNotNull())


def said(fields: dict[str, Column]) -> Column:
    """(status, threat_level, source, score) of a request: gatekeeper, then network shield, then the sector layer."""
    say = lambda status, level, source, score=None: F.struct(F.lit(status).alias("status"), F.lit(level).alias("threat_level"), F.lit(source).cast("string").alias("source"), _lit(score).cast("double").alias("score"))
    layers = [
        F.when(first_part(fields["text"], GATEKEEPER_PARTS).isNotNull(), say("blocked", "critical", "Web Gatekeeper", 0.99)),
        F.get(F.transform(F.array(F.size(network_reasons(fields))), lambda n: F.when(n > 0, say("blocked", "critical", "Network Shield", F.least(0.5 + n * 0.15, F.lit(1.0))))), F.lit(0)),
    ]
    if "agri_attack" in fields:
        layers.append(F.when((fields["sector"] == "agriculture") & fields["agri_attack"], say("isolated", "medium", "Agri-Guardian")))
    if "health_probability" in fields:
        layers.append(F.when((fields["sector"] == "healthcare") & (fields["health_probability"] > 0.7), say("quarantined", "critical", None)))
    return F.coalesce(*layers, say("allowed", "low", None))


def layered_verdict(requests: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """Gatekeeper, then network shield, then the sector layer; the first that hits decides.

    predicted (event_id, agri_attack, health_probability) is what the sector models
    say: an attack isolates in agriculture, a probability above 0.7 puts a
    healthcare device under quarantine, without a source. Without it, and in other
    sectors, the layer allows.
    """
    names = ["sector", "text", "rate", "syn", "rst", "iat", "number"]
    if predicted is not None:
        names += ["agri_attack", "health_probability"]
        requests = requests.join(predicted.select("event_id", "agri_attack", "health_probability"), "event_id", "left")
    return requests.withColumn("v", said({n: F.col(n) for n in names})).select("event_id", "sector", "v.*", "source_ip", "service", "ts_us", "seq")


def model_found(v: Column) -> Column:
    """What a verdict (status, threat_level, source, score) becomes among the hits of rules."""
    bad = (v["status"] == "blocked") | v["threat_level"].isin("high", "critical")
    rule = F.concat(F.lit("ml_"), F.replace(F.lower(F.coalesce(v["source"], F.lit("network_shield"))), F.lit(" "), F.lit("_")))
    return F.when(bad, found(rule, F.concat(F.lit("ML: "), F.coalesce(v["source"], F.lit("AI Detection"))), v["threat_level"], F.coalesce(v["score"], F.lit(0.85))))


def model_hits(verdicts: DataFrame) -> DataFrame:
    """Verdicts that become hits, as rule rows."""
    v = F.struct("status", "threat_level", "source", "score")
    return _hits(verdicts.withColumn("_hit", model_found(v)).where("_hit is not null"))
