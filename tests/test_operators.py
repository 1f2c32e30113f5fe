"""Golden cases and plain models of the telemetry operators."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions.compat import first_match, fixed_point, half_up, ignore_case, ipv4, title_case
from vigil.operators import actions, alerts, dashboard, folds, joins, normalize, perimeter, rules, windows

TEL = "event_id string, source_ip string, domain string, service string, event_type string, cpu double, memory double, network double, requests bigint, query string, success boolean, ts_us bigint, seq bigint"
S = 1_000_000


def tel(spark, *rows):
    base = dict(event_id="e", source_ip="10.0.0.1", domain="general", service="svc", event_type="telemetry", cpu=None, memory=None, network=None, requests=None, query=None, success=None, ts_us=0, seq=0)
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in TEL.split(", ")) for r in rows], TEL)


def test_fixture_hits(spark):
    events = tel(spark, {"event_id": "test-001", "event_type": "http_request", "query": "' OR 1=1; DROP TABLE users; --"}, {"event_id": "test-002", "cpu": 92.5, "memory": 78.0, "network": 150.0}, {"event_id": "test-003", "event_type": "auth_attempt", "success": False}, {"event_id": "test-004", "cpu": 45.0, "memory": 95.0, "network": 1200.0})
    got = {(r.event_id, r.rule_id, r.severity) for r in rules.run_rules(events).collect()}
    assert got == {("test-001", "sql_injection", "critical"), ("test-002", "high_cpu", "warning"), ("test-004", "high_memory", "critical"), ("test-004", "high_network", "warning")}
    web = {r.event_id: r.source for r in rules.layered_verdict(rules.model_request(events)).collect()}
    assert web == {"test-001": "Web Gatekeeper", "test-002": "Network Shield", "test-003": None, "test-004": "Network Shield"}


def test_empty_events(spark):
    none = tel(spark).limit(0)
    assert rules.run_rules(none).count() == 0 and actions.actions(alerts.alerts(rules.run_rules(none))).count() == 0


def test_strict_spike_yields_nothing(spark):
    rows = tel(spark, *[{"event_id": str(i), "ts_us": i, "seq": i} for i in range(12)])
    assert rules.rate_spike(rows, 60, 10).count() == 2 and rules.rate_spike(rows, 60, 10, strict=True).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 1000)), max_size=60), st.integers(1, 6))
def test_trailing_counts(spark, rows, seconds):
    data = [(k, t * S // 4, i) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, t bigint, seq bigint")
    got = {r.seq: r.n for r in windows.trailing(df, "k", "t", seconds, {"n": lambda w: F.count(F.lit(1)).over(w)}).collect()}
    assert got == {i: sum(k2 == k and t - seconds * S < t2 <= t for k2, t2, _ in data) for k, t, i in data}


def test_cooldown_edges(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 30 * S - 1, 1), ("a", 30 * S, 2), ("b", 5, 3), ("a", 60 * S, 4)], "k string, t bigint, seq bigint")
    assert sorted(r.seq for r in folds.cooldown(df, ["k"], "t", 30 * S).collect()) == [0, 2, 3, 4]


def test_device_health():
    assert folds.device_step((85, "online"), 15) == (70, "online") and folds.device_step((80, "online"), 11) == (69, "warning")
    assert folds.device_step((45, "warning"), 15) == (30, "warning") and folds.device_step((44, "warning"), 15) == (29, "compromised")
    assert folds.device_step((65, "warning"), 0) == (70, "warning") and folds.device_step((70, "warning"), 0) == (75, "online")


def test_block_intervals_and_members(spark):
    blocks = spark.createDataFrame([("a", "low", 0), ("a", "low", 30 * S), ("a", "low", 200 * S), ("b", "odd", 0)], "ip string, severity string, ts_us bigint")
    spans = joins.block_intervals(blocks)
    assert {tuple(r) for r in spans.collect()} == {("a", 0, 90 * S), ("a", 200 * S, 260 * S), ("b", 0, 300 * S)}
    asked = spark.createDataFrame([("a", 90 * S), ("a", 90 * S + 1), ("a", 200 * S), ("c", 0)], "source_ip string, ts_us bigint")
    assert {tuple(r) for r in joins.blocked(asked, spans).collect()} == {("a", 90 * S), ("a", 200 * S)}
    assert joins.unblocked(asked, spans).count() == 2


def test_heartbeat_both_ways(spark):
    nodes = spark.createDataFrame([("node-1", 1), ("ode", 2), ("x", 3)], "node_id string, registered_seq bigint")
    rows = tel(spark, {"event_id": "1", "service": "node-12"}, {"event_id": "2", "service": "ode"}, {"event_id": "3", "service": "none"})
    want = {("1", "node-1"), ("2", "ode")}
    assert {tuple(r) for r in joins.heartbeats(rows, nodes).collect()} == want
    assert {tuple(r) for r in joins.heartbeats(rows, nodes, most_nodes=1).collect()} == want


def test_permanent_block_becomes_finite():
    a, audit = perimeter.Address(), []
    assert a.block(0, "manual", "high", audit, 0) == "blocked" and a.expires == 0
    assert a.is_blocked(10**15, audit)
    assert a.block(S, "manual", "low", audit, 60) == "extended" and a.expires == 61 * S and a.severity == "high"
    assert not a.is_blocked(62 * S, audit) and audit == ["block", "extend_block", "auto_unblock"]


def burst(n, **more):
    return [dict(source_ip="9.9.9.9", ts_us=i * S // 120, seq=i, path="/", query="", method="GET", status=200, username=None) | more for i in range(n)]


def test_feedback_burst():
    a = perimeter.Address()
    made = [perimeter.handle(a, r)["decision"] for r in burst(120)]
    assert made[0] == "allowed" and "rate_limited" in made and made[-1] == "blocked"
    assert made.index("blocked") > made.index("rate_limited")


def test_spike_lowers_critical():
    a = perimeter.Address(baseline=0.001)
    a.ten = [i for i in range(100)]
    audit, dropped = [], []
    assert a.flooded(200, dropped, audit) == "blocked" and a.severity == "high"


def test_bypass_and_local():
    a = perimeter.Address()
    assert all(perimeter.handle(a, r)["decision"] == "allowed" for r in burst(300, path="/health") + burst(300, source_ip="127.0.0.5"))


def test_fold_equals_machine(spark):
    random.seed(5)
    rows = [r | {"source_ip": random.choice(["1.1.1.1", "2.2.2.2"]), "path": random.choice(["/", "/login", "/api/x"]), "query": random.choice(["", "a=1 or 1=1"]), "status": random.choice([200, 401]), "method": "POST", "username": random.choice("abc")} for r in burst(200)]
    want, held = {}, {}
    for r in rows:
        a = held.setdefault(r["source_ip"], perimeter.Address())
        want[r["seq"]] = perimeter.handle(a, r)["decision"]
    df = spark.createDataFrame([tuple(r[f.name] for f in perimeter.REQUEST.fields) for r in rows], perimeter.REQUEST)
    assert {r.seq: r.decision for r in perimeter.pipeline(df).collect()} == want


def test_sector_null_is_not_missing(spark):
    rows = [("e1", "iomt_attack", {"action": "x"}), ("e2", "iomt_attack", {"blocked_by": None}), ("e3", "sensor_attack", {"blocked_by": "ML_X"}), ("e4", "traffic_attack", {"blocked_by": "WAF"}), ("e5", "iomt_attack", {}), ("e6", "healthcare_attack", {"blocked_by": "ML_X"})]
    got = rules.sector_attack(spark.createDataFrame(rows, "event_id string, event_type string, payload map<string,string>"))
    assert {(r.event_id, r.rule_id) for r in got.collect()} == {("e1", "rule_iomt_attack"), ("e3", "ml_sensor_attack"), ("e4", "rule_traffic_attack"), ("e5", "rule_iomt_attack")}


def test_routing_to_many_nodes(spark, monkeypatch):
    """Shares of nodes give what one array a sector gives."""
    events = tel(spark, *[{"event_id": str(i), "domain": "urban" if i % 3 else "healthcare", "query": "1=1" if i % 2 else "x"} for i in range(9)])
    nodes = spark.createDataFrame([(f"n{i}", "urban" if i % 2 else "healthcare", "online" if i % 5 else "offline") for i in range(23)], "node_id string, sector string, status string")
    few = {tuple(r) for r in joins.fan_out(events, nodes).collect()}
    monkeypatch.setattr(joins, "FEW_NODES", 4)
    assert {tuple(r) for r in joins.fan_out(events, nodes).collect()} == few and {r[2] for r in few} == {"blocked", "passed"}
    assert {tuple(r) for r in joins.route_attacks(events, nodes).collect()} == {r[:2] for r in few}


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_point_is_python_format(spark, digits):
    random.seed(digits)
    values = [0.0, 0.05, 0.25, 92.25, 2.5, 3.5, 1e6 + 0.5] + [random.random() * 10 ** random.randint(0, 5) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(fixed_point(F.col("v"), digits)).collect()] == [f"{v:.{digits}f}" for v in values]


def test_small_functions(spark):
    row = spark.range(1).select(
        title_case(F.lit("node 12b o'neil")).alias("t"), half_up(F.lit(2.25), 1).alias("h"), half_up(F.lit(-0.5)).alias("n"), ipv4(F.lit("1.2.3.256")).alias("bad"), ipv4(F.lit("001.2.3.4")).alias("good"),
        F.lit("ſelect x").rlike(ignore_case(r"select\s")).alias("re"), normalize.relative_time(F.lit(7200)).alias("ago"), normalize.rate_text(F.lit(1250)).alias("rate"), normalize.masked(F.lit("abc")).alias("mask"),
        normalize.attack_label(F.lit("sql_injection")).alias("label"), normalize.remaining_seconds(F.lit(0), F.lit(5)).alias("left"), normalize.sector_badge(F.lit("ml_agri"), F.lit(None).cast("string")).alias("badge"),
    ).first()
    assert (row.t, row.h, row.n, row.bad, row.good, row.re) == ("Node 12B O'Neil", 2.3, 0.0, False, True, True)
    assert (row.ago, row.rate, row["mask"], row.label, row.left, row.badge) == ("2h ago", "1.3k/min", "***", "SQL INJECTION", -1, "agriculture")


def test_patterns_are_tried_only_where_they_can_match(spark):
    """Texts made of pieces of the patterns: the same first pattern with the parts that each needs and without."""
    rng = random.Random(7)
    bits = ["'", "--", "%27", "%23", "#", "%3D", "=", ";", "%3B", "o", "R", "%6F", "%72", "union", "UNION", "\u017felect", "SELECT", " ", "\n", "+", "exec", "xp", "sp_a", "FROM", "insert", "into", "DELETE", "drop", "DROP", "table", "update", "a", "SET", "1=1", "1", "or", "OR", "\u212aelvin", "create", "TABLE", "w", "9"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 7))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    t = F.col("t")
    said = df.select("t", first_match(t, rules.SQL_PATTERNS).alias("a"), first_match(t, rules.SQL_PATTERNS, rules.SQL_NEEDS).alias("b"), t.rlike(ignore_case("|".join(rules.AGENT_PATTERNS))).alias("c"), rules.agent_sql(t).alias("d")).collect()
    assert [r for r in said if r.a != r.b or r.c != r.d] == [] and len({r.a for r in said}) > 10


def test_threat_order(spark):
    df = spark.createDataFrame([("a=<script>1=1", "/x"), ("1=1", "/x"), ("", "/drop table"), ("1=1", "/eval("), (None, "/")], "q string, p string")
    kind, pattern = rules.threat_class(F.col("q"), F.col("p"))
    assert [tuple(r) for r in df.select(kind, pattern).collect()] == [("xss", "<script"), ("sql_injection", "1=1"), ("path_injection", "drop table"), ("sql_injection", "eval("), (None, None)]


def test_baseline(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, 4.0), ("a", 2, 2, 1.0)], "source_ip string, ts_us bigint, seq bigint, v double")
    got = sorted(folds.baseline(df, "v").collect(), key=lambda r: r.seq)
    assert [r.is_spike for r in got] == [False, True, False] and math.isclose(got[1].baseline, 1.3)


def test_stats_of_nothing(spark):
    none = dashboard.threat_rate(rules.layered_verdict(rules.model_request(tel(spark).limit(0)))).first()
    assert (none.total, none.percent) == (0, 0.0)


def test_running_over_a_hot_key(spark):
    """One key over many partitions: sums, maxima and places as a single pass gives them."""
    random.seed(11)
    data = [("hot" if i % 10 else None, i, random.randrange(1000)) for i in range(2000)]
    df = spark.createDataFrame(data, "k string, seq bigint, v bigint").repartition(7)
    got = {r.seq: r for r in windows.running(df, "k", ("seq",), total=("sum", F.col("v"), True), before=("max", F.col("v"), False)).collect()}
    places = {r.seq: r._n for r in windows.numbered(df, "k", "seq").collect()}
    for key in ("hot", None):
        total, top, n = 0, None, 0
        for k, i, v in data:
            if k == key:
                total += v
                assert (got[i].total, got[i].before, places[i]) == (total, top, n)
                top, n = v if top is None else max(top, v), n + 1


def test_sequences_across_runs(spark, monkeypatch):
    from vigil.operators import features

    monkeypatch.setattr(features, "RUN", 7)
    df = spark.createDataFrame([("a", i, float(i)) for i in range(50)] + [("b", i, float(-i)) for i in range(3)], "k string, seq bigint, v double")
    got = {r.seq: (list(r.steps), r.target) for r in features.sequences(df, "k", "seq", "v", 5).collect()}
    assert got == {i: ([float(x) for x in range(i - 4, i + 1)], float(i + 1) if i < 49 else None) for i in range(4, 50)}


def test_ngrams_take_linear_time(spark):
    from vigil.operators import features

    odd = spark.createDataFrame([("aB\U0001f600c",), ("a",), (None,), ("",)], "text string")
    assert sorted(g for r in odd.select(features.grams_of(F.col("text")).alias("g")).collect() for g in r.g) == sorted(["ab", "b\U0001f600", "\U0001f600c", "ab\U0001f600", "b\U0001f600c", "ab\U0001f600c"])
    long = spark.createDataFrame([("abcd" * 100_000,)], "text string")
    assert {r.gram: (r.n, r.docs) for r in features.gram_totals(long, "text").collect()}["abcd"] == (100_000, 1)


@pytest.mark.parametrize("table", [1 << 22, 200, 1])
def test_ngrams_of_few_keys_are_counted_without_a_sort(monkeypatch, table):
    import numpy as np

    from vigil.operators import features

    monkeypatch.setattr(features, "TABLE", table, raising=False)
    if table > 200:
        monkeypatch.setattr(np, "argsort", lambda *a, **k: pytest.fail("sorted"))
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab\u00e9\u6f22\U0001f600") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 40, 40, 300)]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    got = {r["gram"]: (r["n"], r["docs"]) for b in features._counted(points, np.repeat(np.arange(len(texts)), [*map(len, texts)]), 2, 4) for r in b.to_pylist()}
    want = {}
    for t in texts:
        own = [t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)]
        for g in own:
            n, docs = want.get(g, (0, 0))
            want[g] = (n + 1, docs)
        for g in set(own):
            want[g] = (want[g][0], want[g][1] + 1)
    assert got == want


def test_a_rule_that_fails_leaves_the_others(spark):
    failed = {}
    rows = tel(spark, {"cpu": 90.0})
    got = rules.run_rules(rows, rules.RULES | {"broken": lambda t: t.select("no_such_column")}, failed)
    assert [r.rule_id for r in got.collect()] == ["high_cpu"] and set(failed) == {"broken"}


def test_models_are_saved_and_loaded(spark, tmp_path):
    from vigil.operators import models

    rows = spark.createDataFrame([(float(i), float(-i), i % 2) for i in range(40)], "a double, b double, label int")
    model = models.network_net(rows, ["a", "b"])
    assert model.stages[-1].getLayers() == [2, 128, 64, 2] if hasattr(model.stages[-1], "getLayers") else True
    models.save(model, str(tmp_path / "m"))
    assert models.load(str(tmp_path / "m")).transform(rows).count() == 40


def test_network_passes_over_distinct_rows_and_learns_as_sparks_own(spark):
    """Gradients are those of differences, repeated rows are one with a number, and the loss is no worse than that of Spark's learner."""
    import numpy as np
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    from vigil.operators import models

    rng = np.random.default_rng(2)
    x, label, n = rng.normal(size=(9, 2)), rng.integers(0, 2, 9), rng.integers(1, 4, 9).astype(float)
    layers = [2, 3, 4, 2]
    w = rng.normal(size=9 + 16 + 10)
    got = models.network_loss(w, layers, x, label, n)
    assert got == pytest.approx(models.network_loss(w, layers, np.repeat(x, n.astype(int), axis=0), np.repeat(label, n.astype(int)), np.ones(int(n.sum()))))
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-5
        assert got[1 + i] == pytest.approx((models.network_loss(w + e, layers, x, label, n)[0] - models.network_loss(w - e, layers, x, label, n)[0]) / 2e-5, abs=1e-5)

    rows = spark.createDataFrame([(i % 20 / 10.0, i % 7 / 7.0, int(i % 20 > 9)) for i in range(700)], "a double, b double, label int")
    model = models.network_net(rows, ["a", "b"])
    put = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    plain = MultilayerPerceptronClassifier(layers=[2, 128, 64, 2], seed=42, maxIter=30).fit(put)
    cost = lambda m, df: m.transform(df).select(F.avg(-F.log(F.get(models.vector_to_array("probability"), F.col("label"))))).first()[0]
    ours = np.array([(r.a, r.b) for r in rows.collect()]), np.array([r.label for r in rows.collect()])
    assert cost(model, rows) == pytest.approx(models.network_loss(model.stages[-1].weights.toArray(), [2, 128, 64, 2], *ours, np.ones(700))[0] / 700)
    assert cost(model, rows) <= cost(plain, put) + 0.02
