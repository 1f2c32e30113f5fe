"""Queries of the catalog against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from vigil.plans import catalog, console, feeds, learning, response, sql  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(sql.SQL[name])
    assert sorted(want.columns) == cols
    rows = lambda xs: sorted((tuple(map(plain, x)) for x in xs), key=repr)
    assert rows(tuple(r) for r in got.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_query_without_sql_runs(spark):
    for name in sorted(set(catalog.QUERIES) - set(sql.SQL)):
        assert catalog.QUERIES[name](spark, SF).count() >= 0, name


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_events_are_scanned_once(spark):
    """From events to hits, alerts and the timeline one scan; actions read their own steps only."""
    from vigil.sources.telemetry import telemetry_of

    tel = telemetry_of(spark, SF)
    assert scans(catalog.daily_hits(tel)) == 1 and scans(catalog.daily_alerts(tel)) == 1 and scans(catalog.QUERIES["timeline_top50"](spark, SF)) == 1
    assert scans(catalog.flagship(spark, SF)) == 0


def test_one_scan_says_what_single_rules_say(spark):
    from vigil.operators import rules
    from vigil.sources.telemetry import telemetry_of

    tel = telemetry_of(spark, SF)
    apart = rules.run_rules(tel, rules.RULES | {"rate_spike": lambda t: rules.rate_spike(t, 86400, 4), "brute_force": lambda t: rules.brute_force(t, 3600, 2)})
    apart = apart.unionByName(rules.model_hits(catalog.verdicts(tel)))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(rules.every_hit(tel, (86400, 4), (3600, 2))) == rows(apart)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("query,fit,trees,depth", [("web_forest", "web_forest", 50, 20), ("agri_forest", "sensor_forest", 100, 5)])
def test_forests_have_their_full_size(spark, monkeypatch, query, fit, trees, depth):
    from vigil.operators import models

    made, plain = [], getattr(models, fit)
    monkeypatch.setattr(models, fit, lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    catalog.QUERIES[query](spark, "/root/testdata/sf0.001")
    assert (made[0].stages[-1].getNumTrees, made[0].stages[-1].getOrDefault("maxDepth")) == (trees, depth)
    assert query != "web_forest" or made[0].stages[0].getOrDefault("vocabSize") == 5_000
