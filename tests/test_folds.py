"""Folds over a key that spans many partitions equal one pass over its rows."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import folds
from vigil.operators.folds import Baseline, Cooldown, Health, device_step

US = 1_000_000


def kept(rows, us):
    last, out = {}, set()
    for k, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1] if r[1] is not None else -1, r[2])):
        if t is not None and (k not in last or t - last[k] >= us):
            last[k] = t
            out.add(i)
    return out


@pytest.fixture
def many(spark):
    """Many small ranges: adaptive execution would join them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("us", [1, 7, 60, 100_000])
def test_cooldown_over_a_hot_key(many, us):
    rng = random.Random(us)
    rows = [(None if i % 31 == 0 else "hot" if i % 9 else f"k{i % 5}", None if i % 97 == 0 else rng.randrange(4000), i) for i in range(3000)]
    df = many.createDataFrame(rows, "k string, t bigint, seq bigint")
    got = folds.cooldown(df, ["k"], "t", us)
    assert {r.seq for r in got.collect()} == kept(rows, us) and got.columns == df.columns
    parts = folds.checkpointed(df.repartitionByRange("k", "t")).select(F.spark_partition_id().alias("p"), "k").where("k = 'hot'").distinct().count()
    assert parts > 10


def test_baseline_over_a_hot_key(many):
    rng = random.Random(2)
    rows = [("hot" if i % 9 else f"k{i % 5}", i, i, None if i % 50 == 7 else rng.random() * 9 - (2 if i % 3 else 0)) for i in range(3000)]
    got = {r.seq: (r.baseline, r.is_spike) for r in folds.baseline(many.createDataFrame(rows, "source_ip string, ts_us bigint, seq bigint, v double"), "v").collect()}
    state = {}
    for k, _, i, x in rows:
        base = state.get(k, 0.0)
        spike = x is not None and base > 0 and x > base * 3
        base = base if x is None else base * 0.9 + x * 0.1 if base > 0 else x
        state[k] = base
        assert got[i][0] == pytest.approx(base) and got[i][1] == spike


def test_health_over_a_hot_key(many):
    rng = random.Random(4)
    rows = [("hot" if i % 9 else f"k{i % 5}", i, i, rng.choice([0, 0, 0, None, 10, 15])) for i in range(3000)]
    got = {r.seq: (r.health, r.status) for r in folds.device_health(many.createDataFrame(rows, "device string, ts_us bigint, seq bigint, damage int")).collect()}
    state = {}
    for k, _, i, d in rows:
        state[k] = device_step(state.get(k, (100, "online")), d or 0)
        assert got[i] == state[k]


@pytest.mark.parametrize("machine, make, entries", [
    (Cooldown("t", 13), lambda r: sorted(r.randrange(120) for _ in range(r.randrange(30))), [None, -20, -5, 0]),
    (Baseline("v", 0.9, 3.0), lambda r: [r.uniform(-3, 5) for _ in range(r.randrange(30))], [0.0, -1.0, 0.2, 3.0, 50.0]),
    (Health(), lambda r: [r.choice([0, 0, 10, 15]) for _ in range(r.randrange(60))], [[100, "online"], [5, "compromised"], [69, "warning"], [71, "x"]]),
])
def test_functions_of_a_run(machine, make, entries):
    """A run's function gives what replaying the run from an entry gives, and functions compose."""
    import json

    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(200):
        values = make(rng)
        cut = rng.randint(0, len(values))
        whole = [pa.array(values, pa.float64() if isinstance(machine, Baseline) else pa.int64())]
        run = machine.told(machine.told(machine.open(), [whole[0].slice(0, cut)]), [whole[0].slice(cut)])
        function = json.loads(json.dumps(machine.function(run)))
        for entry in entries:
            state, _ = machine.replay(entry, whole)
            after = machine.after(function, entry)
            if isinstance(machine, Baseline):
                assert after == pytest.approx(state, abs=1e-9) or (after <= 1e-9 and state <= 1e-9)
            else:
                assert after == state


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, t bigint, seq bigint")
    assert folds.cooldown(none, ["k"], "t", 5).count() == 0
