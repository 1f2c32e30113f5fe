"""Windows of vectors and the sector models: split by time, and in the chain of verdicts."""

import os

import pytest
from pyspark.sql import functions as F

from vigil.operators import features, models, rules
from vigil.plans import learning
from vigil.sources.telemetry import telemetry_of

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def tel(spark):
    return telemetry_of(spark, SF).cache()


def test_windows_keep_past_and_future_apart(tel):
    rows = {r.seq: r for r in tel.where("domain = 'healthcare' and network is not null").collect()}
    order = sorted(rows)
    cut = learning.cut_of(tel)
    past = [rows[s] for s in order if s <= cut]
    lo, hi = min(r.network for r in past), max(r.network for r in past)
    got = {r.seq: r for r in models.sector_windows(tel, "healthcare", models.HEALTH, 20, cut).collect()}
    assert sorted(got) == order[19:]
    for i, s in enumerate(order[19:]):
        window = order[i : i + 20]
        assert got[s].steps[2::4] == pytest.approx([(rows[w].network - lo) / (hi - lo) for w in window])
        assert got[s].future == (window[0] > cut) and got[s].past == ((order[i + 20] if i + 20 < len(order) else s) <= cut)
    assert sum(r.past for r in got.values()) > 20 and sum(r.future for r in got.values()) > 20


def test_followed(tel):
    got = {(r.domain, r.seq): r.followed for r in features.followed(tel, "domain", "seq", F.col("event_type") == "auth_failure", 3).collect()}
    by = {}
    for r in sorted(tel.select("domain", "seq", "event_type").collect(), key=lambda r: r.seq):
        by.setdefault(r.domain, []).append(r)
    for d, rows in by.items():
        for i, r in enumerate(rows):
            after = rows[i + 1 : i + 4]
            assert got[(d, r.seq)] == (any(a.event_type == "auth_failure" for a in after) if len(after) == 3 else None)


def test_trained_models_raise_alerts(spark, tel, tmp_path):
    """A quarantine is raised for the later events alone that the stored model finds likely and no layer before it stops."""
    alerts = {r.event_id for r in learning.model_alerts(tel, str(tmp_path)).collect()}
    assert sorted(os.listdir(tmp_path)) == ["agri", "health"]
    said = models.predicted(tel, {n: str(tmp_path / n) for n in ("agri", "health")})
    likely = {r.event_id for r in said.where("health_probability > 0.7").collect()}
    stopped = {r.event_id for r in rules.layered_verdict(rules.model_request(tel)).where("status = 'blocked'").collect()}
    assert alerts == likely - stopped
    cut = learning.cut_of(tel)
    assert said.join(tel.where(F.col("seq") <= cut), "event_id", "left_semi").count() == 0
    isolated = rules.layered_verdict(rules.model_request(tel), said).where("status = 'isolated'")
    assert {r.event_id for r in isolated.collect()} == {r.event_id for r in said.where("agri_attack").collect()} - stopped


def test_windows_are_made_once(tel, tmp_path, monkeypatch):
    made, plain = [], models.sector_windows
    monkeypatch.setattr(models, "sector_windows", lambda *a: made.append(a[1]) or plain(*a))
    learning.model_alerts(tel, str(tmp_path))
    assert made == ["healthcare"]
