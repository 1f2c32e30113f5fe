"""Queries of trained models: windows of vectors, models in the chain of verdicts, errors on later rows only.

Results of trained models are not the same in other libraries, so only the windows
have SQL; tests hold the rest against models fitted apart.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators import alerts, features, models, rules
from vigil.session import shared_dir

from .catalog import DAY, col, lit, over
from .console import pair
from .sql import TEL


def _windows(sector: str, columns: tuple[str, ...], length: int) -> str:
    """SQL of windows that are scaled by the ranges of the first 0.8 of time."""
    past = "(select min(seq) + (max(seq) - min(seq)) * 0.8::double from tel)"
    ends = ", ".join(f"min({c}) filter (seq <= floor({past})) as lo_{c}, max({c}) filter (seq <= floor({past})) as hi_{c}" for c in columns)
    vector = ", ".join(f"({c} - lo_{c}) / (hi_{c} - lo_{c})::double" for c in columns)
    return f"""with {TEL}, m as (select seq, {', '.join(f'{c}::double as {c}' for c in columns)} from tel where domain = '{sector}' and {' and '.join(f'{c} is not null' for c in columns)}),
 r as (select {ends} from m), v as (select seq, [{vector}] as v from m, r), w as (select seq, list(v) over (order by seq rows between {length - 1} preceding and current row) as steps from v)
 select seq, flatten(steps) as steps from w where len(steps) = {length}"""


def cut_of(tel: DataFrame) -> int:
    return features.time_cut(tel, "seq")


for _name, _sector, _columns, _length in (("health_vectors", "healthcare", models.HEALTH, models.HEALTH_STEPS), ("urban_vectors", "urban", models.URBAN, models.URBAN_STEPS)):
    pair(_name, _windows(_sector, _columns, _length))(
        lambda tel, s=_sector, c=_columns, n=_length: models.sector_windows(tel, s, c, n, cut_of(tel)).select("seq", "steps")
    )

pair(
    "followed_by_failure",
    f"""with {TEL}, n as (select *, row_number() over (partition by domain order by seq) as rn, count(*) over (partition by domain) as total from tel)
 select domain, seq, case when rn + {models.AHEAD} <= total then coalesce(bool_or(event_type = 'auth_failure') over (partition by domain order by seq rows between 1 following and {models.AHEAD} following), false) end as followed from n""",
)(lambda tel: features.followed(tel, "domain", "seq", col("event_type") == "auth_failure", models.AHEAD))


def model_alerts(tel: DataFrame, folder: str | None = None) -> DataFrame:
    """Alerts of all rules and layers with the sector models trained, stored, loaded and asked: those that a trained model raised."""
    folder = folder or os.path.join(shared_dir(tel.sparkSession), f"models-{uuid.uuid4().hex}")
    windows = models.health_windows(tel)
    said = models.predicted(tel, models.trained(tel, folder, windows=windows), windows=windows)
    hits = rules.every_hit(tel.join(said, "event_id", "left"), (DAY, 8), (DAY, 5))
    return alerts.alerts(hits).where("title = 'ML: AI Detection'").select("alert_id", "event_id", "rule_id", "title", "severity", "ts_us", "seq")


over("model_alerts")(model_alerts)


@over("agri_forest")
def _(tel: DataFrame) -> DataFrame:
    """Made attacks and normal rows that come after those the forest learned from."""
    cut, rows = cut_of(tel), models.sensors(tel)
    model = models.sensor_forest(models.with_attacks(rows.where(col("seq") <= cut)))
    later = models.with_attacks(rows.where(col("seq") > cut), seed=43)
    return models.verdict(model, later).groupBy("label", col("prediction").cast("int").alias("prediction")).agg(F.count(lit(1)).alias("n"))


@over("sequence_classifier")
def _(tel: DataFrame) -> DataFrame:
    size = len(models.HEALTH) * models.HEALTH_STEPS
    rows = models.flat(models.sector_windows(tel, "healthcare", models.HEALTH, models.HEALTH_STEPS, cut_of(tel)).where("label is not null"), "steps", size)
    return models.verdict(models.sequence_classifier(rows.where("past"), size), rows.where("future")).select("seq", "label", "is_attack", F.round("probability_1", 6).alias("probability"))


@over("forecast")
def _(tel: DataFrame) -> DataFrame:
    """The next vector of the urban metrics, one regression a metric, for windows after the past."""
    size = len(models.URBAN) * models.URBAN_STEPS
    rows = models.flat(models.sector_windows(tel, "urban", models.URBAN, models.URBAN_STEPS, cut_of(tel)).where("target is not null"), "steps", size)
    made = rows.withColumns({f"to_{c}": F.get("target", lit(i)) for i, c in enumerate(models.URBAN)})
    out = made.where("future")
    for c in models.URBAN:
        out = models.forecaster(made.where("past"), size, f"to_{c}").transform(out).drop("features").withColumnRenamed("prediction", f"next_{c}")
    return out.select("seq", *[x for c in models.URBAN for x in (f"to_{c}", f"next_{c}")])


@over("network_net")
def _(tel: DataFrame) -> DataFrame:
    """Whether a failed login follows a service's sample, told from its metrics; judged on later rows."""
    inputs = ["cpu", "memory", "network", "requests"]
    after = features.followed(tel, "service", "seq", col("event_type") == "auth_failure", 1).select("seq", col("followed").cast("int").alias("label"))
    rows = features.aligned(tel.where("cpu is not null").join(after, "seq").where("label is not null"), tuple(inputs), ("event_id", "seq", "label"))
    cut = cut_of(tel)
    model = models.network_net(rows.where(col("seq") < cut), inputs)
    return model.transform(rows.where(col("seq") > cut)).select("event_id", "label", col("prediction").cast("int").alias("prediction"))
