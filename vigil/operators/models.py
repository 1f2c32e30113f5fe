"""Trained models: forests, sequence classifier and forecaster, with save and load."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, MinMaxScaler, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import written

from .features import followed, grams_of, ranges, scaled_vectors, time_cut, vector_sequences
from .forest import fitted

#: What the sector models look at: metrics, and rows of a window.
HEALTH, HEALTH_STEPS, URBAN, URBAN_STEPS = ("cpu", "memory", "network", "requests"), 20, ("network", "requests"), 10
#: A window is followed by trouble if a login fails within so many events of its sector.
AHEAD = 5


def grams(df: DataFrame, text: str, low: int = 2, high: int = 4) -> DataFrame:
    return df.withColumn("grams", grams_of(F.col(text), low, high))


def web_forest(train: DataFrame, vocabulary: int = 5_000, trees: int = 50, depth: int = 20) -> PipelineModel:
    """Weighted character n-grams and a forest, for rows (grams, label)."""
    stages = [CountVectorizer(inputCol="grams", outputCol="tf", minDF=3, vocabSize=vocabulary), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features", p=2.0)]
    weighed = Pipeline(stages=stages).fit(train)
    return PipelineModel([*weighed.stages, fitted(weighed.transform(train), trees=trees, depth=depth, seed=42)])


def with_attacks(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Normal sensor rows (temperature, humidity, water, n, p, k) as label 0, and a third of them each as two made attacks: hot and dry, and all 255."""
    names = ("temperature", "humidity", "water", "n", "p", "k")
    third = lambda s: rows.select(*names).where(F.pmod(F.xxhash64(F.lit(s), *names), F.lit(3)) == 0)
    hot = third("hot").withColumns({"temperature": 45 + F.rand(seed) * 15, "humidity": 5 + F.rand(seed + 1) * 10, "label": F.lit(1)})
    full = third("full").select(*[F.lit(255.0).alias(c) for c in names]).withColumn("label", F.lit(1))
    return rows.select(*names).withColumn("label", F.lit(0)).unionByName(hot).unionByName(full)


def sensor_forest(train: DataFrame, trees: int = 100) -> PipelineModel:
    names = ["temperature", "humidity", "water", "n", "p", "k"]
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), RandomForestClassifier(numTrees=trees, seed=42)]).fit(train)


def flat(df: DataFrame, window: str, length: int) -> DataFrame:
    """A column for each place of a window of numbers."""
    return df.withColumns({f"x{i}": F.get(window, F.lit(i)).cast("double") for i in range(length)})


def sequence_classifier(train: DataFrame, length: int) -> PipelineModel:
    """In place of a recurrent network: logistic regression on the scaled window x0.. for rows with a label."""
    return Pipeline(stages=[VectorAssembler(inputCols=[f"x{i}" for i in range(length)], outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="features"), LogisticRegression(maxIter=20)]).fit(train)


def forecaster(train: DataFrame, length: int, target: str = "target") -> PipelineModel:
    """In place of a recurrent network: linear regression on the lagged window."""
    return Pipeline(stages=[VectorAssembler(inputCols=[f"x{i}" for i in range(length)], outputCol="features"), LinearRegression(labelCol=target, maxIter=20, regParam=1e-3)]).fit(train)


def network_loss(weights: np.ndarray, layers: list[int], x: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cross-entropy of rows that count n times each, and its gradient, as one array; sigmoid layers, softmax last, weights as Spark lays them out."""
    at, parts, acts = 0, [], [x]
    with np.errstate(over="ignore"):
        for i, o in zip(layers, layers[1:]):
            parts.append((weights[at : at + i * o].reshape(i, o), weights[at + i * o : at + i * o + o]))
            at += i * o + o
            z = acts[-1] @ parts[-1][0] + parts[-1][1]
            acts.append(1 / (1 + np.exp(-z)) if len(parts) < len(layers) - 1 else z - z.max(axis=1, keepdims=True))
    z = acts.pop()
    logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    row = np.arange(len(x))
    delta = np.exp(logs)
    delta[row, label] -= 1
    delta *= n[:, None]
    out = []
    for a, (w, _) in zip(acts[::-1], parts[::-1]):
        out = [(a.T @ delta).ravel(), delta.sum(axis=0), *out]
        delta = (delta @ w.T) * a * (1 - a)
    return np.concatenate([[-(logs[row, label] * n).sum()], *out])


def descended(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int, memory: int = 10, tol: float = 1e-6) -> np.ndarray:
    """Weights after `rounds` steps of limited-memory BFGS whose steps meet the Wolfe conditions."""
    f, g = loss(w)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y in reversed(moved):
            kept.append((s @ d) / (s @ y))
            d = d - kept[-1] * y
        if moved:
            d = d * (moved[-1][0] @ moved[-1][1]) / (moved[-1][1] @ moved[-1][1])
        for (s, y), k in zip(moved, reversed(kept)):
            d = d + s * (k - (y @ d) / (s @ y))
        slope, low, high = g @ d, 0.0, np.inf
        step = 1.0 if moved else 1 / max(1e-12, float(np.sqrt(g @ g)))
        for _ in range(20):
            f1, g1 = loss(w + step * d)
            if f1 > f + 1e-4 * step * slope:
                high = step
            elif g1 @ d < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * step
        if not f1 < f:
            break
        moved = [*moved[-(memory - 1) :], (step * d, g1 - g)] if (step * d) @ (g1 - g) > 0 else moved
        small, w, f, g = f - f1 <= tol * max(abs(f), abs(f1)), w + step * d, f1, g1
        if small:
            break
    return w


def network_net(train: DataFrame, inputs: list[str], rounds: int = 30) -> PipelineModel:
    """A network of two hidden layers. Spark's own learner gives the first weights and holds the last ones.

    Between, a pass over the rows is matrix products of whole batches in the tasks,
    which are many times faster than in the JVM; rows that repeat are one with their number.
    """
    layers, spark = [len(inputs), 128, 64, 2], train.sparkSession
    rows = train.groupBy(*[F.col(c).cast("double").alias(c) for c in inputs], F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # A task tells the driver one row of sums, so tasks are as many as the cluster keeps busy.
    rows = rows.coalesce(max(16, 2 * spark.sparkContext.defaultParallelism)).persist()
    one = spark.createDataFrame([(*[0.0] * len(inputs), 0)], ", ".join([*[f"`{c}` double" for c in inputs], "label int"]))
    held = lambda **k: Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), MultilayerPerceptronClassifier(layers=layers, seed=42, maxIter=0, **k)]).fit(one)
    start = held().stages[-1].weights.toArray()
    total = rows.agg(F.sum("n")).first()[0] or 0.0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(shared.value) + 1)
            for b in batches:
                *x, label, n = (np.array(c) for c in b.columns)
                for a in range(0, len(n), 4096):
                    sums += network_loss(shared.value, layers, np.stack(x, axis=1)[a : a + 4096], label[a : a + 4096], n[a : a + 4096])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        sums = sum(np.frombuffer(x.as_py()) for x in rows.mapInArrow(run, "sums binary").toArrow().column("sums"))
        shared.destroy()
        return float(sums[0] / total), sums[1:] / total

    found = descended(loss, start, rounds) if total else start
    rows.unpersist()
    return held(initialWeights=Vectors.dense(found))


def sensors(tel: DataFrame) -> DataFrame:
    """Telemetry rows as (event_id, seq, temperature, humidity, water, n, p, k)."""
    made = {"temperature": 20 + F.col("cpu") / 10, "humidity": 40 + F.col("memory") / 4, "water": F.col("network") / 10, "n": F.col("cpu") / 2, "p": F.col("memory") / 2, "k": F.col("cpu") / 3}
    return tel.where("network is not null and cpu is not null and memory is not null").select("event_id", "seq", *[c.alias(n) for n, c in made.items()])


def sector_windows(tel: DataFrame, sector: str, columns: tuple[str, ...], length: int, cut: int) -> DataFrame:
    """Windows of vectors of a sector's metrics: (seq, steps, target, label, past, future), steps flat and scaled by ranges of rows up to cut.

    label: whether a login of the sector fails within the next AHEAD events, which
    is no function of the metrics. past: the window and what its label looks at lie
    up to cut; future: the whole window lies beyond it. Windows across the cut are neither.
    """
    own = tel.where(F.col("domain") == sector)
    rows = own.where(" and ".join(f"{c} is not null" for c in columns))
    spans = ranges(rows.where(F.col("seq") <= cut), *columns)
    trouble = followed(own, "domain", "seq", F.col("event_type") == "auth_failure", AHEAD).select(F.col("seq").alias("_seq"), F.col("followed").cast("int").alias("label"))
    first = vector_sequences(rows.withColumn("_place", F.col("seq")), "domain", "seq", (*columns, "_place"), length)
    head, drop_place = F.element_at(F.element_at("steps", 1), -1), lambda v: F.slice(v, 1, len(columns))
    made = first.withColumns({"_first": head, "_after": F.element_at("target", -1), "target": drop_place(F.col("target"))})
    steps = scaled_vectors(F.transform("steps", drop_place), spans)
    made = made.join(trouble, F.col("seq") == F.col("_seq"), "left")
    last_seen = F.coalesce(F.col("_after"), F.col("seq"))
    return made.select("seq", F.flatten(steps).alias("steps"), "target", "label", (last_seen <= cut).alias("past"), (F.col("_first") > cut).alias("future"))


def health_windows(tel: DataFrame, share: float = 0.8) -> DataFrame:
    """Windows of the healthcare metrics as columns, written once for all who read them."""
    return written(flat(sector_windows(tel, "healthcare", HEALTH, HEALTH_STEPS, time_cut(tel, "seq", share)), "steps", len(HEALTH) * HEALTH_STEPS).drop("steps", "target"), "windows")


def trained(tel: DataFrame, folder: str, share: float = 0.8, windows: DataFrame | None = None) -> dict[str, str]:
    """Trains the sector models on the first `share` of time, saves them in the folder and gives their paths: agri (with made attacks) and health. windows: health_windows(), where they are made."""
    cut = time_cut(tel, "seq", share)
    past = sensors(tel.where((F.col("domain") == "agriculture") & (F.col("seq") <= cut)))
    windows = health_windows(tel, share) if windows is None else windows
    made = {"agri": sensor_forest(with_attacks(past)), "health": sequence_classifier(windows.where("past and label is not null"), len(HEALTH) * HEALTH_STEPS)}
    paths = {name: f"{folder}/{name}" for name in made}
    for name, model in made.items():
        save(model, paths[name])
    return paths


def predicted(tel: DataFrame, paths: dict[str, str], share: float = 0.8, windows: DataFrame | None = None) -> DataFrame:
    """(event_id, agri_attack, health_probability) of loaded models for events after the first `share` of time; the past, which they learned from, is not judged."""
    cut = time_cut(tel, "seq", share)
    later = sensors(tel.where((F.col("domain") == "agriculture") & (F.col("seq") > cut)))
    agri = verdict(load(paths["agri"]), later, 0.5).select("event_id", F.col("is_attack").alias("agri_attack"), F.lit(None).cast("double").alias("health_probability"))
    windows = health_windows(tel, share) if windows is None else windows
    health = verdict(load(paths["health"]), windows.where("future")).select("seq", "probability_1")
    named = tel.where("domain = 'healthcare'").select("event_id", "seq").join(health, "seq").select("event_id", F.lit(None).cast("boolean").alias("agri_attack"), F.col("probability_1").alias("health_probability"))
    return agri.unionByName(named)


def verdict(model: PipelineModel, rows: DataFrame, over: float = 0.7) -> DataFrame:
    """rows with probability of label 1 and whether it is above the cut."""
    return model.transform(rows).withColumn("probability_1", F.get(vector_to_array("probability"), F.lit(1))).withColumn("is_attack", F.col("probability_1") > over)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
