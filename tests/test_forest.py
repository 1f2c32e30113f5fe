"""The forest on sparse rows against plain loops."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from vigil.operators import forest, models
from vigil.session import tables


def binned(row, found):
    return [sum(row.get(f, 0.0) > t for t in found[f]) for f in range(len(found))]


def gini(counts):
    return 1 - sum((v / max(1, sum(counts))) ** 2 for v in counts)


@pytest.fixture(scope="module")
def sparse(spark):
    rng = random.Random(5)
    x = [{f: rng.choice((0.1, 0.2, 0.5, rng.random() + 0.01)) for f in rng.sample(range(40), rng.randint(0, 6))} for _ in range(600)]
    label = [int((3 in r) != (r.get(7, 0) > 0.2)) if rng.random() < 0.9 else 2 for r in x]
    return spark.createDataFrame([(i, Vectors.sparse(40, r), c) for i, (r, c) in enumerate(zip(x, label))], ["i", "features", "label"]).cache(), x, label


def test_every_node_is_split_as_by_brute_force(spark, sparse, monkeypatch):
    """However few rows a block has and few nodes a pass takes; and rows are held by their values that are not 0."""
    rows, x, label = sparse
    tried, plain = {}, forest.pass_over
    monkeypatch.setattr(forest, "DENSE", 40 * 50)
    monkeypatch.setattr(forest, "LOOKED_UP", 97)
    monkeypatch.setattr(forest, "CELLS", 2000)
    monkeypatch.setattr(forest, "pass_over", lambda made, grown, nodes, looked, *a: tried.update(zip(nodes, looked.tolist())) or plain(made, grown, nodes, looked, *a))
    found = forest.limits(rows, "features", 600, 40)
    made = forest.blocks(rows, "features", "label", found, 4, 42)
    tree = forest.grown(made, 40, max(map(len, found)) + 1, 3, 4, 6, 42)

    dense, labels, weight = [], [], []
    for b in made.collect():
        ends, at, bins, own = (np.frombuffer(b[c], t).tolist() for c, t in (("ends", np.int32), ("feature", np.int32), ("bin", np.uint8), ("label", np.int32)))
        assert len(own) <= 50 and len(b.feature) + len(b.bin) == 5 * ends[-1]
        for begin, end in zip([0, *ends], ends):
            r = [0] * 40
            for j in range(begin, end):
                r[at[j]] = bins[j]
            dense.append(r)
        labels += own
        weight += np.frombuffer(b.weight, np.uint8).reshape(len(own), 4).tolist()
    assert sorted(zip(dense, labels)) == sorted((binned(r, found), c) for r, c in zip(x, label))
    assert 0.9 < np.mean(weight) < 1.1 and len({tuple(w) for w in weight}) > 50

    counted = lambda at, t: [sum(weight[i][t] for i in at if labels[i] == c) for c in range(3)]
    inside = {t: [i for i in range(600) if weight[i][t]] for t in range(4)}
    for n, t in enumerate(tree.tree):
        own = inside[n]
        total = counted(own, t)
        assert list(tree.counts[n]) == total
        gains = {}
        for f in tried.get(n, ()):
            for cut in range(len(found[f])):
                sides = [counted([i for i in own if (dense[i][f] > cut) == s], t) for s in (False, True)]
                if all(map(sum, sides)):
                    gains[f, cut] = gini(total) - sum(sum(s) * gini(s) for s in sides) / sum(total)
        if tree.child[n] >= 0:
            f, cut = tree.feature[n], tree.cut[n]
            assert tree.gain[n] == pytest.approx(max(gains.values())) and tree.gain[n] == pytest.approx(gains[f, cut])
            for side in (0, 1):
                inside[tree.child[n] + side] = [i for i in own if (dense[i][f] > cut) == side]
        else:
            assert tree.depth[n] == 6 or np.count_nonzero(total) <= 1 or max(gains.values(), default=0) < 1e-12
    assert max(tree.depth) == 6 and len(tried) > 20


def test_the_model_is_sparks_and_says_what_the_trees_say(spark, sparse, monkeypatch, tmp_path):
    rows, x, _ = sparse
    kept, plain, before = {}, forest.grown, tables()
    monkeypatch.setattr(forest, "grown", lambda *a: kept.setdefault("trees", plain(*a)))
    monkeypatch.setattr(forest, "limits", lambda *a, plain=forest.limits: kept.setdefault("limits", plain(*a)))
    model = forest.fitted(rows, trees=5, depth=4)
    assert tables() == before and (model.getNumTrees, model.numClasses, model.numFeatures) == (5, 3, 40)
    tree, found = kept["trees"], kept["limits"]
    model.write().save(str(tmp_path / "m"))
    got = type(model).load(str(tmp_path / "m")).transform(rows).select("i", "prediction", vector_to_array("probability").alias("p")).collect()
    # Leaves that say the same are joined, so what a tree says is told by the highest node below which all leaves agree.
    says = lambda n: {int(np.argmax(tree.counts[n]))} if tree.child[n] < 0 else says(tree.child[n]) | says(tree.child[n] + 1)
    for g in got:
        r, want = binned(x[g.i], found), np.zeros(3)
        for n in range(5):
            while len(says(n)) > 1:
                n = tree.child[n] + (r[tree.feature[n]] > tree.cut[n])
            want += tree.counts[n] / tree.counts[n].sum()
        assert g.p == pytest.approx((want / 5).tolist()) and g.prediction == np.argmax(g.p)


def test_limits_are_those_of_sparks_learner(spark):
    """A forest of one tree, one level deep, without draws splits where Spark's tree does."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rng = random.Random(1)
    assert forest.limits_of(np.array([2.0, 1.0, 2.0]), 5).tolist() == [0.5, 1.5] and forest.limits_of(np.zeros(0), 5).tolist() == []
    for zeros, many in ((900, 100), (0, 300), (50, 950), (990, 10)):
        v = [rng.random() + 0.01 for _ in range(many)] + [0.0] * zeros
        found = forest.limits_of(np.array([a for a in v if a]), zeros)
        for goal in (0.05, 0.3, 0.7):
            rows = spark.createDataFrame([(Vectors.dense([a]), int(a > goal)) for a in v], ["features", "label"])
            debug = DecisionTreeClassifier(maxDepth=1).fit(rows).toDebugString
            if "<=" in debug:
                at = float(debug.split("<= ")[1].split(")")[0])
                assert min(abs(found - at)) < 1e-12


def test_web_forest_keeps_no_row_as_a_number_for_each_feature(spark, monkeypatch):
    """Its learner is not given dense rows: what it stores of a row grows with the row's n-grams, not with the vocabulary."""
    held, plain = [], forest.blocks

    def seen(*a):
        out = plain(*a)
        held.extend(sum(map(len, b)) / (len(b.label) / 4) for b in out.collect())
        return out

    monkeypatch.setattr(forest, "blocks", seen)
    texts = spark.range(400).select(F.concat(F.when(F.col("id") % 3 == 0, "<script>").otherwise("q="), F.col("id").cast("string")).alias("t"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    rows = models.grams(texts, "t")
    model = models.web_forest(rows, trees=10, depth=5)
    assert len(model.stages[0].vocabulary) > 150 and max(held) < 4 + 4 + 10 + 5 * 40
    assert models.verdict(model, rows).where(F.col("prediction") == F.col("label")).count() == 400
