"""Random forest on sparse vectors: rows stay as sparse as they are, and a level of all trees is one pass of whole blocks.

Spark's own learner holds a row as one number for each feature, 20 KB at 5,000
features, so its cache is many times the input. Here a row is its values that are
not 0, as numbers of bins. The method is that of Spark's learner: up to 32 bins a
feature, a Poisson(1) weight for each row and tree, the root of the features tried
at a node, Gini gain. Its model class holds the trees.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import drop, made_path, tables, written

#: Bins of a feature, and rows from which their limits are learned, both as in Spark's learner; all rows are counted in them.
BINS, LIMIT_ROWS = 32, 10_000
#: Numbers of a dense block of rows, and how many values meet nodes together, at most.
DENSE, LOOKED_UP = 1 << 23, 1 << 22
#: Counts that a task holds in one pass. Nodes that have more take more passes.
CELLS = 1 << 22
BLOCKS = "ends binary, feature binary, bin binary, label binary, weight binary"
NODE = "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"


def limits_of(values: np.ndarray, zeros: int, bins: int = BINS) -> np.ndarray:
    """Limits between the bins of a feature from its values that are not 0 and the number of rows where it is 0, as Spark's learner sets them."""
    value, n = np.unique(values, return_counts=True)
    if zeros:
        at = np.searchsorted(value, 0.0)
        value, n = np.insert(value, at, 0.0), np.insert(n, at, zeros)
    middle = (value[1:] + value[:-1]) / 2
    if len(middle) < bins:
        return middle
    before, stride, found = np.cumsum(n), n.sum() / bins, []
    target = stride
    for i in range(len(middle)):
        if abs(before[i] - target) < abs(before[i + 1] - target):
            found.append(middle[i])
            target += stride
    return np.array(found)


def limits(rows: DataFrame, vector: str, total: int, features: int) -> list[np.ndarray]:
    """Limits of each feature, from some LIMIT_ROWS of the rows."""
    share = min(1.0, LIMIT_ROWS / max(1, total))
    some = rows if share == 1 else rows.sample(False, share, 42)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            n += b.num_rows
            for name in ("indices", "values"):
                assert b.column(0).field(name).null_count == 0, "vectors are sparse"
            yield pa.RecordBatch.from_arrays([b.column(0).field("indices").flatten(), b.column(0).field("values").flatten()], ["feature", "value"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([float(n)])], ["feature", "value"])

    values = written(some.select(vector).mapInArrow(told, "feature int, value double"), "limits")
    path = tables()[-1]
    seen = int(values.where("feature = -1").agg(F.sum("value")).first()[0] or 0)

    def one(key: tuple, t: pa.Table) -> pa.Table:
        v = t.column("value").to_numpy()
        return pa.table({"feature": pa.array([key[0].as_py()], pa.int32()), "limits": pa.array([limits_of(v[v != 0], seen - np.count_nonzero(v))], pa.list_(pa.float64()))})

    found = [np.zeros(0)] * features
    for r in values.where("feature >= 0").groupBy("feature").applyInArrow(one, "feature int, limits array<double>").toArrow().to_pylist():
        found[r["feature"]] = np.array(r["limits"])
    drop(rows.sparkSession, path)
    return found


def binned(table: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The bin of each value: how many limits of its feature lie below it. table: limits by feature, filled up with infinity to a power of two."""
    at, base, step = np.zeros(len(feature), np.int64), feature.astype(np.int64) * table.shape[1], table.shape[1] // 2
    flat = table.ravel()
    while step:
        at += step * (flat[base + at + step - 1] < value)
        step //= 2
    return at + (flat[base + at] < value)


def blocks(rows: DataFrame, vector: str, label: str, found: list[np.ndarray], trees: int, seed: int) -> DataFrame:
    """Rows as blocks: where rows end, features and bins of values that are not in the bin of 0, labels, and each tree's weight of each row."""
    features, width = len(found), 1 << max(len(x) for x in found).bit_length()
    table = np.full((features, width), np.inf)
    for i, x in enumerate(found):
        table[i, : len(x)] = x
    zero = binned(table, np.arange(features), np.zeros(features))
    if zero.any():
        raise ValueError("values below 0")
    shared, size = rows.sparkSession.sparkContext.broadcast(table), max(1, DENSE // features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        for b in batches:
            for a in range(0, b.num_rows, size):
                part = b.slice(a, size)
                at, v = part.column(0).field("indices"), part.column(0).field("values")
                feature = at.flatten().to_numpy()
                bins = binned(shared.value, feature, v.flatten().to_numpy())
                ends = np.cumsum(pc.list_value_length(at).to_numpy())
                keep = bins > 0
                ends = np.append(0, np.cumsum(keep))[ends]
                weight = rng.poisson(1.0, (part.num_rows, trees)).astype(np.uint8)
                made = (ends.astype(np.int32), feature[keep].astype(np.int32), bins[keep].astype(np.uint8), part.column(1).to_numpy().astype(np.int32), weight)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in made], ["ends", "feature", "bin", "label", "weight"])

    out = written(rows.select(vector, F.col(label).cast("int")).mapInArrow(run, BLOCKS), "forest")
    shared.destroy()
    return out


class Trees:
    """Nodes of all trees as columns; the two children of a node lie side by side. Roots are the first nodes."""

    def __init__(self, trees: int):
        self.trees, self.feature, self.cut, self.child, self.depth, self.gain, self.counts = trees, [-1] * trees, [0] * trees, [-1] * trees, [0] * trees, [-1.0] * trees, [None] * trees
        self.tree = list(range(trees))

    def split(self, node: int, feature: int, cut: int, gain: float, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.child[node], self.gain[node] = feature, cut, at, gain
        for counts in (left, right):
            for column, value in ((self.feature, -1), (self.cut, 0), (self.child, -1), (self.depth, self.depth[node] + 1), (self.gain, -1.0), (self.counts, counts), (self.tree, self.tree[node])):
                column.append(value)
        return at, at + 1

    def columns(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int64) for x in (self.feature, self.cut, self.child))


def reached(flat: np.ndarray, base: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The last nodes that rows come to from the nodes given. flat: bins of a dense block; base: where a row begins in it."""
    go = np.arange(len(node))
    while True:
        f = feature[node[go]]
        go, f = go[f >= 0], f[f >= 0]
        if not len(go):
            return node
        n = node[go]
        node[go] = child[n] + (flat[base[go] + f] > cut[n])


def best(counts: np.ndarray) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """Of counts (feature, bin, class): the feature and the last bin of the left side with the highest Gini gain, the gain, and the classes of the sides."""
    gini = lambda c, n: 1 - (c * c).sum(axis=-1) / np.maximum(n * n, 1)
    c = counts.astype(float)
    total = c[0].sum(axis=0)
    left = c.cumsum(axis=1)[:, :-1]
    right = total - left
    n, nl, nr = total.sum(), left.sum(axis=-1), right.sum(axis=-1)
    gain = gini(total, n) - (nl * gini(left, nl) + nr * gini(right, nr)) / max(n, 1)
    gain[(nl == 0) | (nr == 0)] = -1.0
    f, b = divmod(int(gain.argmax()), gain.shape[1])
    return f, b, float(gain[f, b]), left[f, b], right[f, b]


def pass_over(made: DataFrame, grown: Trees, nodes: list[int], tried: np.ndarray, features: int, bins: int, classes: int) -> list[dict]:
    """The best split of each of the nodes: (slot, total, feature, cut, gain, left, right). tried: the features looked at, a row for each node.

    Tasks count what their blocks hold at the nodes, Spark adds the counts up by node, and one row a node is told.
    """
    spark, k = made.sparkSession, tried.shape[1]
    cells = (k * bins + 1) * classes
    slot = np.full(len(grown.feature), -1)
    slot[nodes] = np.arange(len(nodes))
    trees_of = np.array([grown.tree[n] for n in nodes])
    shared = spark.sparkContext.broadcast((*grown.columns(), slot, np.unique(trees_of), tried.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *nodes_of, slots, own, looked = shared.value
        lookers = np.argsort(looked.ravel(), kind="stable")
        start = np.searchsorted(looked.ravel()[lookers], np.arange(features + 1))
        place = np.searchsorted(own, trees_of)
        counts = np.zeros(len(looked) * cells, np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                ends, feature, bin_, label = (np.frombuffer(block[c], t) for c, t in (("ends", np.int32), ("feature", np.int32), ("bin", np.uint8), ("label", np.int32)))
                weight = np.frombuffer(block["weight"], np.uint8).reshape(len(ends), -1)[:, own].astype(np.int64)
                row, tree = np.nonzero(weight)
                entry = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                flat = np.zeros(len(ends) * features, np.uint8)
                flat[entry * features + feature] = bin_
                at = slots[reached(flat, row * features, own[tree], *nodes_of)]
                open_ = at >= 0
                np.add.at(counts, at[open_] * cells + k * bins * classes + label[row[open_]], weight[row[open_], tree[open_]])
                slot_of = np.full(weight.shape, -1)
                slot_of[row, tree] = at
                # Each value meets the nodes that look at its feature, and counts where its row is.
                for a in range(0, len(feature), LOOKED_UP // len(looked)):
                    z = slice(a, a + LOOKED_UP // len(looked))
                    first, many = start[feature[z]], start[feature[z] + 1] - start[feature[z]]
                    e = np.repeat(np.arange(len(many)), many)
                    s, j = np.divmod(lookers[first[e] + np.arange(len(e)) - (np.cumsum(many) - many)[e]], k)
                    r, t = entry[z][e], place[s]
                    hit = slot_of[r, t] == s
                    r, t, s, j = r[hit], t[hit], s[hit], j[hit]
                    np.add.at(counts, s * cells + (j * bins + bin_[z][e[hit]]) * classes + label[r], weight[r, t])
        some = np.flatnonzero(counts)
        for a in range(0, len(some), 1 << 18):
            z = some[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(z // cells, pa.int32()), pa.array(z % cells, pa.int32()), pa.array(counts[z])], ["slot", "cell", "n"])

    def one(key: tuple, t: pa.Table) -> pa.Table:
        counts = np.zeros(cells, np.int64)
        counts[t.column("cell").to_numpy()] = t.column("n").to_numpy()
        total, counts = counts[-classes:], counts[:-classes].reshape(k, bins, classes)
        counts[:, 0] += total - counts.sum(axis=1)
        j, cut, gain, left, right = best(counts)
        told = {"slot": key[0].as_py(), "total": total.astype(float), "feature": int(shared.value[-1][key[0].as_py(), j]), "cut": cut, "gain": gain, "left": left, "right": right}
        return pa.Table.from_pylist([told], schema)

    numbers = pa.list_(pa.float64())
    schema = pa.schema([("slot", pa.int32()), ("total", numbers), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()), ("left", numbers), ("right", numbers)])
    added = made.mapInArrow(run, "slot int, cell int, n bigint").repartition("slot").groupBy("slot", "cell").agg(F.sum("n").alias("n"))
    found = added.groupBy("slot").applyInArrow(one, "slot int, total array<double>, feature int, cut int, gain double, left array<double>, right array<double>").toArrow().to_pylist()
    shared.destroy()
    return found


def grown(made: DataFrame, features: int, bins: int, classes: int, trees: int, depth: int, seed: int) -> Trees:
    """Trees of the blocks, level by level."""
    out, k = Trees(trees), min(features, math.ceil(math.sqrt(features))) if trees > 1 else features
    ahead, most = list(range(trees)), max(1, CELLS // ((k * bins + 1) * classes))
    while ahead:
        now, ahead = ahead[:most], ahead[most:]
        tried = np.array([np.sort(np.random.default_rng((seed, n)).choice(features, k, replace=False)) for n in now])
        for r in sorted(pass_over(made, out, now, tried, features, bins, classes), key=lambda r: r["slot"]):
            node = now[r["slot"]]
            out.counts[node] = np.array(r["total"])
            if r["gain"] > 0 and out.depth[node] < depth:
                for child in out.split(node, r["feature"], r["cut"], r["gain"], np.array(r["left"]), np.array(r["right"])):
                    if out.depth[child] < depth and np.count_nonzero(out.counts[child]) > 1:
                        ahead.append(child)
    return out


def stored(trees: Trees, found: list[np.ndarray], classes: int) -> Iterator[tuple]:
    """Nodes as Spark's model format holds them. Two leaves of a node that say the same become one, as in Spark's learner."""
    for t in range(trees.trees):
        says = lambda n: int(np.argmax(trees.counts[n])) if trees.counts[n] is not None else 0
        # Children come after their parents, so from the last node to the first all below a node is settled before it.
        own = [n for n in range(len(trees.tree)) if trees.tree[n] == t]
        inner = {n for n in own if trees.child[n] >= 0}
        for n in reversed(own):
            a = trees.child[n]
            if n in inner and a not in inner and a + 1 not in inner and says(a) == says(a + 1):
                inner.discard(n)
        order, stack = [], [t]
        while stack:
            n = stack.pop()
            order.append(n)
            stack += [trees.child[n] + 1, trees.child[n]] if n in inner else []
        number = {n: i for i, n in enumerate(order)}
        for n in order:
            c = trees.counts[n] if trees.counts[n] is not None else np.zeros(classes)
            gini = float(1 - ((c / max(c.sum(), 1)) ** 2).sum())
            below = (trees.gain[n], number[trees.child[n]], number[trees.child[n] + 1], (trees.feature[n], [float(found[trees.feature[n]][trees.cut[n]])], -1)) if n in inner else (-1.0, -1, -1, (-1, [], -1))
            yield t, (number[n], float(says(n)), gini, [float(x) for x in c], int(c.sum()), *below)


def fitted(rows: DataFrame, vector: str = "features", label: str = "label", trees: int = 50, depth: int = 20, seed: int = 42) -> RandomForestClassificationModel:
    """A forest of rows (vector: sparse, no value below 0; label: 0, 1, ..) as Spark's model."""
    spark = rows.sparkSession
    total, last = rows.agg(F.count(F.lit(1)), F.max(F.col(label).cast("int"))).first()
    if not total:
        raise ValueError("no rows to learn from")
    classes, features = last + 1, rows.select(vector).first()[0].size
    found = limits(rows, vector, total, features)
    made = blocks(rows, vector, label, found, trees, seed)
    blocks_at = tables()[-1]
    out = grown(made, features, max(len(x) for x in found) + 1, classes, trees, depth, seed)
    one = spark.createDataFrame([(Vectors.sparse(features, [], []), i) for i in range(classes)], [vector, label])
    path = made_path(spark, "model")
    RandomForestClassifier(featuresCol=vector, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(one).write().overwrite().save(path)
    spark.createDataFrame(list(stored(out, found, classes)), NODE).write.mode("overwrite").parquet(os.path.join(path, "data"))
    model = RandomForestClassificationModel.load(path)
    drop(spark, blocks_at, path)
    return model
