"""Connected components of an edge table by alternating large and small stars.

Every round is one shuffle a star; rounds grow with the logarithm of the longest
path. Nodes and labels stay distributed, each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import checkpointed


#: A key of fewer rows is no hub; hubs that go to every task at most.
HUB, HUBS = 1 << 10, 50_000


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def meet(rows: DataFrame, told: DataFrame, key: str, total: int) -> DataFrame:
    """rows with what told (key, n, ...) says of their key; n: rows of the key, total: of all.

    Hubs have so many of the rows that there are few of them; they go to every
    task, so that the rows of one need not meet in one.
    """
    hub = max(HUB, 4 * total // HUBS)
    hubs = F.broadcast(told.where(F.col("n") >= hub).drop("n"))
    others = rows.join(hubs.select(key), key, "left_anti").join(told.where(F.col("n") < hub).drop("n"), key)
    return rows.join(hubs, key).unionByName(others)


def hubs(counts: DataFrame, key: str, total: int) -> DataFrame:
    """(key, shares) of counts (key, n) whose rows are too many for one task; few, as meet() says, so they can go to every task."""
    hub = max(HUB, 4 * total // HUBS)
    return counts.where(F.col("n") >= hub).select(key, F.ceil(F.col("n") / hub).cast("bigint").alias("_shares"))


def salted(rows: DataFrame, told: DataFrame, key: str, salt: Column, few: DataFrame) -> DataFrame:
    """rows joined with told (one row a key). The rows of a hub (few: hubs()) are dealt to its shares by salt, and each share gets a copy of what is told."""
    few = F.broadcast(few)
    dealt = rows.withColumn("_salt", salt).join(few, key, "left").withColumn("_share", F.coalesce(F.pmod("_salt", "_shares"), F.lit(0).cast("bigint"))).drop("_salt", "_shares")
    copies = told.join(few, key, "left").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_shares", F.lit(1).cast("bigint")) - 1))).drop("_shares")
    return dealt.join(copies, [key, "_share"]).drop("_share")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node with an edge to another: label is the least node it reaches.

    Loops and repeated edges are ignored; no edges give no rows.
    """
    rows = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    rows = checkpointed(rows)
    before, n = None, rows.count()
    while True:
        # Large star: every neighbour above a node meets the least of the node and its neighbours.
        both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m"), "n")
        large = meet(both, least, "a", n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: the lower neighbours of a node, and itself, meet the least of them.
        low = _least(large)
        small = meet(large, low, "a", n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        rows = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        # Stars are reached when no node is both a leaf and a root, and no leaf has two roots.
        state = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if state == before:
            return rows.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = state
