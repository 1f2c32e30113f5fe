"""Importance resampling against counting word runs one by one."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vigil.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text, a, b, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(" ".join(words[i : i + k]).encode()) % n for k in range(a, b + 1) for i in range(len(words) - k + 1)], len(words)


TEXTS = [None, "", " \n!!", "one", "a b a b a b c", "Ünï café 中文 x1 2y", "the same the same the same", "the same the same the same", "word " * 30_000, *[f"alpha beta{i % 7} gamma {i} delta alpha beta" * 4 for i in range(60)]]


@pytest.mark.parametrize("shortest, longest, n", [(1, 1, 10_000), (1, 3, 50), (2, 4, 997), (5, 5, 64)])
def test_resample(spark, shortest, longest, n):
    rows = [(i if i else None, t, "x", 1) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, buckets string, rank int").repartition(3)
    target = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "the same word")], "item_id int, text string")
    made = {i if i else None: buckets(t, shortest, longest, n) for i, t in enumerate(TEXTS)}
    s = collections.Counter(b for f, _ in made.values() for b in f)
    t = collections.Counter(b for x in ("alpha beta gamma", "the same word") for b in buckets(x, shortest, longest, n)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + n) / ((s[b] + 1) * (sum(t.values()) + n)))) for b in s}
    want = {}
    for i, (f, words) in made.items():
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        want[i] = [len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words]
    able = sorted((i for i, x in want.items() if x[3] >= 20), key=lambda i: (-want[i][2], i))
    rank = {i: k + 1 for k, i in enumerate(able[: len(able) * 10 // 100])}
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(docs, target, shortest, longest, n).collect()}
    assert got == {i: (*x[:3], rank.get(i)) for i, x in want.items()} and rank


def test_resample_edges(spark):
    docs = spark.createDataFrame([(1, "w " * 30)] * 40, "doc_id bigint, text string")
    none = docs.limit(0).select("text")
    got = resample.resample(docs, none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21)) and len(got) == 40
    assert resample.resample(docs.limit(0), docs.select("text")).count() == 0
    assert resample.resample(docs.withColumn("doc_id", F.lit(None).cast("bigint")), none).count() == 40
    with pytest.raises(ValueError):
        resample.features(docs, 0, 1)
