"""Conversation repair against a search over all edits, across chunks and levels."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vigil.llm import turns

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAME = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired text) of (initial, fault, role, text) rows by a search in order of cost and audit."""
    heap, done = [(0, "", 0, 0, "")], set()
    while heap:
        cost, audit, at, state, text = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, text[1:]
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in NEXT[state].keys() & {"u", "a"}:
            heapq.heappush(heap, (cost + 5, audit + "I", at, NEXT[state][role], f"{text}\n{NAME[role]}:"))
        if at < len(rows):
            initial, fault, role, own = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state, text))
            if fault in ("none", "truncated"):
                more = 5 if fault == "truncated" else 0
                if initial in NEXT[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, NEXT[state][initial], f"{text}\n{role}:{own}"))
                for r in NEXT[state].keys() & {"u", "a"}:
                    heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, NEXT[state][r], f"{text}\n{NAME[r]}:{own}"))


def expected(rows):
    """The result of damaged rows (turn, role, text) of one conversation, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, told = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none"
        seen.add((role, text))
        told.append((role[:1], fault, role, text))
    given = [t for t, _, _ in rows if t is not None]
    n = lambda f: sum(x[1] == f for x in told)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
    cost, audit, text = cheapest(told)
    return (max(given) - min(given) + 1 - len(set(given)) if given else 0, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversation(rng, n, conv):
    texts = ["Yes.", "No?", "what", "", " \n", "ok!", "Ünï."]
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", " "])
    return [(conv, rng.choice([None, t, t, t + 1]), role(), rng.choice(texts) + (str(rng.random()) + "." if rng.random() < 0.7 else "")) for t in range(n)]


@pytest.mark.parametrize("chunk, composed", [(8, 64), (2, 3)])
def test_repair(spark, monkeypatch, chunk, composed):
    monkeypatch.setattr(turns, "CHUNK", chunk)
    monkeypatch.setattr(turns, "COMPOSED", composed)
    rng = random.Random(5)
    rows = [r for conv in range(60) for r in conversation(rng, rng.randint(1, 9), conv)] + conversation(rng, 300, 99) + conversation(rng, 5, None)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    base = df.select("conv_id").unionByName(spark.range(100, 102).select(F.col("id").alias("conv_id")))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turns.repair(base, df.withColumn("copy", F.lit(0))).collect()}
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    assert {c: got[c] for c in by} == {c: expected(r) for c, r in by.items()}
    assert got[100] == got[101] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and len(got) == len(by) + 2


def test_damage_and_edges(spark):
    rows = [(i % 7, i, None if i % 5 == 0 else "assistant", None if i % 4 == 0 else f"Text {i}! Is it? Yes.", 1) for i in range(80)] + [(None, None, None, None, 1)] * 3
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, cost bigint").withColumn("Audit", F.lit("x"))
    by = {c: [] for c in [*range(7), None]}
    for conv, turn, role, text, _ in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turns.op11(df).collect()}
    assert got == {c: expected(r) for c, r in by.items()}
    assert turns.op11(df.limit(0)).count() == 0
