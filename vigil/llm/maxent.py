"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) P(cell | class, history) P(word | cell).
Words are put into classes by the company they keep; within its class a hash deals
a word to a cell. Class and cell are each a softmax over hashed features of the two
words before: each alone (the second is a skip feature), both as a pair, and the
pair of their classes; for the cell, each alone together with the class. Weights are
a table of fixed size, trained in rounds: every task takes gradient steps over its
documents from the same weights, and their moves are averaged row by row in a tree
of small groups. Within a cell a word has its smoothed count.

The table is the bounded part. What a word's own histories say is counted without
bound: how often each word followed the word before, and the two before. Their
relative frequency takes a share of the probability, so those of all words still add
up to 1. The share depends on how often the history occurs and is the one that tells
all training tokens best when none counts for itself. What class, cell and count say of
a token is kept until the shares are known, so it is worked out once.

Text is read into words once: a task turns documents into blocks of word numbers,
all later passes read those. Counts never meet in one place: a block deals its
words, pairs and triples by ranges of their hashes into as many parts as there are
blocks; a part adds what the blocks counted and answers each in its own order.
Blocks meet their answers in a few shares, one after another, so that only a share
of them is in shuffle files beside the tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import drop, release, tables, written

from .langid import held_out
from .words import Words, mix, slices
from .workers import clear, tidy

#: Classes, cells of a class, rows of each weight table, rounds, tokens of a step, step size.
CLASSES, CELLS, ROWS, ROUNDS, STEP, RATE = 16, 16, 1 << 14, 3, 8192, 0.3
#: Shares that histories may take; tokens that speak for no share, and powers of two of a history's occurrences told apart.
SHARES, DOUBT, SIZES = np.array([0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]), 8.0, 40
#: Bits that a ratio of probabilities loses when tokens are counted by it (8 ratios to a factor of two), and the ratios told apart, 0 first.
LOST = 20
RATIOS = np.append(0, (np.arange(1, 0x7F800000 >> LOST) << LOST) + (1 << (LOST - 1))).astype(np.int32).view(np.float32).astype(np.float64)
#: Tokens of a step that touch one row of the table and are added a token at a time; of more, all at once.
FEW = 6
#: Tokens whose features and histories are worked out at once, in arrays as small as a cache.
AT_ONCE = 1 << 14
#: Starts of words (a power of two) that classes are made of: the hash of the first three bytes.
STARTS = 512
#: Bits of a pair's or triple's hash. Of 10^13 of them one in 500 meets another.
KEY_BITS = 52
#: Shares in which blocks meet the counts of their words and histories; a share has so many bytes of text at least.
MEETINGS, MET_BYTES = 4, 24 << 20
#: Bytes of text of a block; tokens of a kept row; rows of a piece of the table; pieces that are added at once.
BLOCK_BYTES, KEPT, CHUNK, TREE = 6 << 20, 1 << 17, 512, 64
_U = np.uint64
_END = _U(0x5DEECE66D0000000)
_START = _U(0x3C6EF372FE94F820)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words with one end for each text, where each text begins, and the end).

    The low bits of an id are its start: of words, by their first three bytes; of ends, 0.
    """
    w = Words(texts)
    low = np.where((w.raw >= 65) & (w.raw <= 90), w.raw + 32, w.raw)
    low = np.append(low, np.zeros(3, np.uint8))
    size = w.ends - w.starts
    head = low[w.starts].astype(_U) + np.where(size > 1, low[w.starts + 1], 0).astype(_U) * _U(256) + np.where(size > 2, low[w.starts + 2], 0).astype(_U) * _U(65536)
    start = mix(head) % _U(STARTS - 1) + _U(1)
    ids = (w.hashes & ~_U(STARTS - 1)) | start
    bounds = w.bounds + np.arange(len(w.bounds))
    out = np.empty(len(ids) + len(texts), _U)
    ends = bounds[1:] - 1
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[ends], out[~is_end] = _END, ids
    return out, bounds


def starts(ids: np.ndarray) -> np.ndarray:
    return (ids & _U(STARTS - 1)).astype(np.int64)


def cells(ids: np.ndarray) -> np.ndarray:
    return ((ids >> _U(9)) & _U(CELLS - 1)).astype(np.int64)


def classes(pairs: np.ndarray) -> np.ndarray:
    """A class of each start, from how often each start follows each: k-means over the square roots of its neighbours' shares."""
    near = pairs + pairs.T
    weight = near.sum(axis=1)
    x = np.sqrt(near / np.maximum(1, weight)[:, None])
    middle = x[[int(weight.argmax())]]
    far = ((x - middle) ** 2).sum(axis=1)
    while len(middle) < CLASSES:
        middle = np.concatenate([middle, x[[int((far * np.sqrt(weight)).argmax())]]])
        far = np.minimum(far, ((x - middle[-1]) ** 2).sum(axis=1))
    for _ in range(20):
        of = ((x * x).sum(axis=1)[:, None] - 2 * x @ middle.T + (middle * middle).sum(axis=1)).argmin(axis=1)
        share = np.zeros((CLASSES, STARTS))
        share[of, np.arange(STARTS)] = weight
        total = share.sum(axis=1, keepdims=True)
        middle = np.where(total > 0, share @ x / np.maximum(total, 1), middle)
    return of.astype(np.int64)


@dataclass
class Block:
    """Documents as word numbers: of each token its place in vocab, and where each document begins, and the end."""

    number: int
    vocab: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray
    held: np.ndarray
    doc_id: pa.Array

    @property
    def learned(self) -> np.ndarray:
        """Of each token, whether its document trains."""
        return np.repeat(~self.held, np.diff(self.bounds))


def _squeezed(x: np.ndarray) -> bytes:
    """Integers, lowest bytes of all first."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _restored(body: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_BLOCK = "block bigint, vocab binary, codes binary, sizes binary, held_out array<boolean>, doc_id array<bigint>"


def _blocked(most: int):
    """Documents (doc_id, held_out, text) into blocks of about `most` bytes of text; a longer text is a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()
        number = TaskContext.get().partitionId() << 32
        ids, sizes, keys, held, size = [], [], [], [], 0

        def made() -> pa.RecordBatch:
            coded = pa.array(np.concatenate(ids).view(np.int64)).dictionary_encode()
            vocab, codes = np.array(coded.dictionary).view(_U), np.array(coded.indices, dtype=np.int32)
            body = (_squeezed(vocab), _squeezed(codes), _squeezed(np.concatenate(sizes).astype(np.int32)))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.chunked_array(held).combine_chunks(), pa.chunked_array(keys).combine_chunks())]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([b], pa.binary()) for b in body], *lists], ["block", "vocab", "codes", "sizes", "held_out", "doc_id"])

        for b in tidy(batches):
            for first, texts in slices(b.column("text")):
                t, bounds = tokens(texts)
                ids.append(t)
                sizes.append(np.diff(bounds))
                keys.append(b.column("doc_id").slice(first, len(texts)))
                held.append(b.column("held_out").slice(first, len(texts)))
                size += sum(map(len, texts))
                if size >= most:
                    yield made()
                    ids, sizes, keys, held, size = [], [], [], [], 0
                    number += 1
        if ids:
            yield made()

    return run


def _blocks(rows: pa.RecordBatch | pa.Table) -> Iterator[Block]:
    for i in range(rows.num_rows):
        one = lambda c: rows.column(c)[i]  # noqa: B023, E731
        sizes = _restored(one("sizes").as_py(), np.int32)
        keys = one("doc_id").values if "doc_id" in rows.schema.names else pa.nulls(len(sizes), pa.int64())
        yield Block(
            one("block").as_py(), _restored(one("vocab").as_py(), _U), _restored(one("codes").as_py(), np.int32),
            np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.array(one("held_out").values.to_pylist(), bool), keys,
        )


def _before(ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The word before each token, and the one before that."""
    before = [np.empty_like(ids), np.empty_like(ids)]
    for n, b in enumerate(before, 1):
        b[n:], b[:n] = ids[:-n], _START
        for m in range(n):
            at = bounds[:-1] + m
            b[at[at < bounds[1:]]] = _START
    return before


def features(ids: np.ndarray, bounds: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table for each token: 4 that tell its class, and 2 that tell its cell."""
    before = _before(ids, bounds)
    first, second = np.empty((4, len(ids)), np.uint16), np.empty((2, len(ids)), np.uint16)
    for a in range(0, len(ids), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        first[:, part], second[:, part] = _features(ids[part], *(b[part] for b in before), class_of)
    return first, second


def _features(ids: np.ndarray, one: np.ndarray, two: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds = (class_of[starts(one)] * CLASSES + class_of[starts(two)]).astype(_U)
    raw = (one + _U(1), two * _U(3) + _U(2), mix(one) + two * _U(5), kinds + _U(0x51ED270B) * (one == _START))
    own = class_of[starts(ids)].astype(_U) * _U(0x9E3779B97F4A7C15)
    scrambled = [mix(x + _U(i * 0x1000003)) for i, x in enumerate(raw)]
    first = np.stack([(x & _U(ROWS - 1)).astype(np.uint16) for x in scrambled])
    second = np.stack([((((x ^ own) * _U(0xD6E8FEB86659FD93)) >> _U(40)) & _U(ROWS - 1)).astype(np.uint16) + np.uint16(ROWS) for x in scrambled[:2]])
    return first, second


def histories(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Keys of each token with the word before, and with the two before, 2 by tokens."""
    before, out = _before(ids, bounds), np.empty((2, len(ids)), _U)
    for a in range(0, len(ids), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        own, one, two = ids[part], *(b[part] for b in before)
        pair = mix(one * _U(3) + _U(0x7F4A7C15)) + own
        triple = mix(mix(two * _U(5) + _U(0x2545F491)) + one) + own
        out[0, part], out[1, part] = (mix(x) >> _U(64 - KEY_BITS) for x in (pair, triple))
    return out


#: Arrays that steps use again and again, by name: new ones of this size would be mapped and cleared each time.
_room: dict[str, np.ndarray] = {}


def _rows(name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table, in an array that holds until the next call with the name."""
    room = _room.get(name)
    if room is None or len(room) < len(at) or room.shape[1] != table.shape[1] or room.dtype != table.dtype:
        room = _room[name] = np.empty((len(at), table.shape[1]), table.dtype)
    return table.take(at, 0, out=room[: len(at)], mode="clip")


def _summed(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = _rows("sum", weights, rows[0])
    for r in rows[1:]:
        z += _rows("part", weights, r)
    return z


def _grouped(g: np.ndarray, order: np.ndarray, first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums of g's rows by group, in order: of a group the rows order[first : first + times].

    Small groups are added a row of each at a time, as a reduction has a cost for each row;
    like a reduction, they add the first row to the sum of the others.
    """
    step = np.empty((len(first), g.shape[1]), g.dtype)
    many = np.flatnonzero(times > FEW)
    if len(many):
        n = times[many]
        ends = np.cumsum(n)
        spot = np.repeat(first[many] - (ends - n), n) + np.arange(ends[-1])
        step[many] = np.add.reduceat(_rows("many", g, order[spot]), ends - n, axis=0)
    for k in range(1, FEW + 1):
        own = np.flatnonzero(times == k)
        total = g.take(order[first[own] + min(k - 1, 1)], 0)
        for i in [*range(2, k), 0][: k - 1]:
            total += _rows("few", g, order[first[own] + i])
        step[own] = total
    return step


def log_odds(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logs of the softmax at each token's class or cell."""
    z = _summed(weights, rows)
    z -= np.ascontiguousarray(z.T).max(axis=0)[:, None]
    own = z[np.arange(len(z)), target]
    np.exp(z, out=z)
    return own - np.log(z @ np.ones(z.shape[1], z.dtype))


class Steps:
    """Gradient steps over one table from shared weights; rows keep how often they were touched."""

    def __init__(self, weights: np.ndarray):
        self.w, self.seen, self.power = weights.copy(), np.zeros(len(weights)), np.full(len(weights), 1e-2, np.float32)

    def take(self, rows: np.ndarray, target: np.ndarray) -> None:
        n = len(target)
        g = _summed(self.w, rows)
        np.exp(np.minimum(g, 60, out=g), out=g)
        g *= (1 / (g @ np.ones(g.shape[1], g.dtype)))[:, None]
        g[np.arange(n), target] -= 1
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])
        count = np.diff(np.append(first, len(ranked)))
        at, times = ranked[first], count.astype(np.float32)
        step = _grouped(g, order % n, first, count)
        power = self.power[at] + np.einsum("ij,ij->i", step, step) / (times * step.shape[1])
        self.power[at] = power
        step *= (RATE / len(rows) / np.sqrt(times * power))[:, None]
        self.w[at] -= step
        self.seen[at] += times


def train(weights: np.ndarray, class_of: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(weights after one pass of gradient steps over (ids, bounds), tokens that touched each row)."""
    steps = Steps(weights)
    for ids, bounds in parts:
        if not len(ids):
            continue
        first, second = features(ids, bounds, class_of)
        kind, cell = class_of[starts(ids)], cells(ids)
        for a in range(0, len(ids), STEP):
            steps.take(first[:, a : a + STEP], kind[a : a + STEP])
            steps.take(second[:, a : a + STEP], cell[a : a + STEP])
    return steps.w, steps.seen


def _by_rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(chunk, task, body) of a table that a task adds."""
    task = TaskContext.get().partitionId()
    for c in range(len(table) // CHUNK):
        body = table[c * CHUNK : (c + 1) * CHUNK].astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([task]), pa.array([body.tobytes()], pa.binary())], ["chunk", "task", "body"])


_TABLE = "chunk bigint, task bigint, body binary"


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.column("body"))
    one = table.slice(0, 1)
    return pa.table({"chunk": one.column("chunk"), "task": pa.array([one.column("task")[0].as_py() // TREE]), "body": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _total(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    """The sum of all tasks' tables, TREE pieces at a time."""
    left = parts.rdd.getNumPartitions()
    while True:
        parts = parts.groupBy("chunk", F.floor(F.col("task") / TREE).alias("g")).applyInArrow(_added, _TABLE)
        left = -(-left // TREE)
        if left <= 1:
            break
    out = np.zeros((rows, width), np.float32)
    for r in parts.toArrow().to_pylist():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["body"], np.float32).reshape(CHUNK, width)
    return out


def fit(blocks: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, class of each start) from all training documents of blocks; each trains in one round."""
    spark = blocks.sparkSession
    read = blocks.select("block", "vocab", "codes", "sizes", "held_out")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(STARTS * STARTS)
        for b in tidy(batches):
            for k in _blocks(b):
                s = starts(k.vocab)[k.codes][k.learned]
                pairs += np.bincount(s[:-1] * STARTS + s[1:], minlength=STARTS * STARTS)
        if pairs.any():
            yield from _by_rows(pairs.reshape(STARTS, STARTS))

    class_of = classes(_total(read.mapInArrow(follow, _TABLE), STARTS, STARTS).astype(np.float64))
    weights = np.zeros((2 * ROWS, CLASSES), np.float32)
    for n in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def chosen(b: pa.RecordBatch, n=n) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for k in _blocks(b):
                keep, sizes = ~k.held & (np.arange(len(k.held)) % rounds == n), np.diff(k.bounds)
                yield k.vocab[k.codes[np.repeat(keep, sizes)]], np.concatenate([[0], np.cumsum(sizes[keep])])

        def moves(batches: Iterator[pa.RecordBatch], shared=shared, chosen=chosen) -> Iterator[pa.RecordBatch]:
            start = shared.value
            w, seen = train(start, class_of, (x for b in tidy(batches) for x in chosen(b)))
            if seen.any():
                yield from _by_rows(np.concatenate([(w - start) * seen[:, None], seen[:, None]], axis=1))

        got = _total(read.mapInArrow(moves, _TABLE), 2 * ROWS, CLASSES + 1)
        seen = got[:, -1:]
        weights = weights + np.divide(got[:, :-1], seen, out=np.zeros_like(got[:, :-1]), where=seen > 0)
        release(spark)
    return weights, class_of


_PART = "block bigint, part bigint, body binary"


def _dealt(keys: np.ndarray, n: np.ndarray, bits: int, block: int, parts: int) -> pa.RecordBatch:
    """Sorted keys (as steps from one to the next) and their counts, cut by the keys' high bits into parts."""
    part = ((keys >> _U(bits - 32)) * _U(parts)) >> _U(32)
    cut = np.flatnonzero(np.diff(part, prepend=part[:1] + _U(1)))
    body = [_squeezed(np.diff(k, prepend=_U(0))) + _squeezed(c.astype(np.uint32)) for k, c in zip(np.split(keys, cut[1:]), np.split(n, cut[1:]))]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(cut), pa.int64()), pa.array(part[cut].astype(np.int64)), pa.array(body, pa.binary())], ["block", "part", "body"])


def _opened(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a part of a block."""
    first = zstandard.ZstdDecompressor().decompressobj()
    keys = np.frombuffer(first.decompress(body), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(keys.T).view(_U).ravel(), dtype=_U), _restored(first.unused_data, np.uint32)


def _words_of(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(batches):
            for k in _blocks(b):
                order = np.argsort(k.vocab)
                yield _dealt(k.vocab[order], np.bincount(k.codes, k.learned, len(k.vocab))[order], 64, k.number, parts)

    return run


def _histories_of(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(batches):
            for k in _blocks(b):
                keys = histories(k.vocab[k.codes], k.bounds)
                keys = np.sort(((keys << _U(1)) | k.learned.astype(_U)).ravel())
                first = np.concatenate([[0], np.flatnonzero((keys[1:] >> _U(1)) != (keys[:-1] >> _U(1))) + 1]) if len(keys) else np.empty(0, np.int64)
                n = np.add.reduceat(keys & _U(1), first) if len(keys) else keys
                yield _dealt(keys[first] >> _U(1), n, KEY_BITS, k.number, parts)

    return run


def _answered(class_of: np.ndarray | None = None):
    """For each block, in the order of its keys, their counts in all blocks. Of words also a row without a block: leaves, and their tokens and words of training."""

    def run(table: pa.Table) -> pa.Table:
        got = [_opened(x.as_py()) for x in table.column("body")]
        ends = np.cumsum([len(k) for k, _ in got])
        keys = np.concatenate([k for k, _ in got])
        order = np.argsort(keys)
        new = np.concatenate([[True], np.diff(keys[order]) != 0])
        total = np.add.reduceat(np.concatenate([n for _, n in got])[order].astype(np.int64), np.flatnonzero(new))
        n = np.empty(len(keys), np.int64)
        n[order] = total[np.cumsum(new) - 1]
        block, body = table.column("block").to_pylist(), [_squeezed(x) for x in np.split(n, ends[:-1])]
        if class_of is not None:
            words = keys[order][new]
            leaf = (class_of[starts(words)] * CELLS + cells(words))[total > 0]
            at, back = np.unique(leaf, return_inverse=True)
            sums = np.bincount(back, total[total > 0], len(at)).astype(np.int64), np.bincount(back, minlength=len(at)).astype(np.int64)
            block.append(None)
            body.append(_squeezed(np.concatenate([at, *sums]).astype(np.int64)))
        part = table.column("part")[0].as_py()
        return pa.table({"block": pa.array(block, pa.int64()), "part": pa.array([part] * len(block), pa.int64()), "body": pa.array(body, pa.binary())})

    return run


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in tidy(batches):
        for x in b.column("body"):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _restored(x.as_py(), np.int64).reshape(3, -1))), ["leaf", "n", "v"])


@dataclass
class Model:
    """What scoring knows besides the counts of a block's own words and histories.

    n, v: tokens and distinct words of each leaf. share: of the word before, and of the two before, by the size of the history.
    """

    weights: np.ndarray
    class_of: np.ndarray
    n: np.ndarray
    v: np.ndarray
    share: np.ndarray

    def alone(self, k: Block, c: np.ndarray) -> np.ndarray:
        """Probability of each token by class, cell and count."""
        ids = k.vocab[k.codes]
        leaf = self.class_of[starts(ids)] * CELLS + cells(ids)
        p = (c + 0.5) / (self.n + 0.5 * (self.v + 1))[leaf]
        first, second = features(ids, k.bounds, self.class_of)
        for a in range(0, len(ids), STEP):
            own = leaf[a : a + STEP]
            odds = log_odds(self.weights, first[:, a : a + STEP], own // CELLS) + log_odds(self.weights, second[:, a : a + STEP], own % CELLS)
            p[a : a + STEP] *= np.exp(odds.astype(np.float64))
        return p

    def base(self, k: Block, c: np.ndarray) -> list[np.ndarray]:
        """Of each document: tokens, known tokens, base score. c: counts of tokens."""
        begin = k.bounds[:-1]
        base = np.log10(c + 0.5) - np.log10(self.n.sum() + 0.5 * (self.v.sum() + 1))
        return [np.diff(k.bounds), np.add.reduceat((c > 0).astype(np.int64), begin), np.add.reduceat(base, begin)]

    def scores(self, k: Block, c_of: np.ndarray, followed: np.ndarray, documents: int) -> list[np.ndarray]:
        """Of each document: tokens, known tokens, base score, score. c_of: counts of vocab; followed: counts of histories, 2 by tokens; documents: those of training."""
        c = c_of[k.codes]
        return [*self.base(k, c), mixed(self.share, self.alone(k, c), _rates(k.learned, k.bounds, c, followed, documents), k.bounds)]


def mixed(shares: np.ndarray, p: np.ndarray, rates: Iterable[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray) -> np.ndarray:
    """The score of each document: p are its tokens' probabilities by class, cell and count, rates what their histories say."""
    for share, (rate, size) in zip(shares, rates):
        p = p + share[size] * (rate - p)
    return np.add.reduceat(np.log10(p), bounds[:-1])


def evidence(p: np.ndarray, rates: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What a share adds to the log probability of tokens, by history, its size and share; of two words before with the best shares of one.

    Only the ratio of the history's rate to p matters, so tokens are counted by it.
    """
    told = np.log1p(SHARES * (RATIOS[:, None] - 1))
    out = np.zeros((2, SIZES, len(SHARES)))
    for found, (rate, size) in zip(out, rates):
        ratio = (rate / p).astype(np.float32).view(np.int32) >> LOST
        found[:] = np.bincount(size * len(RATIOS) + ratio, minlength=SIZES * len(RATIOS)).reshape(SIZES, -1) @ told
        p = p + SHARES[_best(found)][size] * (rate - p)
    return out


def _best(evidence: np.ndarray) -> np.ndarray:
    """The best share for each size, none for histories that do not occur."""
    best = (evidence + DOUBT * np.log1p(-SHARES)).argmax(axis=-1)
    best[..., 0] = 0
    return best


def _rates(learned: np.ndarray, bounds: np.ndarray, c: np.ndarray, followed: np.ndarray, documents: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the word before and the two before: how often the token follows the history, by the history's occurrences, and their size.

    A word is followed as often as it occurs, a pair as often as the second follows
    the first. A token of training does not count for itself.
    """
    own = learned.astype(np.int64)
    for n, known in zip(followed, (c, followed[0])):
        times = np.empty(len(c), np.int64)
        times[1:] = known[:-1]
        times[bounds[:-1]] = documents
        times = np.maximum(times - own, 0)
        yield np.maximum(n - own, 0) / np.maximum(times, 1), np.minimum(np.frexp(times.astype(np.float64))[1], SIZES - 1)


_KEPT = "held_out array<boolean>, doc_id array<bigint>, n_tokens array<bigint>, n_known array<bigint>, base_score array<double>, alone binary, counts binary, wide boolean, documents bigint, evidence array<double>"


def _kept(model: Model, k: Block, c_of: np.ndarray, followed: np.ndarray, documents: int) -> pa.Table:
    """What mixing needs of a block, in rows of about KEPT tokens; the first has what its training tokens tell about shares."""
    c, learned = c_of[k.codes], k.learned
    p, base = model.alone(k, c).astype(np.float32), model.base(k, c)
    told = evidence(p[learned].astype(np.float64), ((rate[learned], size[learned]) for rate, size in _rates(learned, k.bounds, c, followed, documents)))
    cut = np.unique(np.searchsorted(k.bounds, np.arange(0, k.bounds[-1], KEPT)))
    cut = cut[cut < len(k.held)]
    ends = np.append(cut[1:], len(k.held))
    listed = lambda x: pa.ListArray.from_arrays(pa.array(np.append(cut, len(k.held)).astype(np.int32)), x if isinstance(x, pa.Array) else pa.array(x))
    spans, wide = list(zip(k.bounds[cut], k.bounds[ends])), bool(max(c.max(), followed.max()) >= 1 << 32)
    whole = k.doc_id.combine_chunks() if isinstance(k.doc_id, pa.ChunkedArray) else k.doc_id
    return pa.table({
        "held_out": listed(k.held), "doc_id": listed(whole), "n_tokens": listed(base[0].astype(np.int64)), "n_known": listed(base[1]), "base_score": listed(base[2]),
        "alone": pa.array([_squeezed(p[a:b]) for a, b in spans], pa.binary()),
        "counts": pa.array([_squeezed(np.concatenate([c[a:b], *followed[:, a:b]]).astype(np.int64 if wide else np.uint32)) for a, b in spans], pa.binary()),
        "wide": pa.array([wide] * len(spans)),
        "documents": pa.array([documents] * len(spans), pa.int64()), "evidence": pa.array([told.ravel(), *[[]] * (len(spans) - 1)], pa.list_(pa.float64())),
    })


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Null texts are empty: one end. Without training documents all counts are 0 and
    classes and cells are equally likely. Rows that repeat are scored alike, each on
    its own; a null doc_id trains. A training document's words count for themselves,
    its pairs and triples of words do not. An empty table gives no rows.
    """
    spark, had = docs.sparkSession, set(tables())
    dealt = docs.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "text")
    blocks = written(dealt.mapInArrow(_blocked(block_bytes), _BLOCK), "blocks")
    weights, class_of = fit(blocks)
    parts = max(1, blocks.count())
    coded = blocks.select("block", "vocab", "codes", "sizes", "held_out")
    words = written(coded.mapInArrow(_words_of(parts), _PART).groupBy("part").applyInArrow(_answered(class_of), _PART), "words")
    release(spark)
    n, v = np.zeros(CLASSES * CELLS), np.zeros(CLASSES * CELLS)
    for r in words.where("block is null").select("body").mapInArrow(_leaves, "leaf bigint, n bigint, v bigint").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["leaf"]], v[r["leaf"]] = r["n"], r["v"]
    pairs = written(coded.mapInArrow(_histories_of(parts), _PART).groupBy("part").applyInArrow(_answered(), _PART), "histories")
    release(spark)
    told = words.where("block is not null").withColumn("kind", F.lit(0)).unionByName(pairs.withColumn("kind", F.lit(1)))
    model = Model(weights, class_of, n, v, np.zeros((2, SIZES)))

    asked, done = spark.sparkContext.broadcast(model), [t for t in tables() if t not in had]
    meetings = min(MEETINGS, max(1, parts * block_bytes // MET_BYTES))
    kept = None
    for m in range(meetings):
        own, answers = (x.where(F.pmod(F.hash("block"), F.lit(meetings)) == m).groupBy("block") for x in (blocks, told))
        met = written(own.cogroup(answers).applyInArrow(lambda rows, told: _kept(asked.value, *_counted(rows, told)), _KEPT), "kept")
        kept = met if kept is None else kept.unionByName(met)
        del own, answers, met
        release(spark)
    drop(spark, *done)

    found = np.zeros(2 * SIZES * len(SHARES))
    for r in kept.select(F.posexplode("evidence").alias("at", "found")).groupBy("at").agg(F.sum("found").alias("found")).collect():
        found[r["at"]] = r["found"]
    shares, total = SHARES[_best(found.reshape(2, SIZES, -1))], int(n.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidy(batches):
            for i in range(b.num_rows):
                one = lambda name: b.column(name)[i]  # noqa: B023, E731
                held, sizes = one("held_out").values, np.array(one("n_tokens").values)
                bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                c, *followed = _restored(one("counts").as_py(), np.int64 if one("wide").as_py() else np.uint32).astype(np.int64).reshape(3, -1)
                learned = np.repeat(~np.array(held.to_pylist(), bool), sizes)
                p = _restored(one("alone").as_py(), np.float32).astype(np.float64)
                mix = mixed(shares, p, _rates(learned, bounds, c, followed, one("documents").as_py()), bounds)
                columns = [one("doc_id").values, held, one("n_tokens").values, one("n_known").values, pa.array(np.full(len(sizes), total)), one("base_score").values, pa.array(mix)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return kept.drop("evidence").mapInArrow(run, out)


def _counted(rows: pa.Table, told: pa.Table) -> tuple[Block, np.ndarray, np.ndarray, int]:
    """A block with the counts of its vocab, those of its tokens' histories, and the number of training documents."""

    def counts(kind: int) -> np.ndarray:
        own = told.filter(pc.equal(told.column("kind"), kind)).sort_by("part")
        return np.concatenate([_restored(x.as_py(), np.int64) for x in own.column("body")])

    (k,) = _blocks(rows)
    c = np.empty(len(k.vocab), np.int64)
    c[np.argsort(k.vocab)] = counts(0)
    keys = histories(k.vocab[k.codes], k.bounds).ravel()
    order = np.argsort(keys)
    new = np.append(False, keys[order][1:] != keys[order][:-1])
    followed = np.empty(len(keys), np.int64)
    followed[order] = counts(1)[np.cumsum(new)]
    return k, c, followed.reshape(2, -1), int(c[k.vocab == _END].sum())


def op10(docs: DataFrame) -> DataFrame:
    return score(docs)
