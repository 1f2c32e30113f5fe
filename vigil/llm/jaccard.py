"""Exact similarity join on word shingles: components of documents with Jaccard >= t.

1. Documents become shingle sets; equal sets are one class.
2. Candidates, of which each scheme finds all. Parts: sets x, y with |x| <= |y|
   and Jaccard >= t differ in at most |x| (1-t)/t shingles. Shingles are dealt into
   more parts than that by their hash, so one part at least is equal in both.
   Prefix: of shingles in one global order, linked sets share one of their first
   |x| - ceil(t |x|) + 1; shingles that a sample of documents shows to be common
   come last, which any order allows. Classes that share a part or a prefix
   shingle fall into one loose group (components over a star for each). Parts
   suit short shingles, which meet by chance, prefixes suit long ones. Of a prefix
   shingle that few classes share, all pairs are tried first by parity maps: a bit
   tells whether a bucket of shingles holds an odd number of them, so two sets
   differ in no fewer shingles than their maps differ in bits.
3. Token-group matrix. Loose groups are bundled into tasks. There similar sets are
   put into small groups whose union of shingles is one row of a matrix. A set opens
   only the groups whose union holds enough of it, and is compared exactly there. A
   walk from set to set visits each once; what is linked already is not compared
   again. A loose group over a size limit is cut into blocks, each a task of its own
   that a few sets of the whole group join. Most blocks of copies of one text then
   are one component; only sets outside of it meet the other blocks, by the same
   matrix, so no task gathers a group that grows.
4. The links found, at most one for each set and task, give the components.

Sets are compared by 64-bit shingle hashes, classes by a 64-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import checkpointed, release, written

from .components import components, meet
from .lines import _fresh
from .words import Words, mix, shingle_set, slices
from .workers import clear, tidy

#: The id that stands for a null doc_id, below all others.
LOWEST = -(1 << 63)
#: Shingles of all sets of a block; two blocks meet in a task.
BLOCK_SHINGLES = 400_000
#: Cells of a token-group matrix, and sets of a group at least.
MATRIX_CELLS, GROUP_SETS = 16_000_000, 16
#: Sets of a loose group of several blocks that every block sees.
PIVOTS = 4
#: One document of so many is sampled for common shingles; of those, how often it must be seen, and how many are told apart at most.
SAMPLED, COMMON_SEEN, COMMON = 16, 3, 1_000_000
#: Classes that share a prefix shingle, up to which all their pairs are tried by parity maps.
FEW = 256
#: Rows of signatures that a task combines at once.
FLUSH = 1_000_000
_U = np.uint64


def set_id(s: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)), dtype=_U) + _U(len(s))]))[0].astype(np.int64))


class Parts:
    """How sets of each size are dealt into parts. percent: the similarity, a whole number below 100."""

    def __init__(self, percent: int):
        self.percent = percent
        first = -(-percent // (100 - percent))
        self.tops = [first]

    def _edges(self, size: int) -> list[int]:
        while self.tops[-1] <= size:
            self.tops.append(max(self.tops[-1] + 1, -(-self.tops[-1] * 3 // 2)))
        return self.tops

    def classes(self, size: int) -> Iterator[tuple[int, int, int]]:
        """(class, parts, parts that may be empty) that a set of this size takes part in; none if only equal sets reach it."""
        edges = self._edges(size)
        least = -(-self.percent * size // 100)
        for c in range(int(np.searchsorted(edges, size, "right")) - 1, -1, -1):
            top = edges[c + 1] - 1
            if top < least:
                return
            differ = top * (100 - self.percent) // self.percent
            spare = 2 + differ // 50
            yield c, differ + 1 + spare, spare

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """One hash for each part of each class. Empty parts count only where more are empty than were added to spare."""
        found = []
        for c, parts, spare in self.classes(len(s)):
            part = ((s >> _U(32)) * _U(parts)) >> _U(32)
            at = np.flatnonzero(np.diff(part, prepend=part[:1] + _U(1)))
            total = np.add.reduceat(mix(s + _U(c)), at)
            sig = mix(total + part[at] * _U(0x9E3779B97F4A7C15) + _U(c))
            found.append(sig)
            if parts - len(at) > spare:
                void = np.setdiff1d(np.arange(parts, dtype=_U), part[at])
                found.append(mix(void * _U(0xD6E8FEB86659FD93) + _U(c) + _U(0x1234567)))
        return np.concatenate(found) if found else np.empty(0, _U)


class Prefix:
    """The first shingles of a set, common ones last."""

    def __init__(self, percent: int, common: np.ndarray):
        self.percent, self.common = percent, common
        self.least = -(-percent // (100 - percent))

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """None if only equal sets reach this one."""
        if len(s) < self.least:
            return np.empty(0, _U)
        size = len(s) + (self.percent * len(s) // -100) + 1
        if not len(self.common):
            return s[:size]
        known = self.common[np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)] == s
        rare = s[~known][:size]
        return np.concatenate([rare, s[known][: size - len(rare)]])


def common_shingles(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted shingles that COMMON_SEEN or more sampled rows hold, the COMMON most frequent of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in _sets(b.column("text"), k):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).mapInArrow(run, "s bigint")
    seen = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_SEEN)
    return np.sort(np.array(seen.orderBy(F.desc("n"), "s").limit(COMMON).select("s").toArrow().column("s")).astype(np.int64).view(_U))


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, texts in slices(column):
        w = Words(texts)
        for i in range(len(texts)):
            yield shingle_set(w.text(i), k)


def parity(s: np.ndarray) -> bytes:
    """The parity map of a set: a power of two of bits, twice its size at least."""
    width = map_bits(len(s))
    odd = np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def map_bits(n: int) -> int:
    return max(64, 1 << (2 * n - 1).bit_length())


def near_pairs(rows: list[tuple[int, int, bytes]], percent: int) -> Iterator[tuple[int, int]]:
    """Edges that join all pairs of rows (v, n, map) whose sizes and maps allow a link; a pair that is joined already is not tried."""
    rows = sorted(rows, key=lambda r: r[1])
    maps = [int.from_bytes(r[2], "little") for r in rows]
    top = list(range(len(rows)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for i, (v, n, _) in enumerate(rows):
        width = map_bits(n)
        for j in range(i + 1, len(rows)):
            m = rows[j][1]
            if m * percent > n * 100:
                break
            a, b = find(i), find(j)
            if a == b:
                continue
            other, bits = maps[j], map_bits(m)
            while bits > width:
                bits //= 2
                other = (other >> bits) ^ (other & ((1 << bits) - 1))
            if (maps[i] ^ other).bit_count() * (100 + percent) <= (n + m) * (100 - percent):
                top[max(a, b)] = min(a, b)
                yield v, rows[j][0]


def _tried(percent: int):
    """Over rows sorted by sig: the edges of each sig's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, held = None, []
        done: set[tuple[int, int]] = set()

        def flush() -> None:
            done.update(near_pairs(held, percent))

        for b in tidy(batches):
            for s, v, n, m in zip(*(b.column(c).to_pylist() for c in ("sig", "v", "n", "map"))):
                if s != sig:
                    flush()
                    sig, held = s, []
                held.append((v, n, m))
            if len(done) > 50_000:
                yield _listed(done)
                done.clear()
        flush()
        yield _listed(done)

    return run


def _listed(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def _described(k: int, with_maps: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()
        for b in tidy(batches):
            n, v, maps, seen = [], [], [], set()
            for s in _sets(b.column("text"), k):
                n.append(len(s))
                v.append(set_id(s))
                maps.append(parity(s) if with_maps and v[-1] not in seen else None)
                seen.add(v[-1])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(v, pa.int64()), pa.array(maps, pa.binary())], ["id", "n", "v", "map"])

    return run


def _signed(k: int, percent: int, common=None):
    """(sig, v, b) of the classes of a task's texts. Of a signature that more than FEW of a flush hold (of parts, more than one), the least class alone goes on, as its own b; the others are edges to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()
        parts, seen = Parts(percent) if common is None else Prefix(percent, common.value), set()
        sig, v, rows = [], [], 0
        for b in tidy(batches):
            for s in _sets(b.column("text"), k):
                one = set_id(s)
                if one in seen:
                    continue
                seen.add(one)
                own = parts.signatures(s)
                sig.append(own)
                v.append(np.full(len(own), one, np.int64))
                rows += len(own)
                if rows > FLUSH:
                    yield _combined(np.concatenate(sig).view(np.int64), np.concatenate(v), 1 if common is None else FEW)
                    sig, v, rows = [], [], 0
        if rows:
            yield _combined(np.concatenate(sig).view(np.int64), np.concatenate(v), 1 if common is None else FEW)

    return run


def _combined(sig: np.ndarray, v: np.ndarray, most: int) -> pa.RecordBatch:
    order = np.lexsort((v, sig))
    sig, v = sig[order], v[order]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(first, len(sig)))
    least = np.repeat(v[first], size)
    hot = np.repeat(size > most, size)
    head = np.zeros(len(sig), bool)
    head[first] = True
    # An edge is dealt by its class, once.
    edges = np.unique(np.stack([v, least], axis=1)[hot & ~head], axis=0).reshape(-1, 2)
    keep = ~hot | head
    columns = [np.concatenate([sig[keep], mix(edges[:, 0].astype(np.int64).view(_U)).view(np.int64)]), np.concatenate([v[keep], edges[:, 0]]), np.concatenate([least[keep], edges[:, 1]])]
    known = np.concatenate([hot[keep], np.ones(len(edges), bool)])
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], mask=~known)], ["sig", "v", "b"])


def _grouped(few: int):
    """Over rows sorted by sig and v: edges (a, b), and for each signature that up to `few` classes share, and more than one, a hash of the classes and their list.

    Of more classes each gets an edge to the least. Only one group of up to `few` rows is held from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)
        for b in tidy(batches):
            got = np.stack([np.array(b.column("sig")), np.array(b.column("v")), np.array(b.column("b").fill_null(_NONE))])
            edge = (got[2] != _NONE) & (got[2] != got[1])
            held = np.concatenate([held, got[:, ~edge]], axis=1)
            last = np.searchsorted(held[0], held[0][-1]) if held.shape[1] else 0
            parts = [_edges(got[1:, edge]), *_shared(held[:, :last], few)]
            held = held[:, last:]
            if held.shape[1] > few + 1:
                # A group that goes on and is beyond `few` already: all but its least class become edges.
                rest = np.unique(held[1])
                parts.append(_edges(np.stack([rest[1:], np.full(len(rest) - 1, rest[0])])))
                held = np.array([[held[0][0]], [rest[0]], [rest[0]]], np.int64)
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]
        parts = list(_shared(held, few))
        yield from (p for p in parts if p.num_rows)

    return run


#: Stands for no b.
_NONE = -(1 << 63)
_GROUP = pa.schema([("h", pa.int64()), ("members", pa.list_(pa.int64())), ("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: np.ndarray) -> pa.RecordBatch:
    n = pairs.shape[1]
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(pairs[0]), pa.array(pairs[1])], schema=_GROUP)


def _shared(rows: np.ndarray, few: int) -> Iterator[pa.RecordBatch]:
    """Groups and edges of whole signatures: (sig, v, b) sorted by sig and v."""
    sig, v, hot = rows[0], rows[1], rows[2] != _NONE
    if not len(sig):
        return
    new = np.append(True, sig[1:] != sig[:-1])
    fresh = new | np.append(True, v[1:] != v[:-1])
    star = np.logical_or.reduceat(hot, np.flatnonzero(new))
    sig, v, new = sig[fresh], v[fresh], new[fresh]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(sig)))
    star = (star | (size > few)) & (size > 1)
    joined = np.repeat(star, size) & ~new
    yield _edges(np.unique(np.stack([v[joined], np.repeat(v[first], size)[joined]]), axis=1))
    listed = np.repeat((size > 1) & ~star, size)
    if listed.any():
        members, count = v[listed], size[(size > 1) & ~star]
        begin = np.cumsum(count) - count
        h = mix(np.add.reduceat(mix(members.view(_U)), begin) + count.astype(_U)).view(np.int64)
        _, one = np.unique(h, return_index=True)
        spot = np.repeat(begin[one] - (np.cumsum(count[one]) - count[one]), count[one]) + np.arange(count[one].sum())
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count[one])), pa.int32()), pa.array(members[spot]))
        yield pa.RecordBatch.from_arrays([pa.array(h[one]), lists, pa.nulls(len(one), pa.int64()), pa.nulls(len(one), pa.int64())], schema=_GROUP)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for b in tidy(batches):
        body = [press.compress(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(body, pa.binary())], ["id", "body"])


class Matrix:
    """Sets as rows of numbered tokens, put into groups in the order given, and which groups hold which tokens."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        self.tokens, self.local = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.size)
        self.begins = self.ends - self.size
        n = len(sets)
        groups = int(min(max(1, MATRIX_CELLS // max(1, len(self.tokens))), -(-n // GROUP_SETS)))
        of = np.arange(n) * groups // n
        self.union = np.zeros((len(self.tokens), groups), bool)
        self.union[self.local, np.repeat(of, self.size)] = True
        first = np.searchsorted(of, np.arange(groups))
        self.smallest = np.minimum.reduceat(self.size, first)
        self.members = np.split(np.arange(n), first[1:])
        self.mask = np.zeros(len(self.tokens), np.int32)

    def near(self, own: np.ndarray, size: int, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Of the wanted sets those linked to one of `size` tokens, of which own are in the matrix."""
        held = self.union[own].sum(axis=0)
        opened = np.flatnonzero(held * 100 >= percent * np.maximum(size, self.smallest))
        if not len(opened):
            return np.empty(0, np.int64)
        at = np.concatenate([self.members[g] for g in opened])
        at = at[wanted[at] & (self.size[at] * 100 >= percent * size) & (size * 100 >= percent * self.size[at])]
        if not len(at):
            return at
        n = self.size[at]
        begin = np.cumsum(n) - n
        self.mask[own] = 1
        both = np.add.reduceat(self.mask[self.local[np.repeat(self.begins[at] - begin, n) + np.arange(n.sum())]], begin)
        self.mask[own] = 0
        return at[both * 100 >= percent * (size + n - both)]

    def row(self, i: int) -> np.ndarray:
        return self.local[self.begins[i] : self.ends[i]]


def link(sets: list[np.ndarray], percent: int, labels: list[int] | None = None) -> np.ndarray:
    """For each set the index of a set of its component, the same for all of them. labels: what sets are likely alike."""
    n = len(sets)
    label = labels or [0] * n
    order = sorted(range(n), key=lambda i: (label[i], int(sets[i][0]) if len(sets[i]) else -1, len(sets[i])))
    m = Matrix([sets[i] for i in order])
    root_of, free = np.full(n, -1), np.ones(n, bool)
    for root in range(n):
        if not free[root]:
            continue
        root_of[root], free[root], todo = root, False, [root]
        while todo:
            q = todo.pop()
            hit = m.near(m.row(q), int(m.size[q]), percent, free)
            root_of[hit], free[hit] = root, False
            todo.extend(hit.tolist())
    out = np.empty(n, np.int64)
    out[order] = np.array(order)[root_of]
    return out


def link_across(left: list[np.ndarray], left_root: np.ndarray, right: list[np.ndarray], right_root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(left, right) pairs that join the components roots tell wherever a left set links to a right one; what is joined already is not compared."""
    roots, number = np.unique(np.concatenate([left_root, right_root]), return_inverse=True)
    top = np.arange(len(roots))
    mine, theirs = number[: len(left)], number[len(left) :]
    order = sorted(range(len(right)), key=lambda i: (int(theirs[i]), int(right[i][0]) if len(right[i]) else -1, len(right[i])))
    m = Matrix([right[i] for i in order])
    theirs, out = theirs[order], []
    for i, x in enumerate(left):
        spot = np.searchsorted(m.tokens, x)
        spot = spot[m.tokens[np.minimum(spot, len(m.tokens) - 1)] == x]
        for j in m.near(spot, len(x), percent, top[theirs] != top[mine[i]]).tolist():
            a, b = top[mine[i]], top[theirs[j]]
            if a != b:
                top[top == max(a, b)] = min(a, b)
                out.append((i, order[j]))
    return out


def _opened(table: pa.Table, k: int, *columns: str) -> tuple[dict[int, np.ndarray], dict[int, tuple]]:
    """Sets by class, and what columns say of each class. A row whose text does not give its class is another's with the same id."""
    press, sets, told = zstandard.ZstdDecompressor(), {}, {}
    for v, body, *more in zip(table.column("v").to_pylist(), table.column("body"), *(table.column(c).to_pylist() for c in columns)):
        if v in sets:
            continue
        s = shingle_set(Words([press.decompress(body.as_py())]).hashes, k)
        if set_id(s) == v:
            sets[v], told[v] = s, tuple(more)
    return sets, told


def _pair_table(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _linked(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        sets, told = _opened(table, k, "label")
        ids = list(sets)
        root = link(list(sets.values()), percent, [told[v][0] for v in ids]) if ids else []
        clear()
        return _pair_table([(ids[i], ids[r]) for i, r in enumerate(root) if i != r])

    return run


def _crossed(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        left = pa.compute.equal(table.column("side"), 1)
        (a, a_root), (b, b_root) = (_opened(table.filter(x), k, "root") for x in (left, pa.compute.invert(left)))
        pairs = []
        if a and b:
            roots = [np.array([x[0] for x in told.values()], np.int64) for told in (a_root, b_root)]
            pairs = link_across(list(a.values()), roots[0], list(b.values()), roots[1], percent)
        a_ids, b_ids = list(a), list(b)
        clear()
        return _pair_table([(a_ids[i], b_ids[j]) for i, j in pairs])

    return run


def join(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK_SHINGLES, scheme: str = "prefix") -> DataFrame:
    """(id, n_shingles, component) for every row of docs (doc_id, text).

    id is doc_id, LOWEST if null. component is the least id that a row reaches by
    links, itself included. Rows that share an id each have a component. Null, empty and
    blank texts have no shingles and link with nothing; fewer than k words are one
    shingle. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("doc_id", F.lit(LOWEST).cast("bigint")).alias("id"), "text")
    described = written(texts.mapInArrow(_described(k, scheme == "prefix"), "id bigint, n bigint, v bigint, map binary"), "sets")
    common = spark.sparkContext.broadcast(common_shingles(texts, k)) if scheme == "prefix" else None
    signed = texts.mapInArrow(_signed(k, percent, common), "sig bigint, v bigint, b bigint").repartition("sig").sortWithinPartitions("sig", "v")
    found = written(signed.mapInArrow(_grouped(FEW if scheme == "prefix" else 0), "h bigint, members array<bigint>, a bigint, b bigint"), "shared")
    release(spark)
    edges = found.where("a is not null").select("a", "b")
    if scheme == "prefix":
        # Signatures that the same classes share count once.
        groups = found.where("h is not null").groupBy("h").agg(F.first("members").alias("members")).select(F.col("h").alias("sig"), F.explode("members").alias("v"))
        maps = described.where("map is not null").groupBy("v").agg(F.first("n").alias("n"), F.first("map").alias("map"))
        tried = groups.join(maps, "v").repartition("sig").sortWithinPartitions("sig").mapInArrow(_tried(percent), "a bigint, b bigint")
        edges = edges.unionByName(tried)
    edges = edges.distinct()
    loose = components(checkpointed(edges))
    release(spark)

    described = described.drop("map")
    classes = described.where("n > 0").groupBy("v").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    nodes = loose.unionByName(loose.select(F.col("label").alias("node"), "label").distinct())
    members = checkpointed(nodes.join(classes, nodes["node"] == classes["v"]).select("label", "v", "id", F.col("n").alias("size")))
    total, shingles = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    pivots = [F.min_by(F.struct("v", "id"), F.xxhash64(F.lit(p), "v")).alias(f"p{p}") for p in range(PIVOTS)]
    groups = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / block).cast("int").alias("blocks"), *pivots)
    placed = meet(members, groups.select("label", "n", "blocks"), "label", total)
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    bundle = F.pmod(F.xxhash64("label"), F.lit(int(shingles // block) + 1))
    one = placed.where("blocks = 1").select(bundle.alias("t"), F.lit(-1).alias("i"), "label", "v", "id")
    many = placed.where("blocks > 1").select(F.col("label").alias("t"), own.alias("i"), "label", "v", "id")
    seen = groups.where("blocks > 1").select("label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.array_distinct(F.array(*[f"p{p}" for p in range(PIVOTS)])).alias("p"))
    seen = seen.select(F.col("label").alias("t"), "i", "label", F.explode("p").alias("p")).select("t", "i", "label", "p.v", "p.id")
    bodies = texts.mapInArrow(_packed, "id bigint, body binary")
    tasks = one.unionByName(many).unionByName(seen)
    found = checkpointed(tasks.join(bodies, "id").groupBy("t", "i").applyInArrow(_linked(k, percent), "a bigint, b bigint"))
    linked = components(found)
    release(spark)
    rest = _outside(placed.where("blocks > 1"), linked, block)
    if rest is not None:
        crossed = rest.join(bodies, "id").groupBy("label", "i", "j").applyInArrow(_crossed(k, percent), "a bigint, b bigint")
        linked = components(checkpointed(found.unionByName(crossed)))
        release(spark)

    rooted = classes.join(linked, classes["v"] == linked["node"], "left").select("v", "id", F.coalesce("label", "v").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    by_class = rooted.join(least, "root").select("v", "component")
    full = described.where("n > 0").join(by_class, "v").select("id", F.col("n").alias("n_shingles"), "component")
    return full.unionByName(described.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component")))


def _outside(placed: DataFrame, linked: DataFrame, block: int) -> DataFrame | None:
    """Tasks (label, i, j, side, v, id, root) in which sets outside the largest component of their loose group meet all blocks of it; None if there are none."""
    if not placed.limit(1).count():
        return None
    rooted = checkpointed(placed.join(linked, placed["v"] == linked["node"], "left").select(placed["label"], "v", "id", "size", "blocks", F.coalesce(linked["label"], "v").alias("root")))
    main = rooted.groupBy("label", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"))
    total = rooted.count()
    marked = checkpointed(meet(rooted, main, "label", total).withColumn("out", F.col("root") != F.col("main")))
    parts = marked.where("out").groupBy("label").agg(F.ceil(F.sum("size") / block).cast("int").alias("parts"), F.count(F.lit(1)).alias("n"))
    if not parts.limit(1).count():
        return None
    every = meet(marked, parts.select("label", "parts").join(main.select("label", "n"), "label"), "label", total)
    at = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = every.where("out").select("label", at("parts").alias("i"), spread("blocks").alias("j"), F.lit(1).alias("side"), "v", "id", "root")
    right = every.select("label", spread("parts").alias("i"), at("blocks").alias("j"), F.lit(0).alias("side"), "v", "id", "root")
    return left.unionByName(right)


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which each component keeps one: the first by doc_id (null is lowest), then by text.

    Rows are told apart by a 64-bit hash of doc_id and text. Of rows equal in both
    one stays; null, empty and blank texts link with nothing and all stay.
    """
    n_node, n_size, n_place = _fresh(docs, "_node", "_size", "_place")
    lowest = F.coalesce("doc_id", F.lit(LOWEST).cast("bigint"))
    keyed = docs.withColumn(n_node, F.xxhash64(lowest, "text"))
    found = written(join(keyed.select(F.col(n_node).alias("doc_id"), "text"), k, percent), "near")
    release(docs.sparkSession)
    rows = keyed.select(F.col(n_node).alias("id"), lowest.alias("doc_id")).distinct()
    nodes = found.distinct().join(rows, "id")
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("doc_id"))
    first = written(nodes.join(least, ["component", "doc_id"]).select("component", "id", "n_shingles"), "first")
    tied = first.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    keep = first.select("id", "n_shingles")
    if tied.limit(1).count():
        texts = keyed.select(F.col(n_node).alias("id"), "text")
        by_text = first.join(tied, "component", "left_semi").join(texts, "id").groupBy("component").agg(F.min_by("id", "text").alias("id"), F.first("n_shingles").alias("n_shingles"))
        keep = first.join(tied, "component", "left_anti").select("id", "n_shingles").unionByName(by_text.select("id", "n_shingles"))
    kept = keyed.join(keep.select(F.col("id").alias(n_node), F.col("n_shingles").alias(n_size)), n_node)
    if found.count() > rows.count():
        order = Window.partitionBy(n_node).orderBy("text", *[f"`{c}`" for c in docs.columns if c != "text"])
        kept = kept.withColumn(n_place, F.row_number().over(order)).where((F.col(n_place) == 1) | (F.col(n_size) == 0))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6(docs: DataFrame) -> DataFrame:
    plain = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return join(docs, k=3, percent=90, scheme="parts").select(plain("id").alias("doc_id"), "n_shingles", plain("component").alias("component_id"))
