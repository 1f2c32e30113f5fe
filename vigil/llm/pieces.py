"""SentencePiece BPE encoding and decoding by suffix-array matching.

The units of a batch's texts (a run of spaces and the word after it; long ones are
cut where no piece holds the two neighbours) are looked up among those that the worker
has read lately. The others are joined, each distinct one once, and their
suffixes sorted. Every piece is searched by
bisection in that order; its range lists all places where it occurs. These edges, sorted by where they
end, are relaxed from left to right. BPE keeps no best score but a last piece for
each prefix: an edge holds if BPE would leave it and the last piece before it
apart, which for two pieces is settled once by merging their text and kept. One
edge holds at each place, so the pieces are those that merging the unit gives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import hold, tidy

#: Stands for a space in pieces.
MARK = "▁"
#: Characters of texts handled at once, and of distinct units indexed at once; a longer text or unit comes alone.
SLICE_CHARS, INDEX_CHARS = 1 << 19, 1 << 17
_SLOTS = 1 << 20
#: Units that a worker remembers, and their characters (and ids); when there are more, it begins anew.
_UNITS, _CHARS = 1 << 19, 1 << 22
#: Units of more characters are cut where they can be; it makes no difference to the pieces.
LONG = 32
#: Places of a table of neighbours that some piece holds; two pairs of a place count as held.
_PAIRS = 1 << 22
#: Stands for a NUL in a text; 0 parts units.
_NUL = 0x110000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of two neighbours in the table of _PAIRS."""
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(42)).astype(np.int64)


class Memory:
    """Units by hash, each with its text and its ids. It may forget, but what it finds is of the same text."""

    def __init__(self):
        self.slots = np.zeros(2 * _UNITS, np.int32)
        self.hash, self.points, self.ids = np.empty(_UNITS, np.uint64), np.empty(_CHARS, np.uint32), np.empty(_CHARS, np.int32)
        # Of each unit where its characters and its ids begin; the next one's are where they end.
        self.begin, self.first = np.zeros(_UNITS + 1, np.int32), np.zeros(_UNITS + 1, np.int32)
        self.units = 0

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two slots of a hash; 0 in a slot stands for no unit, others for the one before."""
        most, down = np.uint64(len(self.slots)), np.uint64(32)
        return tuple((((x >> down) * most) >> down).astype(np.int64) for x in (h, h * np.uint64(0x9E3779B97F4A7C15)))

    def find(self, points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers of the units that begin at places of a sequence of code points, -1 of those that are not held."""
        found = np.full(len(h), -1, np.int64)
        for slot in self.places(h):
            n = self.slots[slot].astype(np.int64) - 1
            hit = (n >= 0) & (self.hash[n] == h) & (self.begin[n + 1] - self.begin[n] == sizes)
            found[hit] = n[hit]
        held = np.flatnonzero(found >= 0)
        if len(held):
            n = sizes[held]
            other = points[_spread(begin[held], n)] != self.points[_spread(self.begin[found[held]], n)]
            found[held[np.logical_or.reduceat(other, np.cumsum(n) - n)]] = -1
        return found

    def read(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, how many each has)."""
        many = (self.first[units + 1] - self.first[units]).astype(np.int64)
        return self.ids[_spread(self.first[units], many)], many

    def add(self, points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, h: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        size = int(sizes.sum())
        if not len(h) or len(h) > _UNITS or max(size, len(ids)) > _CHARS:
            return
        if self.units + len(h) > _UNITS or self.begin[self.units] + size > _CHARS or self.first[self.units] + len(ids) > _CHARS:
            self.slots[:], self.units = 0, 0
        a, b = self.units, self.units + len(h)
        self.begin[a + 1 : b + 1] = self.begin[a] + np.cumsum(sizes)
        self.first[a + 1 : b + 1] = self.first[a] + np.cumsum(many)
        self.points[self.begin[a] : self.begin[b]] = points[_spread(begin, sizes)]
        self.ids[self.first[a] : self.first[b]] = ids
        self.hash[a:b], self.units = h, b
        own, (one, two) = np.arange(a + 1, b + 1, dtype=np.int32), self.places(h)
        free = self.slots[one] == 0
        self.slots[one[free]] = own[free]
        left = self.slots[one] != own
        self.slots[two[left]] = own[left]


@dataclass(frozen=True)
class Vocabulary:
    """pieces and scores by id; kinds: n normal, b byte, o any other."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece BPE model that keeps white space, adds a dummy prefix and falls back to bytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.vocab_size())
    kind = lambda i: "b" if m.is_byte(i) else "o" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "n"
    return Vocabulary(tuple(m.id_to_piece(i) for i in ids), tuple(m.get_score(i) for i in ids), "".join(map(kind, ids)))


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Encoder:
    def __init__(self, v: Vocabulary):
        self.size = len(v.pieces)
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.kinds[i] == "n"}
        self.pieces, self.scores = v.pieces, v.scores
        self.bytes = np.array([i for i, k in enumerate(v.kinds) if k == "b"], np.int32)
        assert len(self.bytes) == 256, "a vocabulary with byte fallback is needed"
        self.surface = [p.replace(MARK, " ").encode() if k == "n" else bytes([int(p[3:5], 16)]) if k == "b" else b"" for p, k in zip(v.pieces, v.kinds)]
        self.known = sorted(self.ids.items(), key=lambda x: x[1])
        self.piece_id = np.array([i for _, i in self.known], np.int64)
        self.length = np.array([len(p) for p, _ in self.known], np.int64)
        self.longest = int(self.length.max())
        self.chars = np.zeros((len(self.known), self.longest), np.uint32)
        for row, (p, _) in enumerate(self.known):
            self.chars[row, : len(p)] = [ord(c) for c in p]
        assert not any(MARK in p.lstrip(MARK) for p in self.ids), "pieces that cross words are not supported"
        self.lines_part = not any("\n" in p for p in self.ids)
        inside = self.chars[:, 1:] != 0
        self.joined = np.zeros(_PAIRS, bool)
        self.joined[_pair(self.chars[:, :-1][inside], self.chars[:, 1:][inside])] = True
        self.alphabet, place = np.unique(self.chars, return_inverse=True)
        self.chars = place.reshape(self.chars.shape).astype(np.int32)
        self.up = self.down = np.ones(1, np.uint64)
        self.spines: dict[tuple[int, bool], list[tuple[str, float]] | None] = {}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.slot_key, self.slot_ok = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)
        self.memory = Memory()

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = n + (n >> 3)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down

    def merged(self, text: str, stop: str = "") -> list[str]:
        """BPE of a text by merging: best score first, then leftmost. It ends before the merge that gives `stop`."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (both := parts[i] + parts[j]) in self.ids:
                heapq.heappush(heap, (-self.scores[self.ids[both]], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if both == stop:
                break
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def spine(self, piece: int, right: bool) -> list[tuple[str, float]] | None:
        """A piece, its right (or left) half, the half of that and so on, each with the score of the merge that takes it up.

        None if merging the piece's text does not end in the piece by merges of falling score.
        """
        key = (piece, right)
        if key not in self.spines:
            text, until, out = self.pieces[piece], -np.inf, []
            while True:
                out.append((text, until))
                if len(text) == 1:
                    break
                own = self.scores[self.ids[text]]
                halves = self.halves(text)
                if halves is None or own <= until or own <= -1e8:
                    out = None
                    break
                until, text = own, halves[right]
            self.spines[key] = out
        return self.spines[key]

    def halves(self, text: str) -> tuple[str, str] | None:
        """The two pieces whose merge gives a piece last."""
        if text not in self.split:
            self.split[text] = None
            parts = self.merged(text, stop=text)
            if len(parts) == 2 and parts[0] + parts[1] == text:
                self.split[text] = (parts[0], parts[1])
        return self.split[text]

    def parted(self, left: int, right: int) -> bool:
        """Whether merging two pieces' text gives the two.

        A merge across the border needs a pair, one from the right spine of the left
        piece and one from the left spine of the right, whose score is above those of
        the merges that take up either; of equal scores the leftmost comes first.
        """
        a, b = self.spine(left, True), self.spine(right, False)
        if a is None or b is None:
            both = self.pieces[left] + self.pieces[right]
            return both not in self.ids and self.merged(both) == [self.pieces[left], self.pieces[right]]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            z = self.ids.get(x + y)
            if z is not None and self.scores[z] > x_until and self.scores[z] >= y_until:
                return False
            # Of the two, the one that was made later gives way to its half.
            x_made = self.scores[self.ids[x]] if i + 1 < len(a) else np.inf
            y_made = self.scores[self.ids[y]] if j + 1 < len(b) else np.inf
            if x_made == y_made == np.inf:
                return True
            if x_made < y_made:
                i += 1
            else:
                j += 1

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the two pieces apart. Ids beyond the vocabulary are characters without a piece, which nothing joins."""
        ok = np.ones(len(left), bool)
        both = np.flatnonzero((left >= 0) & (left < self.size) & (right < self.size))
        key = left[both].astype(np.int64) * self.size + right[both]
        slot = (key * 0x9E3779B1 >> 7) & (_SLOTS - 1)
        miss = np.flatnonzero(self.slot_key[slot] != key)
        ok[both] = self.slot_ok[slot]
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            found = np.empty(len(fresh), bool)
            for n, k in enumerate(fresh.tolist()):
                found[n] = self.parted(k // self.size, k % self.size)
            ok[both[miss]] = found[back]
            at = (fresh * 0x9E3779B1 >> 7) & (_SLOTS - 1)
            self.slot_key[at], self.slot_ok[at] = fresh, found
        return ok

    def edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece id, length) of all pieces in a sequence of code points; 0 parts units and is in no piece."""
        seen = np.zeros(_NUL + 1, bool)
        seen[points] = seen[0] = True
        alphabet = np.flatnonzero(seen)
        width = max(1, int(len(alphabet)).bit_length())
        per = 63 // width
        local = np.zeros(_NUL + 1, np.int32)
        local[alphabet] = np.arange(len(alphabet))
        symbols = local[points]
        mine = np.where(seen[self.alphabet], local[self.alphabet], -1)
        chars = mine[self.chars]
        there = (chars >= 0).all(axis=1)
        chars, length, ids = chars[there], self.length[there], self.piece_id[there]
        depth = -(-self.longest // per)
        padded = np.concatenate([symbols, np.zeros(per * depth, np.int64)])
        key = np.zeros(len(symbols) + per * (depth - 1), np.int64)
        for i in range(per):
            key = (key << width) | padded[i : i + len(key)]
        order = np.argsort(key)
        ranked = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        heads = ranked[new]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new) - 1
        suffix = np.zeros(len(symbols), np.int64)
        # Ranks and their number need 31 bits at most, as a text of an Arrow batch has fewer than 2^31 characters.
        bits, used, lost = int(len(heads)).bit_length(), 0, np.zeros(len(ids), bool)
        low, high = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for d in range(depth):
            if used + bits > 63:
                # Codes of all keys so far give way to their ranks. A longer piece whose code no suffix has occurs nowhere.
                codes, suffix = np.unique(suffix, return_inverse=True)
                used = int(len(codes)).bit_length()
                at = np.searchsorted(codes, low)
                lost |= (length > d * per) & (codes[np.minimum(at, len(codes) - 1)] != low)
                low, high = at, np.searchsorted(codes, high)
            used += bits
            suffix = (suffix << bits) | rank[d * per : d * per + len(symbols)]
            part = np.zeros(len(ids), np.int64)
            for i in range(d * per, (d + 1) * per):
                part = (part << width) | (chars[:, i] if i < chars.shape[1] else 0)
            inside = np.clip(length - d * per, 0, per)
            a, b = np.searchsorted(heads, part), np.searchsorted(heads, part + (np.int64(1) << (width * (per - inside))))
            whole = inside == per
            b = np.where(whole & (length > (d + 1) * per), a, np.where(inside > 0, b, 0))
            gone = (inside > 0) & whole & (length > (d + 1) * per) & (heads[np.minimum(a, len(heads) - 1)] != part)
            low = (low << bits) | np.where(inside > 0, a, 0)
            high = np.where(inside > 0, (high << bits) | b, high << bits)
            low, high = np.where(gone, 0, low), np.where(gone, 0, high)
        order = np.argsort(suffix)
        ranked = suffix[order]
        first, last = np.searchsorted(ranked, low), np.searchsorted(ranked, high)
        count = np.where(lost, 0, np.maximum(0, last - first))
        return order[_spread(first, count)].astype(np.int32), np.repeat(ids.astype(np.int32), count), np.repeat(length.astype(np.int32), count)

    def read(self, points: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units that begin at places of a sequence of code points, ids of each unit)."""
        units = len(begin)
        shift = np.cumsum(sizes + 1) - sizes - 1
        unit = np.repeat(np.arange(units, dtype=np.int32), sizes)
        inside = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole, of = np.zeros(len(unit) + units - 1, np.uint32), np.zeros(len(unit) + units - 1, np.int32)
        whole[shift[unit] + inside], of[shift[unit] + inside] = points[begin[unit] + inside], unit
        whole[whole == 0x20] = ord(MARK)
        points, begin = whole, shift.astype(np.int32)
        del unit, inside
        start, piece, length = self.edges(points)
        covered = np.zeros(len(points), bool)
        covered[start[length == 1]] = True
        bare = np.flatnonzero(~covered & (points != 0)).astype(np.int32)
        start = np.concatenate([start, bare])
        piece = np.concatenate([piece, points[bare].astype(np.int32) + np.int32(self.size)])
        length = np.concatenate([length, np.ones(len(bare), np.int32)])
        level = start + length - begin[of[start]]
        level = level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level
        order = np.argsort(level, kind="stable")
        start, piece, length, level = start[order], piece[order], length[order], level[order]
        del order, of
        last, step = np.full(len(points) + 1, -1, np.int32), np.zeros(len(points) + 1, np.int32)
        before = np.append(points, 0)[np.arange(-1, len(points))] != 0
        for a, b in _runs(level):
            s, p, n = start[a:b], piece[a:b], length[a:b]
            left = np.where(before[s], last[s - 1], -1)
            kept = self.apart(left, p)
            end = s[kept] + n[kept] - 1
            last[end], step[end] = p[kept], n[kept]
        at, todo, got_unit, got = begin + sizes.astype(np.int32) - 1, np.flatnonzero(sizes), [], []
        while len(todo):
            got_unit.append(todo)
            got.append(last[at[todo]])
            at[todo] -= step[at[todo]]
            todo = todo[at[todo] >= begin[todo]]
        owner, flat = np.concatenate(got_unit)[::-1], np.concatenate(got)[::-1]
        turn = np.argsort(owner, kind="stable")
        owner, flat = owner[turn], flat[turn]
        odd = np.flatnonzero(flat >= self.size)
        if len(odd):
            spelled = [self.bytes[list(chr((int(x) - self.size) % _NUL).encode())] for x in flat[odd]]
            times = np.ones(len(flat), np.int64)
            times[odd] = list(map(len, spelled))
            place = np.cumsum(times) - times
            flat, owner = np.repeat(flat, times), np.repeat(owner, times)
            for o, x in zip(place[odd], spelled):
                flat[o : o + len(x)] = x
        return flat.astype(np.int32), np.bincount(owner, minlength=units)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text ends)."""
        joined = "".join([" " + t if t else "" for t in texts]).replace(MARK, " ").replace("\0", chr(0xFFFE))
        raw = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if "\0" in raw:
            points = points.copy()
            points[points == 0xFFFE] = _NUL
            if chr(0xFFFE) in raw:
                whole = np.frombuffer("".join([" " + t if t else "" for t in texts]).encode("utf-32-le"), np.uint32)
                points[whole == 0xFFFE] = 0xFFFE
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space, line = points == 0x20, points == 0x0A
        start = np.zeros(len(points) + 1, bool)
        start[1:-1] = space[1:] & ~space[:-1]
        if self.lines_part:
            start[:-1] |= line
            start[1:] |= line
        limit = np.concatenate([[0], np.cumsum(sizes)])
        start[limit] = True
        begin = np.flatnonzero(start[:-1])
        count = np.diff(np.append(begin, len(points)))
        if (count > LONG).any():
            # Two neighbours that no piece holds side by side are never merged.
            inside = np.flatnonzero(np.repeat(count > LONG, count))
            inside = inside[~start[inside]]
            left, right = (np.where(space[at], np.uint32(ord(MARK)), points[at]) for at in (inside - 1, inside))
            start[inside] = ~self.joined[_pair(left, right)]
            begin = np.flatnonzero(start[:-1])
            count = np.diff(np.append(begin, len(points)))
        which, first, h = self.distinct(points, begin, count)
        found = self.memory.find(points, begin[first], count[first], h)
        known, fresh = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        new = first[fresh]
        got = [self.memory.read(found[known])]
        for part in _portions(count[new]):
            got.append(self.read(points, begin[new[part]], count[new[part]]))
        ids, many = (np.concatenate(x) for x in zip(*got))
        old = len(got[0][0])
        self.memory.add(points, begin[new], count[new], h[fresh], ids[old:], many[len(known) :])
        turn = np.empty(len(first), np.int64)
        turn[np.concatenate([known, fresh])] = np.arange(len(first))
        which = turn[which]
        own, count = (np.cumsum(many) - many)[which], many[which]
        done = np.concatenate([[0], np.cumsum(count)])
        return ids[_spread(own, count)], done[np.searchsorted(begin, limit)]

    def distinct(self, points: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(of each unit the place of its like among the distinct ones, a unit of each distinct one, its hash). Units of one hash are compared."""
        up, down = self.powers(len(points) + 1)
        value = points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        value = (value ^ (value >> np.uint64(32))) * up[: len(points)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        del value
        h = (total[begin + count] - total[begin]) * down[begin] + count.astype(np.uint64)
        hashes, first, which = np.unique(h, return_index=True, return_inverse=True)
        like = np.repeat((begin[first][which] - begin).astype(np.int32), count)
        if (count[first][which] != count).any() or (points[np.arange(len(points), dtype=np.int32) + like] != points).any():
            return np.arange(len(begin)), np.arange(len(begin)), h
        return which, first, hashes

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.surface[i] for i in ids])[1:].decode("utf-8", "replace")


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of runs that begin at first and have count places each."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_values)])


def _portions(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of units of INDEX_CHARS characters or a single one."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + INDEX_CHARS, "right")))
        yield slice(a, b)
        a = b


def _for(shared) -> Encoder:
    return hold(("pieces", shared.value), lambda: Encoder(shared.value))


def _slices(column: pa.Array) -> Iterator[list[str]]:
    rows, size = [], 0
    for x in column:
        t = x.as_py() or ""
        if rows and size + len(t) > SLICE_CHARS:
            yield rows
            rows, size = [], 0
        rows.append(t)
        size += len(t)
    if rows:
        yield rows


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All rows and columns of docs plus ids, n_tokens and exact, in place of columns so named.

    ids: array<int>. exact: decoding ids gives the text again, which only a literal
    U+2581 prevents. A null text is encoded as empty, with no ids, and is exact.
    Repeated rows stay, with equal ids; an empty table gives no rows.
    The driver reads the model; its pieces, of fixed size, go to all tasks.
    """
    names = ("ids", "n_tokens", "exact")
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    shared = docs.sparkSession.sparkContext.broadcast(load(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _for(shared)
        for b in tidy(batches):
            first = 0
            for texts in _slices(b.column("text")):
                ids, ends = enc.encode(texts)
                cut = ends.tolist()
                flat = ids.tolist()
                exact = [enc.decode(flat[cut[i] : cut[i + 1]]) == t for i, t in enumerate(texts)]
                part = b.slice(first, len(texts))
                first += len(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(ends)), pa.array(exact)], [*part.schema.names, *names])

    extra = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())]
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, *extra]))


def detokenize(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of their ids in place of text. Null ids give a null text; an id outside the vocabulary fails."""
    shared = rows.sparkSession.sparkContext.broadcast(load(path or default_path()))
    kept = [f for f in rows.schema.fields if f.name.lower() != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _for(shared)
        for b in batches:
            texts = [None if x is None else enc.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text])

    return rows.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(text, T.StringType())]))


def op9(docs: DataFrame) -> DataFrame:
    return tokenize(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "exact", "ids")
