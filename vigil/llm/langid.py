"""Language identification by cross-parsing against labelled text.

A suffix automaton of each language's sample reads a text into the longest
pieces that occur in the sample. Phrases, times the bits to point into the
sample, over the text's length is a cross entropy; the least one wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workers import hold, tidy

#: Bounds of the labelled sample of each language: texts, characters, characters of a text.
TEXTS, CHARS, TEXT_CHARS = 48, 24_000, 3_000
#: Texts are read side by side, until so few are left that each is read alone.
ALONE = 48
#: Steps whose symbols are laid out at once.
STEPS = 256
#: Symbols that weigh in the score at most: of longer texts the score says how far apart the languages are, not how long the text is.
WEIGHED = 40
#: Bytes of a table of states by symbols; larger ones are packed, with equal results.
DENSE = 1 << 26
#: Places that a packed row is tried at together.
TRIED = 512
SPACE, STRANGE = 0, 1
UND = "und"


def held_out(doc_id: Column, of: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % of == fold, F.lit(False))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(lang, joined texts) of rows outside the held-out fold that carry a language.

    Texts come in the order of a hash of doc_id, those of TEXT_CHARS or fewer
    first; a longer one gives its start. Each scan partition keeps its first TEXTS
    of a language before rows meet, and so does each of 1024 groups of partitions.
    All languages are learned, so the driver and the automata grow with their number.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    cut = rows.select("lang", F.substring("text", 1, TEXT_CHARS).alias("text"), F.xxhash64(F.lit("langid"), "doc_id").alias("h"), (F.length("text") > TEXT_CHARS).alias("long"))
    cut = cut.withColumn("salt", F.spark_partition_id() % 1024)
    for by in (["lang", "salt"], ["lang"]):
        first = F.row_number().over(Window.partitionBy(*by).orderBy("long", "h", "text"))
        cut = cut.withColumn("place", first).where(F.col("place") <= TEXTS).drop("place")
    by_lang: dict[str, list] = {}
    for r in cut.collect():
        by_lang.setdefault(r["lang"], []).append((r["long"], r["h"], r["text"]))
    out = []
    for lang in sorted(by_lang):
        text = ""
        for _, _, t in sorted(by_lang[lang]):
            if text and len(text) + len(t) > CHARS:
                break
            text += t[:CHARS] + "\n"
        out.append((lang, text))
    return out


def automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, state 0 first."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nexts


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def packed(rows: list[np.ndarray], columns: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, to) of sparse rows laid into each other: cell c of row i lies at base[i] + c, where owner is i.

    Rows of many cells are placed first, each where all of its cells are free;
    rows of as many cells go on from the last such place. Rows of one cell fill gaps.
    """
    sizes = np.fromiter(map(len, columns), np.int64, len(columns))
    base, taken, at, now = np.zeros(len(rows), np.int64), np.zeros(2 * int(sizes.sum()) + 2 * width + TRIED, bool), 0, 0
    for i in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes > 1)].tolist():
        c, at, now = columns[i], at if sizes[i] == now else 0, sizes[i]
        while True:
            if at + TRIED + width >= len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken), bool)])
            tried = np.flatnonzero(~taken[at : at + TRIED]) + at
            tried = tried[~taken[tried[:, None] + (c - c.min())].any(axis=1)] - c.min()
            if len(tried):
                break
            at += TRIED
        base[i] = tried[0]
        taken[base[i] + c] = True
    single = np.flatnonzero(sizes == 1)
    gaps = np.flatnonzero(~taken)[: len(single)]
    gaps = np.append(gaps, len(taken) + np.arange(len(single) - len(gaps)))
    base[single] = gaps - np.fromiter((columns[i][0] for i in single.tolist()), np.int64, len(single))
    base -= min(0, int(base.min(initial=0)))
    owner = np.full(int(base.max(initial=0)) + width + 1, -1, np.int32)
    to = np.zeros(len(owner), np.int32)
    cells = np.repeat(base, sizes) + np.concatenate([*columns, np.empty(0, np.int64)])
    owner[cells] = np.repeat(np.arange(len(rows)), sizes)
    to[cells] = np.concatenate([*rows, np.empty(0, np.int64)])
    return base, owner, to


class Model:
    """All automata in one table.

    Dense: row of a state, column of a symbol; a negative entry ends a phrase first.
    Packed, beyond DENSE bytes: a cell that another row owns ends a phrase, and the
    next one begins where the language's root goes.
    """

    def __init__(self, labelled: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in labelled]
        known = np.unique(np.concatenate([_points(t) for _, t in labelled] or [np.empty(0, np.uint32)]))
        known = known[_letters()[known]]
        self.symbol = np.where(_letters(), STRANGE, SPACE).astype(np.int32)
        self.symbol[known] = np.arange(len(known)) + 2
        self.width = len(known) + 2
        own = [self.symbols(_points(text)) for _, text in labelled]
        self.bits = np.array([np.log2(max(2, len(s))) for s in own])
        automata = [automaton(s) for s in own]
        firsts = np.cumsum([0, *map(len, automata)])
        self.dense = int(firsts[-1]) * self.width * 4 <= DENSE
        if self.dense:
            rows = []
            for nexts, first in zip(automata, firsts.tolist(), strict=False):
                table = np.full((len(nexts), self.width), -1, np.int32)
                for i, to in enumerate(nexts):
                    table[i, list(to)] = [(first + s) * self.width for s in to.values()]
                fresh = np.where(table[0] >= 0, table[0], first * self.width)
                rows.append(np.where(table >= 0, table, -1 - fresh))
            self.table = np.concatenate(rows).ravel() if rows else np.empty(0, np.int32)
            self.root = (firsts[:-1] * self.width).astype(np.int32)
        else:
            every = [(first, to) for nexts, first in zip(automata, firsts.tolist(), strict=False) for to in nexts]
            rows = [first + np.fromiter(to.values(), np.int64, len(to)) for first, to in every]
            self.base, self.owner, self.table = packed(rows, [np.fromiter(to, np.int64, len(to)) for _, to in every], self.width)
            self.root = firsts[:-1].astype(np.int32)
            self.fresh = np.repeat(self.root[:, None], self.width, axis=1)
            for k, first in enumerate(firsts[:-1].tolist()):
                for c, s in automata[k][0].items():
                    self.fresh[k, c] = first + s

    def _step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a symbol each, and -1 where a phrase ended before it."""
        if self.dense:
            to = self.table.take(state + symbols)
            ended = to >> 31
            return to ^ ended, ended
        at = self.base.take(state) + symbols
        ended = self.owner.take(at) != state
        return np.where(ended, self.fresh[:, symbols], self.table.take(at)), -ended.astype(np.int32)

    def _alone(self, at: int, lang: int, symbols: list[int]) -> int:
        """Phrases that end within symbols."""
        n, table = 0, memoryview(self.table)
        if self.dense:
            for c in symbols:
                at = table[at + c]
                if at < 0:
                    at, n = ~at, n + 1
            return n
        base, owner, fresh = memoryview(self.base), memoryview(self.owner), memoryview(self.fresh[lang])
        for c in symbols:
            place = base[at] + c
            if owner[place] == at:
                at = table[place]
            else:
                at, n = fresh[c], n + 1
        return n

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Letters as learned, runs of anything else as one space."""
        s = self.symbol[points]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
        return s[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language; texts are read whole."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        every = np.concatenate([*texts, np.empty(0, np.int32)])
        begin, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
        state = np.repeat(self.root[:, None], len(order), axis=1)
        ends = np.repeat((length > 0).astype(np.int64)[None, :], len(self.langs), axis=0)
        together = int(length[ALONE]) if len(length) > ALONE else 0
        active = (len(length) - np.searchsorted(length[::-1], np.arange(together), "right")).tolist()
        for a in range(0, together, STEPS):
            steps = np.arange(a, min(a + STEPS, together))
            laid = np.ascontiguousarray(every[np.minimum(begin[: active[a], None] + steps, len(every) - 1)].T)
            for t, row in zip(steps.tolist(), laid):
                n = active[t]
                state[:, :n], ended = self._step(state[:, :n], row[:n])
                ends[:, :n] -= ended
        for i in range(min(len(length), ALONE)):
            left = every[begin[i] + together : begin[i] + length[i]].tolist()
            for k in range(len(self.langs)):
                ends[k, i] += self._alone(int(state[k, i]), k, left)
        out = np.empty_like(ends)
        out[:, order] = ends
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        read = [self.symbols(_points(t)) for t in texts]
        lettered = np.array([bool((s != SPACE).any()) for s in read])
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts)
        n = np.maximum(1, np.array([len(s) for s in read]))
        entropy = self.phrases(read) * self.bits[:, None] / n
        best = entropy.argmin(axis=0)
        weight = np.exp2(-(entropy - entropy.min(axis=0)) * np.minimum(n, WEIGHED))
        score = np.where(lettered, 1 / weight.sum(axis=0), 0.0)
        return [self.langs[b] if ok else UND for b, ok in zip(best, lettered)], score.tolist()


def _batches(column: pa.Array, most: int = 1 << 22) -> Iterator[list[str]]:
    texts, size = [], 0
    for x in column:
        t = x.as_py() or ""
        texts.append(t)
        size += len(t)
        if size > most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def identify(docs: DataFrame, labelled: list[tuple[str, str]]) -> DataFrame:
    """All rows and columns of docs plus lang_pred and score, in place of columns so named.

    A null text and one without a letter are `und` with score 0, as is every text
    if nothing was learned. Repeated rows stay, with equal results; an empty table
    gives no rows. Equal entropies go to the first language by name. A
    text of strange letters only scores 1 / languages. Every text is read whole.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")]
    fixed = tuple(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = hold(("langid", fixed), lambda: Model(fixed))
        for b in tidy(batches):
            langs, scores = [], []
            for texts in _batches(b.column("text")):
                found = model.predict(texts)
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def op4(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", "text"), sample(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
