"""Order-dependent folds over keys.

composed_fold() deals rows in runs along (key, order), so that a hot key is many
tasks. A run is first told as a function of the state that it is entered with
(cooldown: what is kept last, by the last kept time; baseline: an affine map and
the values below which it starts anew; health: a table over 0 to 100). The
functions of a key's runs are applied one after the other, one row a run, and
each run is then replayed from its own entry. Only the first key of a partition
goes on from the partition before it, so there is one entry a partition at most.

sorted_fold() is for states that are no such function: rows are dealt by key, and
a worker streams them and keeps the state of one key.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import checkpointed


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict | list[dict] | None]], schema: T.StructType) -> DataFrame:
    """The rows that steps return; step(state, row) -> (state, a row, several or None)."""
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, now, state = to_arrow_schema(schema), None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    now, state = key, start()
                state, made = step(state, row)
                for m in made if isinstance(made, list) else () if made is None else (made,):
                    out.append({n: m[n] for n in names})
            if out:
                yield from pa.Table.from_pylist(out, schema=kind).to_batches()

    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


class Machine:
    """A fold that can be entered anywhere. States and functions are plain JSON values.

    columns: what it reads of a row. start: the state before a key's first row.
    """

    columns: tuple[str, ...] = ()
    start: Any = None

    def open(self) -> Any:
        """An empty run, to be told by told()."""
        raise NotImplementedError

    def told(self, run: Any, values: list[pa.Array]) -> Any:
        """The run with the next rows, in order."""
        raise NotImplementedError

    def function(self, run: Any) -> Any:
        raise NotImplementedError

    def after(self, function: Any, state: Any) -> Any:
        """The state after a run that is entered with a state."""
        raise NotImplementedError

    def replay(self, state: Any, values: list[pa.Array]) -> tuple[Any, dict[str, list] | np.ndarray]:
        """The state after rows, and new columns for them or the places of those that stay."""
        raise NotImplementedError


def _same_keys(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[int, int]]:
    """(first, after the last) of rows in a row with the same keys; null equals null."""
    n = batch.num_rows
    fresh = np.zeros(n, bool)
    for k in keys:
        c = batch.column(k)
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
        fresh[1:] |= differ
    at = [0, *np.flatnonzero(fresh).tolist(), n]
    return zip(at[:-1], at[1:], strict=True)


def _key(batch: pa.RecordBatch, keys: list[str], i: int) -> str:
    return json.dumps([batch.column(k)[i].as_py() for k in keys], default=str)


def composed_fold(df: DataFrame, keys: list[str], order: list[str], machine: Machine, added: T.StructType | None = None) -> DataFrame:
    """df plus what the machine makes of each row, or, without `added`, the rows that it keeps.

    Keys and order are unique together, or equal rows are alike.
    """
    along = [F.asc_nulls_first(c) for c in (*keys, *order)]
    dealt = checkpointed(df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn("_part", F.spark_partition_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and the last key's run of the partition."""
        now, run, first, part = None, machine.open(), None, 0
        for b in batches:
            for i, j in _same_keys(b, keys) if b.num_rows else ():
                key, part = _key(b, keys, i), b.column("_part")[i].as_py()
                if key != now:
                    if now is not None and first is None:
                        first = (now, json.dumps(machine.function(run)))
                    now, run = key, machine.open()
                run = machine.told(run, [b.column(c).slice(i, j - i) for c in machine.columns])
        made = [x for x in (first, None if now is None else (now, json.dumps(machine.function(run)))) if x]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made]), pa.array([part] * len(made), pa.int32()), pa.array([f for _, f in made])], ["key", "part", "function"])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state that each run of a key but its first is entered with."""
        now, state = None, None
        for b in batches:
            out = []
            for key, part, function in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    now, state = key, machine.start
                else:
                    out.append((part, key, json.dumps(state)))
                state = machine.after(json.loads(function), state)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in out], pa.int32()), pa.array([k for _, k, _ in out], pa.string()), pa.array([s for _, _, s in out], pa.string())], ["_at", "_of", "_entry"])

    runs = dealt.select("_part", *keys, *[c for c in machine.columns if c not in keys]).mapInArrow(ends, "key string, part int, function string")
    entries = runs.repartition("key").sortWithinPartitions("key", "part").mapInArrow(applied, "_at int, _of string, _entry string")
    rows = dealt.join(F.broadcast(entries), F.col("_part") == F.col("_at"), "left")
    columns, schema = df.columns, T.StructType([*df.schema.fields, *(added.fields if added else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, now, state = to_arrow_schema(schema), None, None
        for b in batches:
            kept = [np.empty(0, np.int64)]
            new: dict[str, list] = {f.name: [] for f in (added.fields if added else [])}
            for i, j in _same_keys(b, keys) if b.num_rows else ():
                key = _key(b, keys, i)
                if key != now:
                    entered = now is None and b.column("_of")[i].as_py() == key
                    now, state = key, json.loads(b.column("_entry")[i].as_py()) if entered else machine.start
                state, made = machine.replay(state, [b.column(c).slice(i, j - i) for c in machine.columns])
                if added:
                    for name, values in made.items():
                        new[name] += values
                else:
                    kept.append(made + i)
            out = b.select(columns)
            if added:
                out = pa.RecordBatch.from_arrays([*out.columns, *[pa.array(new[f.name], kind.field(f.name).type) for f in added.fields]], schema=kind)
            else:
                out = pa.RecordBatch.from_arrays(out.take(pa.array(np.concatenate(kept))).columns, schema=kind)
            yield out

    return rows.mapInArrow(run, schema)


class Cooldown(Machine):
    """State: the last kept time. A run keeps from its first row that is late enough, so its function is a step for each such row, and rows that end alike are one."""

    def __init__(self, t: str, us: int):
        self.columns, self.us = (t,), us

    def open(self) -> list[np.ndarray]:
        return []

    def told(self, run: list[np.ndarray], values: list[pa.Array]) -> list[np.ndarray]:
        return [*run, values[0].drop_null().to_numpy(zero_copy_only=False)]

    def function(self, run: list[np.ndarray]) -> list[list[int]]:
        """(time, last kept) by time: entered so that a row at `time` is the first that is kept, the run keeps `last kept` last."""
        t = np.concatenate(run) if run else np.empty(0, np.int64)
        n = len(t)
        follow = np.append(np.searchsorted(t, t + self.us), n)
        last = np.append(np.arange(n), n)
        # Doubling: follow leads 2 ** k kept rows on, last is the last of them.
        while (follow[:n] < n).any():
            last = np.where(follow < n, last[np.minimum(follow, n)], last)
            follow = follow[follow]
        # No row after the first `us` can be the first one kept, but the one that the first keeps next.
        reach = min(np.searchsorted(t, t[0] + self.us) + 1, n) if n else 0
        ends = t[last[:reach]]
        change = np.flatnonzero(np.append(ends[1:] != ends[:-1], True)) if reach else []
        return [[int(t[i]), int(ends[i])] for i in change]

    def after(self, function: list[list[int]], state: int | None) -> int | None:
        at = 0 if state is None else bisect_left(function, [state + self.us])
        return function[at][1] if at < len(function) else state

    def replay(self, state: int | None, values: list[pa.Array]) -> tuple[int | None, np.ndarray]:
        valid = np.flatnonzero(values[0].is_valid().to_numpy(zero_copy_only=False))
        t, kept, at = values[0].drop_null().to_numpy(zero_copy_only=False), [], 0
        while True:
            at = max(at, 0 if state is None else int(np.searchsorted(t, state + self.us)))
            if at >= len(t):
                return state, valid[kept] if kept else np.empty(0, np.int64)
            kept.append(at)
            state, at = int(t[at]), at + 1


class Baseline(Machine):
    """State: the baseline. One above 0 is moved by an affine map as long as it stays above 0; at or below 0 the next value is taken as it is."""

    start = 0.0

    def __init__(self, value: str, keep: float, spike: float):
        self.columns, self.keep, self.spike = (value,), keep, spike

    def _next(self, base: float, x: float) -> float:
        return base * self.keep + x * 0.1 if base > 0 else x

    def open(self) -> list:
        """Scale and shift of the map, and tracks (entry up to which, value): the first is a run entered at 0, others fell to 0 on the way."""
        return [1.0, 0.0, [[0.0, 0.0]]]

    def told(self, run: list, values: list[pa.Array]) -> list:
        scale, shift, tracks = run
        for x in values[0].to_pylist():
            if x is None:
                continue
            for t in tracks:
                t[1] = self._next(t[1], x)
            scale, shift = scale * self.keep, shift * self.keep + x * 0.1
            falls = -shift / scale if scale > 0 else float("inf") if shift <= 0 else 0.0
            if falls > tracks[-1][0]:
                tracks.append([falls, 0.0])
        return [scale, shift, tracks]

    def function(self, run: list) -> list:
        return run

    def after(self, function: list, state: float) -> float:
        scale, shift, tracks = function
        for upto, value in tracks:
            if state <= upto:
                return value
        return state * scale + shift

    def replay(self, state: float, values: list[pa.Array]) -> tuple[float, dict[str, list]]:
        bases, spikes = [], []
        for x in values[0].to_pylist():
            spikes.append(x is not None and state > 0 and x > state * self.spike)
            state = state if x is None else self._next(state, x)
            bases.append(state)
        return state, {"baseline": bases, "is_spike": spikes}


class Health(Machine):
    """State: health (0 to 100) and status. A run is a table over the entry's health; entries that meet are followed as one."""

    columns, start = ("damage",), [100, "online"]

    def open(self) -> list:
        """Values that are followed, [health, status or None while the entry's own holds], and which of them each entry has."""
        return [[[h, None] for h in range(101)], list(range(101))]

    def told(self, run: list, values: list[pa.Array]) -> list:
        followed, which = run
        for n, damage in enumerate(values[0].to_pylist()):
            followed = [list(device_step((h, s), damage or 0)) for h, s in followed]
            if n % 16 == 0 and len(followed) > 1:
                places: dict[tuple, int] = {}
                at = [places.setdefault(tuple(x), len(places)) for x in followed]
                followed, which = [list(x) for x in places], [at[w] for w in which]
        return [followed, which]

    def function(self, run: list) -> list:
        return run

    def after(self, function: list, state: list) -> list:
        followed, which = function
        health, status = followed[which[state[0]]]
        return [health, state[1] if status is None else status]

    def replay(self, state: list, values: list[pa.Array]) -> tuple[list, dict[str, list]]:
        made = []
        for damage in values[0].to_pylist():
            state = list(device_step((state[0], state[1]), damage or 0))
            made.append(state)
        return state, {"health": [h for h, _ in made], "status": [s for _, s in made]}


def cooldown(df: DataFrame, keys: list[str], t: str, us: int, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rows kept greedily: each is at least `us` after the last kept row of its keys. Rows without a time are not kept."""
    return composed_fold(df, keys, [t, *order], Cooldown(t, us))


def baseline(df: DataFrame, value: str, keep: float = 0.9, spike: float = 3.0) -> DataFrame:
    """df (source_ip, ts_us, seq, value) plus baseline after the row and is_spike against the one before it. A null value changes nothing."""
    added = T.StructType([T.StructField("baseline", T.DoubleType()), T.StructField("is_spike", T.BooleanType())])
    return composed_fold(df, ["source_ip"], ["ts_us", "seq"], Baseline(value, keep, spike), added)


def device_step(state: tuple[int, str], damage: int) -> tuple[int, str]:
    """Health and status after damage, or after one healing step if damage is 0."""
    health, status = state
    if damage:
        health = max(0, health - damage)
        return health, "compromised" if health < 30 else "warning" if health < 70 else status
    if health < 100:
        health = min(100, health + 5)
        status = "online" if health > 70 else status
    return health, status


def device_health(df: DataFrame) -> DataFrame:
    """Rows (device, damage, ts_us, seq) plus health and status after each; no damage, or null, heals."""
    added = T.StructType([T.StructField("health", T.LongType()), T.StructField("status", T.StringType())])
    return composed_fold(df, ["device"], ["ts_us", "seq"], Health(), added)


def walk(df: DataFrame, key: str, value: str, start: float, factor: float) -> DataFrame:
    """Rows (key, ts_us, seq, value) plus level, which goes a share of the way to each value."""
    schema = T.StructType([*df.schema.fields, T.StructField("level", T.DoubleType())])

    def step(level: float, row: dict) -> tuple[float, dict]:
        level = level + (row[value] - level) * factor
        return level, row | {"level": level}

    return sorted_fold(df, [key], ["ts_us", "seq"], lambda: start, step, schema)
