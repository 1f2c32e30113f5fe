"""The perimeter and the ledger as streams: typed state, and timers in event time.

A block ends at its own end: a timer of that time brings the row, not a sweep.
Rows of a micro-batch are taken in order of time; rows behind the watermark are
dropped by Spark. Both need a RocksDB state store, see session.local_session.
Named columns of the state may be added later, as Spark evolves a state's schema.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.operators.ledger import AUDIT, COMMAND, Entry, audit, clear_row
from vigil.operators.perimeter import DECISION, REQUEST, Address, expired, handle

#: An address without requests for so long is forgotten, unless a block holds it.
IDLE_S = 24 * 3600
ADDRESS = "protected boolean, expires bigint, severity string, reason string, blocks int, score bigint, limit int, throttled boolean, minute array<bigint>, ten array<bigint>, baseline double, failed array<bigint>, users array<string>, last_failed bigint, seen bigint, wake bigint, due bigint"
FIELDS = tuple(c.split()[0] for c in ADDRESS.split(", "))
ENTRY = "expires bigint, since bigint, reason string, severity string, blocks int, limit int"


def _rows(frames: Iterator[pd.DataFrame]) -> list[dict[str, Any]]:
    """The rows of a key's frames with None for null, by time and seq; no seq comes first, as in a sort of Spark's. Whole numbers come as floats where a frame has a null."""
    rows = [{k: int(v) if isinstance(v, float) else v for k, v in r.items()} for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")]
    return sorted(rows, key=lambda r: (r["ts_us"], r["seq"] is not None, r["seq"] or 0))


def _frame(rows: list[dict[str, Any]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([tuple(r[n] for n in names) for r in rows], columns=names, dtype=object)


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.where("ts_us is not null").withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", late)


def _after(us: int) -> int:
    """The first millisecond in which a block with this end is over."""
    return us // 1000 + 1


class Perimeter(StatefulProcessor):
    """State of one address, see perimeter.Address, and the times of its two timers: wake for idleness, due for a block's end.

    A timer that fires too early, as requests came or the block was extended, is set anew, so an address has two at most.
    """

    def __init__(self, idle_s: int):
        self.idle_us, self.names = idle_s * 1_000_000, [f.name for f in DECISION.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("address", ADDRESS)

    def _load(self) -> tuple[Address, dict[str, int | None]]:
        if not self.state.exists():
            return Address(), {"seen": 0, "wake": None, "due": None}
        kept = dict(zip(FIELDS, self.state.get(), strict=True))
        times = {k: kept.pop(k) for k in ("seen", "wake", "due")}
        return Address(**{k: list(v) if k in ("minute", "ten", "failed", "users") else v for k, v in kept.items()}), times

    def _save(self, a: Address, times: dict[str, int | None]) -> None:
        """Keeps the state and sets the timers that are not set."""
        for name, at in (("wake", _after(times["seen"] + self.idle_us)), ("due", _after(a.expires) if a.expires else None)):
            if times[name] is None and at is not None:
                times[name] = at
                self.handle.registerTimer(at)
        self.state.update(tuple(times[f] if f in times else getattr(a, f) for f in FIELDS))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        a, times = self._load()
        out = []
        for r in _rows(rows):
            out += expired(a, r["source_ip"], r["ts_us"])
            out.append(handle(a, r))
            times["seen"] = max(times["seen"], r["ts_us"])
        self._save(a, times)
        yield _frame(out, self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        a, times = self._load()
        out = expired(a, key[0], at * 1000)
        times |= {k: None for k in ("wake", "due") if times[k] is not None and times[k] <= at}
        if a.expires is None and times["seen"] + self.idle_us < at * 1000:
            self.state.clear()
        else:
            self._save(a, times)
        if out:
            yield _frame(out, self.names)

    def close(self) -> None:
        pass


def perimeter(requests: DataFrame, late: str = "10 seconds", idle_s: int = IDLE_S) -> DataFrame:
    """Decisions for a stream of requests (perimeter.REQUEST), and a row `expired` at the end of each block that ends by itself; the same rows as perimeter.timeline()."""
    rows = _timed(requests.select(*[f.name for f in REQUEST.fields]), late)
    return rows.groupBy("source_ip").transformWithStateInPandas(Perimeter(idle_s), DECISION, "Append", "EventTime")


class Nodes(StatefulProcessor):
    """When a node was last heard of, whether it counts as online, and the time of its one timer."""

    def __init__(self, after_s: int):
        self.after_us = after_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("node", "last bigint, online boolean, sector string, wake bigint")

    def _told(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["node_id", "sector", "status", "ts_us", "registered"], dtype=object)

    def _save(self, last: int, online: bool, sector: str | None, wake: int | None) -> None:
        if wake is None and online:
            wake = _after(last + self.after_us)
            self.handle.registerTimer(wake)
        self.state.update((last, online, sector, wake))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, online, sector, wake = self.state.get() if self.state.exists() else (None, False, None, None)
        out = []
        for r in _rows(rows):
            if last is not None and online and r["ts_us"] - last > self.after_us:
                out.append((key[0], r["domain"], "offline", last + self.after_us, False))
                online = False
            if not online:
                out.append((key[0], r["domain"], "online", r["ts_us"], last is None))
            last, online, sector = r["ts_us"] if last is None else max(last, r["ts_us"]), True, r["domain"]
        self._save(last, online, sector, wake)
        yield self._told(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, online, sector, _ = self.state.get()
        gone = online and expiredTimerInfo.getExpiryTimeInMs() * 1000 - last > self.after_us
        self._save(last, online and not gone, sector, None)
        if gone:
            yield self._told([(key[0], sector, "offline", last + self.after_us, False)])

    def close(self) -> None:
        pass


def node_status(beats: DataFrame, after_s: int = 30, late: str = "10 seconds") -> DataFrame:
    """joins.status_changes() of a stream of heartbeats (service, domain, ts_us, seq): a node that falls silent goes offline by a timer."""
    rows = _timed(beats.where("service is not null").select("service", "domain", "ts_us", "seq"), late)
    kind = "node_id string, sector string, status string, ts_us bigint, registered boolean"
    return rows.groupBy("service").transformWithStateInPandas(Nodes(after_s), kind, "Append", "EventTime")


class Ledger(StatefulProcessor):
    """Blocks of a shard's addresses by address, and addresses by the millisecond after their block's end.

    A clear comes to every shard and ends all that it holds; each shard tells how
    many blocks it ended, and shard 0 writes the entry.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [f.name for f in AUDIT.fields]
        self.entries = handle.getMapState("entries", "ip string", ENTRY)
        self.ends = handle.getMapState("ends", "at bigint", "ips array<string>")

    def _entry(self, ip: str) -> Entry:
        return Entry(*self.entries.getValue((ip,))) if self.entries.containsKey((ip,)) else Entry()

    def _keep(self, ip: str, e: Entry) -> None:
        self.entries.updateValue((ip,), (e.expires, e.since, e.reason, e.severity, e.blocks, e.limit))

    def _wait(self, ip: str, until: int) -> None:
        at = _after(until)
        ips = list(self.ends.getValue((at,))[0]) if self.ends.containsKey((at,)) else []
        if ip not in ips:
            self.ends.updateValue((at,), ([*ips, ip],))
        self.handle.registerTimer(at)

    def _clear(self, shard: int, r: dict[str, Any]) -> list[dict[str, Any]]:
        out, held = [], 0
        for (ip,), kept in list(self.entries.iterator()):
            e = Entry(*kept)
            out += e.ended(ip, r["ts_us"])
            held += e.expires is not None
        self.entries.clear()
        out.append(audit("cleared", "ALL", "", "", r["ts_us"], r["seq"], "", cleared=held))
        return [*out, clear_row(r["ts_us"], r["seq"], None)] if shard == 0 else out

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for r in _rows(rows):
            if r["op"] == "clear":
                out += self._clear(key[0], r)
                continue
            e = self._entry(r["ip"])
            before = e.expires
            out += e.command(r)
            self._keep(r["ip"], e)
            if e.expires and e.expires != before:
                self._wait(r["ip"], e.expires)
        yield _frame(out, self.names)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        for ip in self.ends.getValue((at,))[0] if self.ends.containsKey((at,)) else ():
            e = self._entry(ip)
            ended = e.ended(ip, at * 1000)
            if ended and e.limit is None:
                self.entries.removeKey((ip,))
            elif ended:
                self._keep(ip, e)
            out += ended
        self.ends.removeKey((at,))
        if out:
            yield _frame(out, self.names)

    def close(self) -> None:
        pass


def ledger(commands: DataFrame, shards: int = 64, late: str = "10 seconds") -> DataFrame:
    """Audit rows of a stream of commands (ledger.COMMAND): those of the batch ledger, but what a clear ended comes as a row `cleared` of each shard, see cleared().

    Addresses are dealt to shards by a hash, and a clear goes to each of them.
    """
    rows = commands.select(*[f.name for f in COMMAND.fields]).where("op = 'clear' or ip is not null")
    own = F.array(F.pmod(F.xxhash64("ip"), F.lit(shards)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    dealt = _timed(rows.withColumn("shard", F.explode(F.when(F.col("op") == "clear", every).otherwise(own))), late)
    return dealt.groupBy("shard").transformWithStateInPandas(Ledger(), AUDIT, "Append", "EventTime")


def cleared(rows: DataFrame) -> DataFrame:
    """Audit rows (of a batch) in which a clear has the blocks that all shards ended."""
    parts = rows.where("action = 'cleared'").groupBy(F.col("ts_us").alias("_at"), F.col("seq").alias("_seq")).agg(F.sum("cleared").alias("_n"))
    wipes = rows.where("action = 'clear_all'").join(parts, (F.col("ts_us") == F.col("_at")) & F.col("seq").eqNullSafe(F.col("_seq")), "left")
    told = wipes.select(*[F.col("_n").alias("cleared") if f.name == "cleared" else F.col(f.name) for f in AUDIT.fields])
    return rows.where("action not in ('cleared', 'clear_all')").unionByName(told)
