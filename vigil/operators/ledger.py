"""The ledger of blocks: commands in, full audit rows out.

Commands (ip, ts_us, seq, op, reason, severity, seconds, limit, triggered_by) are
block, unblock, throttle and clear. A block ends by itself at its own time, with
an audit row of that time. A clear ends the state of every address: it cuts time
into epochs, and addresses are folded by (ip, epoch). The streaming form in
vigil.streaming.stateful takes the same steps.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import sorted_fold
from .joins import DURATIONS
from .perimeter import RANK, is_protected
from .windows import running

SECOND = 1_000_000
#: A clear that does not outnumber this meets the keys of its epoch by broadcast.
FEW_CLEARS = 10_000

COMMAND = T.StructType([T.StructField("ip", T.StringType()), T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("op", "reason", "severity")], T.StructField("seconds", T.LongType()), T.StructField("limit", T.LongType()), T.StructField("triggered_by", T.StringType())])
AUDIT = T.StructType([*[T.StructField(c, T.StringType()) for c in ("action", "ip", "reason", "severity")], T.StructField("duration", T.LongType()), T.StructField("triggered_by", T.StringType()), T.StructField("details", T.StringType()), T.StructField("cleared", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType())])


def audit(action: str, ip: str, reason: str, severity: str, ts_us: int, seq: int | None, triggered_by: str, duration: int | None = None, details: dict | None = None, cleared: int | None = None) -> dict[str, Any]:
    return {"action": action, "ip": ip, "reason": reason, "severity": severity, "duration": duration, "triggered_by": triggered_by, "details": json.dumps(details or {}, separators=(",", ":")), "cleared": cleared, "ts_us": ts_us, "seq": seq}


@dataclass
class Entry:
    """What the ledger knows of an address. expires 0: for ever; None: not blocked."""

    expires: int | None = None
    since: int = 0
    reason: str = ""
    severity: str = ""
    blocks: int = 0
    limit: int | None = None

    def ended(self, ip: str, now: int) -> list[dict[str, Any]]:
        """The end of a block that is over, at its own time."""
        if not self.expires or now <= self.expires:
            return []
        until, self.expires = self.expires, None
        return [audit("auto_unblock", ip, self.reason, self.severity, until, None, "expiry", details={"was_blocked_for": (until - self.since) // SECOND})]

    def command(self, r: dict[str, Any]) -> list[dict[str, Any]]:
        """Audit rows of a command, the end of a block before it included."""
        ip, now, seq = r["ip"], r["ts_us"], r["seq"]
        out = self.ended(ip, now)
        by = r["triggered_by"] or ("system" if r["op"] == "block" else "manual")
        if r["op"] == "block" and not is_protected(ip):
            reason, severity = r["reason"] or "manual", r["severity"] if r["severity"] in RANK else "high"
            seconds = DURATIONS[severity] if r["seconds"] is None else r["seconds"]
            until = now + seconds * SECOND if seconds > 0 else 0
            if self.expires is not None:
                self.expires, self.blocks = max(self.expires, until), self.blocks + 1
                self.severity = max(self.severity, severity, key=RANK.index)
                out.append(audit("extend_block", ip, reason, severity, now, seq, by, seconds))
            else:
                self.expires, self.since, self.reason, self.severity, self.blocks = until, now, reason, severity, 1
                out.append(audit("block", ip, reason, severity, now, seq, by, seconds))
        elif r["op"] == "unblock" and self.expires is not None:
            self.expires = None
            out.append(audit("unblock", ip, self.reason, self.severity, now, seq, by, details={"was_blocked_for": (now - self.since) // SECOND}))
        elif r["op"] == "throttle":
            self.limit = 10 if r["limit"] is None else r["limit"]
            out.append(audit("throttle", ip, "rate_limit", "medium", now, seq, "system", 300 if r["seconds"] is None else r["seconds"], {"new_limit": self.limit}))
        return out


def clear_row(ts_us: int, seq: int | None, cleared: int) -> dict[str, Any]:
    return audit("clear_all", "ALL", "manual", "info", ts_us, seq, "admin", cleared=cleared)


def ledger(commands: DataFrame, until_us: int | None = None) -> DataFrame:
    """Audit rows (AUDIT) of commands (COMMAND) in order of ts_us and seq.

    Blocks whose end lies before until_us, the last command's time if it is not
    given, end by themselves. Commands without an address or time are left out,
    except clears, which need none; protected addresses are not blocked. A clear
    tells how many blocks it ended.
    """
    rows = commands.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in COMMAND.fields]).where("ts_us is not null and (op = 'clear' or ip is not null)")
    is_clear = F.col("op") == "clear"
    dealt = running(rows.withColumn("_all", F.lit(0)), "_all", ("ts_us", "seq", "ip", "op"), epoch=("sum", is_clear.cast("bigint"), False)).drop("_all")
    clears = dealt.where(is_clear).select("epoch", F.col("ts_us").alias("_end"), F.col("seq").alias("_clear"))
    if until_us is None:
        until_us = rows.agg(F.max("ts_us")).first()[0] or 0
    keys = dealt.where(~is_clear).select("ip", "epoch").distinct()
    if clears.limit(FEW_CLEARS + 1).count() <= FEW_CLEARS:
        clears = F.broadcast(clears)
    ends = keys.join(clears, "epoch", "left").select("ip", "epoch", F.coalesce("_end", F.lit(until_us)).alias("ts_us"), F.when(F.col("_end").isNull(), "stop").otherwise("end").alias("op"), F.lit(1).alias("_last"))
    every = dealt.where(~is_clear).withColumn("_last", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    schema = T.StructType([*AUDIT.fields, T.StructField("epoch", T.LongType())])

    def step(e: Entry, r: dict) -> tuple[Entry, list[dict]]:
        if r["_last"]:
            out = e.ended(r["ip"], r["ts_us"])
            if r["op"] == "end" and e.expires is not None:
                out.append(audit("cleared", r["ip"], "", "", r["ts_us"], None, ""))
        else:
            out = e.command(r)
        return e, [x | {"epoch": r["epoch"]} for x in out]

    told = sorted_fold(every, ["ip", "epoch"], ["_last", "ts_us", "seq"], Entry, step, schema)
    n = told.where("action = 'cleared'").groupBy("epoch").agg(F.count(F.lit(1)).alias("_n"))
    names = [f.name for f in AUDIT.fields]
    wiped = {"action": F.lit("clear_all"), "ip": F.lit("ALL"), "reason": F.lit("manual"), "severity": F.lit("info"), "duration": F.lit(None), "triggered_by": F.lit("admin"), "details": F.lit("{}"), "cleared": F.coalesce("_n", F.lit(0)), "ts_us": F.col("_end"), "seq": F.col("_clear")}
    wipes = clears.join(n, "epoch", "left").select(*[wiped[f.name].cast(f.dataType).alias(f.name) for f in AUDIT.fields])
    return told.where("action <> 'cleared'").select(*names).unionByName(wipes)


def heard(rows: DataFrame) -> DataFrame:
    """(topic, ip, ts_us, body) of audit rows: what subscribers of the ledger hear."""
    topics = {"block": "ip:blocked", "extend_block": "ip:blocked", "unblock": "ip:unblocked", "auto_unblock": "ip:unblocked", "throttle": "ip:rate_limited", "clear_all": "ip:cleared"}
    named = F.create_map(*[F.lit(x) for p in topics.items() for x in p])
    body = F.to_json(F.struct("reason", "severity", "duration", "triggered_by", "details", "cleared"))
    return rows.select(F.try_element_at(named, F.col("action")).alias("topic"), "ip", "ts_us", body.alias("body")).where("topic is not null")


def page(rows: DataFrame, n: int = 100) -> DataFrame:
    """The newest n audit rows, newest first."""
    return rows.orderBy(F.desc("ts_us"), F.desc_nulls_last("seq"), "action", "ip").limit(n)
