"""Commands of operators: sets of blocked, isolated and throttled targets, block lists and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import running

#: What turns a target's state on and off, with the words for done and for nothing to do.
PAIRS = {"block": ("unblock", "blocked", "already_blocked", "unblocked", "not_blocked"), "isolate": ("restore", "isolated", "already_isolated", "restored", "not_isolated"), "throttle": ("unthrottle", "throttled", "throttled", "unthrottled", "not_throttled")}


def manual(rows: DataFrame) -> DataFrame:
    """Commands (seq, op, target) plus status; op is one of the pairs or reset, which ends every state.

    A command's result depends on the last one of its pair on its target since the
    last reset: a running maximum, so a target of any number of commands is many tasks.
    """
    kind = F.coalesce(*[F.when(F.col("op").isin(on, off), F.lit(on)) for on, (off, *_) in PAIRS.items()], F.lit("reset"))
    epochs = running(rows.withColumns({"_all": F.lit(0), "_kind": kind}), "_all", ("seq",), _epoch=("sum", (F.col("op") == "reset").cast("bigint"), False))
    keyed = epochs.withColumn("_key", F.concat_ws("|", "_kind", "_epoch", "target"))
    last = running(keyed, "_key", ("seq",), _before=("max", F.struct("seq", "op"), False))
    on = F.coalesce(F.col("_before.op").isin(*PAIRS), F.lit(False))
    status = F.when(F.col("op") == "reset", "reset")
    for name, (off, done, again, undone, nothing) in PAIRS.items():
        status = status.when(F.col("op") == name, F.when(on, again).otherwise(done)).when(F.col("op") == off, F.when(on, undone).otherwise(nothing))
    return last.select(*rows.columns, status.alias("status"))


def blocked_everywhere(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Distinct addresses (ip) that either list holds."""
    return local.select("ip").unionByName(remote.select("ip")).distinct()


def appended(history: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """history plus the rows of fresh whose key it lacks; of several with one key the first by seq."""
    firsts = fresh.groupBy(key).agg(F.min_by(F.struct(*fresh.columns), "seq").alias("_r")).select("_r.*")
    return history.unionByName(firsts.join(history.select(key), key, "left_anti").select(*history.columns))


def members(changes: DataFrame) -> DataFrame:
    """(name) of changes (name, seq, present) whose last one adds."""
    return changes.groupBy("name").agg(F.max_by("present", "seq").alias("present")).where("present").select("name")
