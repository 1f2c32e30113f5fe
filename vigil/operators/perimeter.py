"""Perimeter state of one address: blocks, flood and rate windows, threat score, failed logins.

Each step takes a request and the state and returns what was decided. The batch
fold and the streaming processor call the same step.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dashboard import SCORES
from .folds import sorted_fold
from .joins import DURATIONS
from .rules import SQL_PARTS, XSS_PARTS

# Limits a minute by category, paths without checks, login paths, and their order.
LIMITS = {"default": 100, "api": 60, "auth": 10}
BYPASS = ("/health", "/docs", "/openapi.json", "/redoc", "/ip/dropped", "/ip/stats")
LOGIN_PATHS = ("/login", "/auth", "/api/auth", "/api/login")
RANK = ("low", "medium", "high", "critical")
LOCAL = ("127.0.0.1", "localhost", "::1")
SECOND = 1_000_000

#: Columns of a request, of a decision and of a block command.
REQUEST = T.StructType([T.StructField("source_ip", T.StringType()), T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("path", "query", "method")], T.StructField("status", T.IntegerType()), T.StructField("username", T.StringType())])
DECISION = T.StructType([T.StructField("source_ip", T.StringType()), T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("decision", "dropped", "audit")], T.StructField("score", T.LongType())])


@dataclass
class Address:
    """expires 0: for ever; None: not blocked. limit None: no request counted yet. A protected address is never blocked."""

    protected: bool = False
    expires: int | None = None
    severity: str = "low"
    reason: str = ""
    blocks: int = 0
    score: int = 0
    limit: int | None = None
    throttled: bool = False
    minute: list[int] = field(default_factory=list)
    ten: list[int] = field(default_factory=list)
    baseline: float = 0.0
    failed: list[int] = field(default_factory=list)
    users: list[str] = field(default_factory=list)
    last_failed: int | None = None

    def is_blocked(self, now: int, audit: list[str]) -> bool:
        if self.expires is None:
            return False
        if self.expires and now > self.expires:
            self.expires = None
            audit.append("auto_unblock")
            return False
        return True

    def block(self, now: int, reason: str, severity: str, audit: list[str], seconds: int | None = None) -> str:
        """Extends a block in force, else starts one, which adds to the score. Extending a permanent block makes it finite."""
        if self.protected:
            return "protected"
        seconds = DURATIONS[severity] if seconds is None else seconds
        until = now + seconds * SECOND if seconds > 0 else 0
        if self.expires is not None and (self.expires == 0 or now <= self.expires):
            self.blocks += 1
            self.expires = max(self.expires, until)
            self.severity = max(self.severity, severity, key=RANK.index)
            audit.append("extend_block")
            return "extended"
        self.expires, self.reason, self.severity, self.blocks = until, reason, severity, 1
        self.score += SCORES[severity]
        audit.append("block")
        return "blocked"

    def unblock(self, audit: list[str]) -> str:
        if self.expires is None:
            return "none"
        self.expires = None
        audit.append("unblock")
        return "unblocked"

    def throttle(self, limit: int, audit: list[str]) -> str:
        self.limit, self.throttled = limit, True
        audit.append("throttle")
        return "throttled"

    def suspect(self, now: int, points: int, audit: list[str]) -> str:
        self.score += points
        if self.score >= 100:
            return self.block(now, "abuse", "critical", audit)
        if self.score >= 75:
            return self.block(now, "abuse", "high", audit)
        return self.throttle(20, audit) if self.score >= 50 else "monitored"

    def flooded(self, now: int, dropped: list[str], audit: list[str]) -> str:
        """A spike over the baseline sets severity high, even where the count alone gave critical."""
        self.ten = [t for t in self.ten if t > now - 10 * SECOND] + [now]
        n = len(self.ten)
        rate = n / max((now - self.ten[0]) / SECOND, 0.1) if n >= 2 else float(n)
        severity = "critical" if n >= 100 else "high" if n >= 50 else None
        if self.baseline > 0 and rate > self.baseline * 3.0:
            severity = "high"
        self.baseline = self.baseline * 0.9 + rate * 0.1 if self.baseline > 0 else rate
        if severity is None:
            return "allowed"
        dropped.append("flooding")
        return self.block(now, "flooding", severity, audit) if n >= 100 else self.throttle(10, audit)

    def over_limit(self, now: int, category: str) -> bool:
        """The first category seen fixes the limit until a throttle sets another."""
        if self.limit is None:
            self.limit = LIMITS[category]
        self.minute = [t for t in self.minute if t > now - 60 * SECOND] + [now]
        if len(self.minute) > self.limit:
            self.throttled = True
            return True
        return False

    def login_failed(self, now: int, user: str, dropped: list[str], audit: list[str]) -> str:
        gap = None if self.last_failed is None else now - self.last_failed
        self.last_failed = now
        self.failed = [t for t in self.failed if t > now - 60 * SECOND] + [now]
        if user not in self.users:
            self.users.append(user)
        n = len(self.failed)
        severity = "high" if n >= 10 else "medium" if n >= 5 else None
        if (gap is not None and gap < SECOND and n >= 3) or len(self.users) >= 5:
            severity = "high"
        if severity is None:
            return "monitored"
        dropped.append("brute_force")
        return self.block(now, "brute_force", severity, audit)

    def login_succeeded(self) -> None:
        self.failed, self.users, self.last_failed = [], [], None


def is_protected(ip: str) -> bool:
    return ip in LOCAL or ip.startswith("127.")


def threat(query: str, path: str) -> str | None:
    """Class of a request by its raw query and path; scripts in the query come before SQL in it."""
    q, p = query.lower(), path.lower()
    if any(x in q for x in XSS_PARTS):
        return "xss"
    if any(x in q for x in SQL_PARTS):
        return "sql_injection"
    return "path_injection" if any(x in p for x in SQL_PARTS + XSS_PARTS) else None


def category(path: str) -> str:
    return "auth" if path.startswith(("/auth", "/login")) else "api" if path.startswith("/api") else "default"


def handle(a: Address, r: dict[str, Any]) -> dict[str, Any]:
    """What the perimeter decides on a request, with dropped records and audit entries it wrote."""
    now, path = r["ts_us"], r["path"] or ""
    a.protected = is_protected(r["source_ip"] or "unknown")
    dropped: list[str] = []
    audit: list[str] = []

    def decide() -> str:
        if path not in BYPASS and not a.protected:
            if a.is_blocked(now, audit):
                dropped.append("blocked_ip")
                return "blocked"
            if a.flooded(now, dropped, audit) == "blocked":
                return "flooding"
            if a.over_limit(now, category(path)):
                dropped.append("rate_limit")
                a.suspect(now, 25, audit)
                return "rate_limited"
        if not a.is_blocked(now, audit):
            kind = threat(r["query"] or "", path)
            if kind:
                dropped.append(kind)
                if a.suspect(now, 50, audit) == "blocked":
                    return kind
        # A login that succeeds is told by the entry point below, not seen here.
        if r["method"] == "POST" and path.startswith(LOGIN_PATHS) and r["status"] in (401, 403):
            if a.login_failed(now, r["username"] or "unknown", dropped, audit) == "blocked":
                return "brute_force"
        return "allowed"

    decision = decide()
    return {"source_ip": r["source_ip"], "ts_us": now, "seq": r["seq"], "decision": decision, "dropped": ",".join(dropped), "audit": ",".join(audit), "score": a.score}


def expired(a: Address, ip: str, now: int) -> list[dict[str, Any]]:
    """The end of a block that is over, as a decision of its own time."""
    until, audit = a.expires, []
    if a.is_blocked(now, audit) or not audit:
        return []
    return [{"source_ip": ip, "ts_us": until, "seq": None, "decision": "expired", "dropped": "", "audit": "auto_unblock", "score": a.score}]


def timeline(requests: DataFrame, until_us: int | None = None) -> DataFrame:
    """pipeline() with the ends of blocks as rows of their own, at their own time, as far as until_us (the last request's time if not given)."""
    if until_us is None:
        until_us = requests.agg(F.max("ts_us")).first()[0] or 0
    rows = requests.select(*[f.name for f in REQUEST.fields]).withColumn("_last", F.lit(0))
    stops = rows.select("source_ip").distinct().withColumns({"ts_us": F.lit(until_us).cast("bigint"), "_last": F.lit(1)})

    def step(a: Address, r: dict) -> tuple[Address, list[dict]]:
        ended = expired(a, r["source_ip"], r["ts_us"])
        return a, ended if r["_last"] else [*ended, handle(a, r)]

    return sorted_fold(rows.unionByName(stops, allowMissingColumns=True), ["source_ip"], ["_last", "ts_us", "seq"], Address, step, DECISION)


def pipeline(requests: DataFrame) -> DataFrame:
    """A decision for each request, in order of time and seq within its address."""

    def step(a: Address, r: dict) -> tuple[Address, dict]:
        out = handle(a, r)
        return a, out

    return sorted_fold(requests, ["source_ip"], ["ts_us", "seq"], Address, step, DECISION)


COMMAND_OUT = T.StructType([T.StructField("ip", T.StringType()), T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("action", T.StringType()), T.StructField("expires_us", T.LongType()), T.StructField("blocks", T.LongType()), T.StructField("severity", T.StringType())])


def lifecycle(commands: DataFrame) -> DataFrame:
    """Audit rows of commands (ip, ts_us, seq, op: block or unblock, severity, seconds); protected addresses are refused."""

    def step(a: Address, r: dict) -> tuple[Address, dict]:
        audit: list[str] = []
        a.protected = is_protected(r["ip"])
        a.is_blocked(r["ts_us"], audit)
        if r["op"] != "block":
            a.unblock(audit)
        elif a.block(r["ts_us"], "manual", r["severity"], audit, r["seconds"]) == "protected":
            audit.append("refused")
        return a, {"ip": r["ip"], "ts_us": r["ts_us"], "seq": r["seq"], "action": ",".join(audit), "expires_us": a.expires, "blocks": a.blocks, "severity": a.severity}

    return sorted_fold(commands, ["ip"], ["ts_us", "seq"], Address, step, COMMAND_OUT)


ENTRY_OUT = T.StructType([T.StructField("ip", T.StringType()), T.StructField("ts_us", T.LongType()), T.StructField("seq", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("result", "dropped", "audit")], T.StructField("score", T.LongType())])


def report(a: Address, r: dict[str, Any]) -> dict[str, Any]:
    """What a reported login (op auth: username, success) or suspicious act (op threat: points) brings. A login that succeeds clears the failed ones."""
    dropped: list[str] = []
    audit: list[str] = []
    a.protected = is_protected(r["ip"])
    if r["op"] == "threat":
        result = a.suspect(r["ts_us"], r["points"], audit)
    elif r["success"]:
        a.login_succeeded()
        result = "none"
    else:
        result = a.login_failed(r["ts_us"], r["username"] or "unknown", dropped, audit)
    return {"ip": r["ip"], "ts_us": r["ts_us"], "seq": r["seq"], "result": result, "dropped": ",".join(dropped), "audit": ",".join(audit), "score": a.score}


def reports(rows: DataFrame) -> DataFrame:
    """Results of reports (ip, ts_us, seq, op, username, success, points) in order of time and seq within their address."""
    return sorted_fold(rows, ["ip"], ["ts_us", "seq"], Address, lambda a, r: (a, report(a, r)), ENTRY_OUT)


def agent_flood(requests: DataFrame, seconds: int = 10, most: int = 5_000, block_s: int = 60) -> DataFrame:
    """requests (source_ip, ts_us, seq) plus limited: an address beyond `most` in the window is blocked for a while, and its requests are not counted then."""
    schema = T.StructType([*requests.schema.fields, T.StructField("limited", T.BooleanType())])

    def step(state: tuple[list[int], int | None], r: dict) -> tuple[tuple[list[int], int | None], dict]:
        (times, until), now = state, r["ts_us"]
        if until is not None and now <= until:
            return state, r | {"limited": True}
        times = [t for t in times if now - t < seconds * SECOND] + [now]
        over = len(times) > most
        return (times, now + block_s * SECOND if over else None), r | {"limited": over}

    return sorted_fold(requests, ["source_ip"], ["ts_us", "seq"], lambda: ([], None), step, schema)


def dump(a: Address) -> dict[str, Any]:
    return asdict(a)
