"""The perimeter and the ledger against a model written separately, as dictionaries of all addresses at once."""

import random

from vigil.operators import perimeter

S = 1_000_000
ORDER = ["low", "medium", "high", "critical"]
SECONDS = {"low": 60, "medium": 300, "high": 600, "critical": 900}
POINTS = {"low": 10, "medium": 25, "high": 50, "critical": 100}


class Ledger:
    def __init__(self):
        self.blocks, self.points, self.limits, self.hits, self.bursts, self.base, self.fails, self.names, self.last = ({} for _ in range(9))
        self.dropped, self.audit = [], []

    def local(self, ip):
        return ip in ("127.0.0.1", "localhost", "::1") or ip.startswith("127.")

    def blocked(self, ip, now):
        if ip not in self.blocks:
            return False
        end = self.blocks[ip][0]
        if end and now > end:
            del self.blocks[ip]
            self.audit.append("auto_unblock")
            return False
        return True

    def block(self, ip, now, severity, seconds=None):
        if self.local(ip):
            return "protected"
        seconds = SECONDS[severity] if seconds is None else seconds
        end = now + seconds * S if seconds else 0
        held = self.blocks.get(ip)
        if held and (not held[0] or now <= held[0]):
            self.blocks[ip] = (max(held[0], end), ORDER[max(ORDER.index(held[1]), ORDER.index(severity))], held[2] + 1)
            self.audit.append("extend_block")
            return "extended"
        self.blocks[ip] = (end, severity, 1)
        self.points[ip] = self.points.get(ip, 0) + POINTS[severity]
        self.audit.append("block")
        return "blocked"

    def throttle(self, ip, limit):
        self.limits[ip] = limit
        self.audit.append("throttle")
        return "throttled"

    def suspicious(self, ip, now, points):
        self.points[ip] = total = self.points.get(ip, 0) + points
        if total >= 100:
            return self.block(ip, now, "critical")
        if total >= 75:
            return self.block(ip, now, "high")
        return self.throttle(ip, 20) if total >= 50 else "monitored"

    def request(self, ip, now, path, query, method, status, user):
        self.dropped, self.audit = [], []
        if path not in ("/health", "/docs", "/openapi.json", "/redoc", "/ip/dropped", "/ip/stats") and not self.local(ip):
            if self.blocked(ip, now):
                self.dropped.append("blocked_ip")
                return "blocked"
            times = self.bursts[ip] = [t for t in self.bursts.get(ip, []) if t > now - 10 * S] + [now]
            rate = len(times) / max((now - times[0]) / S, 0.1) if len(times) > 1 else float(len(times))
            old = self.base.get(ip, 0.0)
            level = "critical" if len(times) >= 100 else "high" if len(times) >= 50 else None
            if old > 0 and rate > 3 * old:
                level = "high"
            self.base[ip] = old * 0.9 + rate * 0.1 if old > 0 else rate
            if level:
                self.dropped.append("flooding")
                if (self.block(ip, now, level) if len(times) >= 100 else self.throttle(ip, 10)) == "blocked":
                    return "flooding"
            kind = "auth" if path.startswith(("/auth", "/login")) else "api" if path.startswith("/api") else "default"
            self.limits.setdefault(ip, {"default": 100, "api": 60, "auth": 10}[kind])
            self.hits[ip] = [t for t in self.hits.get(ip, []) if t > now - 60 * S] + [now]
            if len(self.hits[ip]) > self.limits[ip]:
                self.dropped.append("rate_limit")
                self.suspicious(ip, now, 25)
                return "rate_limited"
        if not self.blocked(ip, now):
            q, p = query.lower(), path.lower()
            sql = ("' or ", "' and ", "1=1", "1 = 1", "union select", "drop table", "delete from", "--", ";--", "/*", "*/", "exec(", "execute(")
            xss = ("<script", "javascript:", "onerror=", "onclick=", "onload=", "eval(")
            kind = "xss" if any(x in q for x in xss) else "sql_injection" if any(x in q for x in sql) else "path_injection" if any(x in p for x in sql + xss) else None
            if kind:
                self.dropped.append(kind)
                if self.suspicious(ip, now, 50) == "blocked":
                    return kind
        if method == "POST" and path.startswith(("/login", "/auth", "/api/auth", "/api/login")) and status in (401, 403):
            if self.failed(ip, now, user or "unknown") == "blocked":
                return "brute_force"
        return "allowed"

    def failed(self, ip, now, user):
        gap = now - self.last[ip] if ip in self.last else None
        self.last[ip] = now
        times = self.fails[ip] = [t for t in self.fails.get(ip, []) if t > now - 60 * S] + [now]
        self.names.setdefault(ip, set()).add(user)
        level = "high" if len(times) >= 10 else "medium" if len(times) >= 5 else None
        if (gap is not None and gap < S and len(times) >= 3) or len(self.names[ip]) >= 5:
            level = "high"
        if not level:
            return "monitored"
        self.dropped.append("brute_force")
        return self.block(ip, now, level)

    def attempt(self, ip, now, user, success):
        self.dropped, self.audit = [], []
        if success:
            for x in (self.fails, self.names, self.last):
                x.pop(ip, None)
            return "none"
        return self.failed(ip, now, user)


def test_requests_of_many_addresses():
    for seed in range(12):
        rng, now = random.Random(seed), 10**12
        model, held = Ledger(), {}
        ips = ["127.0.0.1", "127.9.9.9", "::1", "9.9.9.9", "8.8.8.8", "7.7.7.7"]
        for i in range(1500):
            now += rng.choice([0, S // 100, S // 20, S, 30 * S, 400 * S]) if rng.random() < 0.9 else 1000 * S
            r = dict(source_ip=rng.choice(ips), ts_us=now, seq=i, path=rng.choice(["/", "/", "/health", "/login", "/api/x", "/api/login", "/a?drop table"]), query=rng.choice(["", "", "", "x=1=1", "<SCRIPT", "a -- b"]), method=rng.choice(["GET", "POST"]), status=rng.choice([200, 401, 403]), username=rng.choice("abcdef"))
            got = perimeter.handle(held.setdefault(r["source_ip"], perimeter.Address()), r)
            want = model.request(r["source_ip"], now, r["path"], r["query"], r["method"], r["status"], r["username"])
            assert (got["decision"], got["dropped"], got["audit"], got["score"]) == (want, ",".join(model.dropped), ",".join(model.audit), model.points.get(r["source_ip"], 0)), (seed, i, r)


def test_protected_addresses_are_never_blocked():
    a = perimeter.Address()
    rows = [dict(source_ip="127.0.0.1", ts_us=i * S, seq=i, path="/", query="1=1", method="GET", status=200, username=None) for i in range(5)]
    assert {perimeter.handle(a, r)["decision"] for r in rows} == {"allowed"} and a.expires is None and a.score == 250


def test_reported_logins(spark):
    rng, rows = random.Random(3), []
    for i in range(300):
        rows.append((rng.choice(["1.1.1.1", "2.2.2.2", "127.0.0.1"]), (i * 7 + rng.randrange(3)) * S, i, rng.choice(["auth", "auth", "auth", "threat"]), rng.choice("abcd"), rng.random() < 0.2, 25))
    df = spark.createDataFrame(rows, "ip string, ts_us bigint, seq bigint, op string, username string, success boolean, points bigint")
    got, model = {r.seq: r for r in perimeter.reports(df).collect()}, Ledger()
    for ip, now, seq, op, user, success, points in sorted(rows, key=lambda r: (r[1], r[2])):
        if op == "auth":
            want = model.attempt(ip, now, user, success)
        else:
            model.dropped, model.audit = [], []
            want = model.suspicious(ip, now, points)
        assert (got[seq].result, got[seq].dropped, got[seq].audit, got[seq].score) == (want, ",".join(model.dropped), ",".join(model.audit), model.points.get(ip, 0))
