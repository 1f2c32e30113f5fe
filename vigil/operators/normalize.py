"""Normalisation, address resolution and display projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.compat import half_up, ipv4, protected_ip, title_case, truthy, truthy_number

NOT_SOURCES = ("unknown", "Unknown", "127.0.0.1", "localhost")


def normalize(events: DataFrame, now: int | Column) -> DataFrame:
    """Fills event_id, domain, payload (JSON) and timestamp (seconds); missing, empty and 0 count as absent. Ids are digests of the row."""
    now = now if isinstance(now, Column) else F.lit(now)
    made = F.sha2(F.concat_ws("|", "source_ip", "service", "event_type", F.col("timestamp").cast("string")), 256)
    return events.withColumns({
        "event_id": F.coalesce(truthy(F.col("event_id")), made),
        "domain": F.coalesce("domain", F.lit("general")),
        "timestamp": F.coalesce(truthy_number(F.col("timestamp")), now),
        "received_at": now,
        "payload": F.coalesce("payload", F.lit("{}")) if "payload" in events.columns else F.lit("{}"),
    })


def source_ip(event_ip: Column, *candidates: Column) -> Column:
    """The first address that is given and names a real source, else the event's own, else unknown."""
    real = [F.when((c != "") & ~c.isin(*NOT_SOURCES), c) for c in (event_ip, *candidates)]
    return F.coalesce(*real, truthy(event_ip), F.lit("unknown"))


def attacker_ip(*candidates: Column, local: tuple[str, ...] = ()) -> Column:
    """The first IPv4 address that is not protected, else unknown."""
    return F.coalesce(*[F.when(ipv4(c) & ~protected_ip(c, local), c) for c in candidates], F.lit("unknown"))


def evidence_ip(*candidates: Column) -> Column:
    return F.coalesce(*[F.when((c != "") & ~c.isin("unknown", "Unknown"), c) for c in candidates], F.lit("unknown"))


def client_ip(forwarded: Column, real: Column, cf: Column, peer: Column) -> Column:
    """First forwarded address, then the other headers, then the peer."""
    first = F.when(forwarded != "", F.trim(F.get(F.split(forwarded, ","), F.lit(0))))
    return F.coalesce(first, *[F.when(c != "", F.trim(c)) for c in (real, cf)], truthy(peer), F.lit("unknown"))


def rate_category(path: Column) -> Column:
    return F.when(path.startswith("/auth") | path.startswith("/login"), "auth").when(path.startswith("/api"), "api").otherwise("default")


def chart_point(tel: DataFrame) -> DataFrame:
    """Display rounding: one decimal for cpu and memory, none for network; halves go up."""
    return tel.select(
        F.col("service").alias("device"), title_case(F.replace(F.col("service"), F.lit("-"), F.lit(" "))).alias("device_name"), "ts_us", "seq",
        half_up(F.coalesce("cpu", F.lit(50.0)), 1).alias("cpu"), half_up(F.coalesce("memory", F.lit(50.0)), 1).alias("memory"),
        half_up(F.coalesce("network", F.lit(100.0))).alias("network"), F.coalesce("requests", F.lit(100)).alias("requests"), F.date_format(F.timestamp_micros("ts_us"), "HH:mm:ss").alias("label"),
    )


def masked(text: Column) -> Column:
    return F.repeat(F.lit("*"), F.length(text))


def coerced(c: Column, valid: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*valid), c).otherwise(F.lit(default))


def sector_badge(rule: Column, sector: Column) -> Column:
    test = lambda s: F.coalesce(rule.contains(s), F.lit(False)) | F.coalesce(sector.contains(s), F.lit(False))
    return F.when(test("health"), "healthcare").when(test("agri"), "agriculture").when(test("urban"), "urban")


def relative_time(seconds: Column, card: bool = True) -> Column:
    """A card counts days; the timeline does not, and says just now of what is ahead."""
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    near = F.when(seconds < 0, "just now").when(seconds < 60, text(seconds, "s")).when(seconds < 3600, text(seconds / 60, "m"))
    return near.when(seconds < 86400, text(seconds / 3600, "h")).otherwise(text(seconds / 86400, "d")) if card else near.otherwise(text(seconds / 3600, "h"))


def iso_time(us: Column) -> Column:
    """Microseconds as UTC with six decimals and a Z."""
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def block_record(blocks: DataFrame, now_us: int) -> DataFrame:
    """Blocks (ip, blocked_us, expires_us; 0 for ever) as shown: ISO times, permanent, seconds that are left."""
    expires = F.when(F.col("expires_us") == 0, "permanent").otherwise(iso_time(F.col("expires_us")))
    return blocks.select("ip", iso_time(F.col("blocked_us")).alias("blocked_at"), expires.alias("expires_at"), remaining_seconds(F.col("expires_us"), F.lit(now_us)).alias("remaining_seconds"))


def draw(key: Column, seed: str) -> Column:
    """Uniform in [0, 1) from an MD5 digest of seed and key, in place of a random number."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def rate_text(per_minute: Column) -> Column:
    """Above 999 in thousands with one decimal, halves up."""
    return F.when(per_minute > 999, F.concat((F.floor(per_minute / 100 + 0.5) / 10).cast("string"), F.lit("k/min"))).otherwise(F.concat(per_minute.cast("string"), F.lit("/min")))


def attack_label(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit("_"), F.lit(" ")))


def remaining_seconds(expires_us: Column, now_us: Column) -> Column:
    """-1 for a permanent block (expiry 0)."""
    return F.when(expires_us == 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.floor((expires_us - now_us) / 1e6))).cast("bigint")


def gigabytes(c: Column) -> Column:
    return F.round(c / 1024.0**3, 1)


def megabytes(c: Column) -> Column:
    return F.round(c / 1024.0**2, 1)


def checked(requests: DataFrame, bypass: tuple[str, ...], local: tuple[str, ...] = ()) -> DataFrame:
    """requests (path, ip) that the perimeter looks at: not on a bypassed path, not from here."""
    return requests.where(~F.col("path").isin(*bypass) & ~protected_ip(F.col("ip"), local))


def failed_logins(requests: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """POST requests (path, method, status) to a login path that were refused."""
    starts = F.lit(False)
    for p in paths:
        starts = starts | F.col("path").startswith(p)
    return requests.where((F.col("method") == "POST") & starts & F.col("status").isin(401, 403))
