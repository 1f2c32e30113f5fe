"""Column helpers for dynamic-language semantics: truthiness, regular expressions, rounding, formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """The string, null if it is empty."""
    return F.when(c != "", c)


def truthy_number(c: Column) -> Column:
    """The number, null if it is 0."""
    return F.when(c != 0, c)


def ignore_case(pattern: str) -> str:
    """A Java pattern that ignores case as Unicode does and lets . stop at newlines only."""
    return f"(?iudU){pattern}"


def folded(c: Column) -> Column:
    """The text in lower case, with the two signs that equal an ASCII letter in another case."""
    return F.translate(F.lower(c), "\u017f\u212a", "sk")


def first_match(c: Column, patterns: tuple[str, ...], needs: tuple[tuple[str, ...], ...] = ()) -> Column:
    """Index of the first pattern found, null if none is.

    needs: for each pattern, parts of which a text that it matches holds one, in any
    case. A pattern is tried only on texts that hold one of its parts; the text is
    folded once.
    """
    if not needs:
        return F.coalesce(*[F.when(c.rlike(ignore_case(p)), F.lit(i)) for i, p in enumerate(patterns)])

    def tried(low: Column) -> Column:
        held = [reduce(Column.__or__, [low.contains(x) for x in some]) for some in needs]
        return F.coalesce(*[F.when(h & c.rlike(ignore_case(p)), F.lit(i)) for i, (p, h) in enumerate(zip(patterns, held, strict=True))])

    return F.get(F.transform(F.array(folded(c)), tried), F.lit(0))


def first_part(c: Column, parts: tuple[str, ...]) -> Column:
    """The first of the substrings that the lower-cased text holds, null if it holds none."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in parts])


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5).cast("double") / scale


def title_case(c: Column) -> Column:
    """Upper case for every letter that no letter precedes, lower case for the others."""
    cased = lambda chars: F.transform(chars, lambda x, i: F.when((i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(x)).otherwise(F.upper(x)))
    return F.array_join(F.flatten(F.transform(F.array(F.split(c, "")), cased)), "")


def fixed_point(c: Column, digits: int) -> Column:
    """Text of a non-negative double with so many decimals; halves of the binary value go to even."""
    unit, ten = 1 << 62, 10**digits
    part = ((c - F.floor(c)) * float(unit)).cast("bigint").cast("decimal(20,0)") * F.lit(ten).cast("decimal(5,0)")
    rest = part % F.lit(unit).cast("decimal(20,0)")
    whole = F.floor(c).cast("decimal(20,0)") * ten + (part - rest) / F.lit(unit).cast("decimal(20,0)")
    half = F.lit(unit // 2).cast("decimal(20,0)")
    n = (whole + F.when((rest > half) | ((rest == half) & (whole % 2 == 1)), 1).otherwise(0)).cast("bigint")
    if digits == 0:
        return n.cast("string")
    return F.concat(F.floor(n / ten).cast("string"), F.lit("."), F.lpad((n % ten).cast("string"), digits, "0"))


def ipv4(c: Column) -> Column:
    """Whether the text is four decimal numbers of 0 to 255 between dots; digits only."""
    parts = F.split(c, r"\.", -1)
    return F.coalesce((F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$") & (p != "")), F.lit(False))


def protected_ip(c: Column, local: tuple[str, ...] = ()) -> Column:
    """Loopback and the given local addresses."""
    return F.coalesce(c.isin("127.0.0.1", "localhost", "::1", *local) | c.startswith("127."), F.lit(False))
