"""Personal data spans, DataFrame functions only.

Regular expressions propose spans, checksums and range checks confirm them, and
words close to a span move its score: a weak candidate (a date, a bare number, a
random string) is kept only beside words that tell what it is. Positions come from
the pieces between matches, so no text leaves its row and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import _fresh


@dataclass(frozen=True)
class Kind:
    """pattern: possessive form for Java, the same matches as plain without its backtracking. probe: a text without it holds no match."""

    name: str
    pattern: str
    plain: str
    probe: str
    base: bool
    prior: float
    near: str


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@", True, 0.8, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", ".", True, 0.6, "address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", "", True, 0.7, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.7, "phone|call|tel|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "", False, 0.7, "iban|account|bank"),
    Kind("tel", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", "", False, 0.3, "phone|call|tel|fax"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", False, 0.3, "ssn|social|tax"),
    Kind("birth", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}", "", False, 0.3, "born|birth|dob"),
    Kind("secret", r"[A-Za-z0-9+/_-]{20,}+", r"[A-Za-z0-9+/_-]{20,}", "", False, 0.3, "key|token|secret|passw|credential|auth"),
)
#: Matches that are placed one after the other, before such runs are.
RUN = 128
#: An added span needs this score; base spans stay at any score.
KEEP = 0.5
NEAR_BONUS = 0.2
NEAR_CHARS = 40
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = turned.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 99), F.substring(plain, 1, 4))

    def fold(rest: Column, i: Column) -> Column:
        c = turned.substr(i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(letter >= 10, (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), fold) == 1


def _confirmed(kind: str, x: Column) -> Column:
    m, left, right = x["m"], x["left"], x["right"]
    edge = ~F.substring(left, -1, 1).rlike("[A-Za-z0-9]") & ~F.substring(right, 1, 1).rlike("[A-Za-z0-9]")
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return F.when(edge, _mod97(m)).otherwise(F.lit(False))
    if kind in ("ssn", "birth"):
        return edge
    if kind == "secret":
        return m.rlike("^(?:[^0-9]*[0-9]){4}") & m.rlike("^(?:[^A-Za-z]*[A-Za-z]){4}")
    if kind == "tel":
        return edge & ~F.substring(left, -1, 1).isin("+", "-", ".", ")")
    return F.lit(True)


def _found(text: Column, kind: Kind, rank: int, matches: Column) -> Column:
    """array<struct<start,rank,end,score,kind>> of the confirmed matches of one kind.

    Matches are placed in runs of RUN and the runs one after the other, and only
    confirmed ones are gathered, so that a text of very many takes linear time.
    """
    spans = "array<struct<start:int,rank:int,end:int,score:double,kind:string>>"
    near = f"(?i)(?:{kind.near})"

    def scored(x: Column, start: Column) -> Column:
        bonus = F.when(x["left"].rlike(near) | x["right"].rlike(near), F.lit(NEAR_BONUS)).otherwise(F.lit(0.0))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["m"])).alias("end"), (F.lit(kind.prior) + bonus).alias("score"), F.lit(kind.name).alias("kind"))

    def kept(x: Column) -> Column:
        sure = _confirmed(kind.name, x)
        return sure if kind.base else sure & (scored(x, F.lit(0))["score"] >= KEEP)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["skip"]
        return F.struct((start + F.length(x["m"])).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(scored(x, start)))).otherwise(acc["out"]).alias("out"))

    def joined(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda y: F.struct((y["start"] + acc["at"]).alias("start"), y["rank"].alias("rank"), (y["end"] + acc["at"]).alias("end"), y["score"].alias("score"), y["kind"].alias("kind")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed(given: Column) -> Column:
        m, pieces = given["m"], given["p"]
        parts = F.zip_with(m, F.slice(pieces, 1, F.size(m)), lambda a, p: F.struct(a.alias("m"), F.length(p).alias("skip"), F.right(p, F.lit(NEAR_CHARS)).alias("left")))
        parts = F.zip_with(parts, F.slice(pieces, 2, F.size(m)), lambda a, p: F.struct(a["m"].alias("m"), a["skip"].alias("skip"), a["left"].alias("left"), F.left(p, F.lit(NEAR_CHARS)).alias("right")))
        return F.transform(parts, lambda x: F.struct(x["m"].alias("m"), x["skip"].alias("skip"), x["left"].alias("left"), x["right"].alias("right"), F.coalesce(kept(x), F.lit(False)).alias("ok")))

    def runs(parts: Column) -> Column:
        first = F.sequence(F.lit(1), F.size(parts), F.lit(RUN))
        one = F.transform(first, lambda i: F.aggregate(F.slice(parts, i, F.lit(RUN)), F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")), step))
        return F.flatten(F.aggregate(one, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("out")), joined, lambda acc: acc["out"]))

    # An array of one element, transformed, makes its value once for all uses.
    given = F.struct(matches.alias("m"), F.split(text, kind.pattern, -1).alias("p"))
    parts = F.transform(F.array(given), placed)
    return F.flatten(F.transform(parts, runs))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows of docs plus spans: array<struct<start,rank,end,score,kind>> by start, then kind.

    start and end count code points, end exclusive. A null text is empty; a text
    without personal data has an empty array. Rows repeat as they come; an empty
    table gives no rows. A column named spans is replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"]
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    names = _fresh(docs, *[f"_hit_{k.name}" for k in KINDS])
    hits = []
    for k, name in zip(KINDS, names):
        all_of = F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0))
        hits.append((F.when(body.contains(k.probe), all_of).otherwise(none) if k.probe else all_of).alias(name))
    raw = docs.select(*kept, *hits)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,score:double,kind:string>>")
    found = [F.when(F.size(n) > 0, _found(body, k, i, F.col(n))).otherwise(empty) for i, (k, n) in enumerate(zip(KINDS, names))]
    return raw.select(*kept, F.array_sort(F.concat(*found)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5(docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"].isin([k.name for k in KINDS if k.base]))
    names = F.transform(spans, lambda x: x["kind"])
    every = F.size(spans).cast("long").alias("n_all")
    counts = [(F.size(spans) - F.size(F.array_remove(names, k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    scores = F.array_join(F.transform(spans, lambda x: F.format_number(x["score"], 1)), ",")
    return find(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"), scores.alias("scores"), every)


def _sql() -> str:
    checks = {
        "email": "true",
        "ip": f"regexp_matches(x.m, '{OCTETS}')",
        "card": "case when length(regexp_replace(x.m, '[ -]', '', 'g')) between 12 and 19 then list_sum(list_transform(range(1, length(regexp_replace(x.m, '[ -]', '', 'g')) + 1), lambda i: case when i % 2 = 0 then case when cast(reverse(regexp_replace(x.m, '[ -]', '', 'g'))[i] as int) > 4 then cast(reverse(regexp_replace(x.m, '[ -]', '', 'g'))[i] as int) * 2 - 9 else cast(reverse(regexp_replace(x.m, '[ -]', '', 'g'))[i] as int) * 2 end else cast(reverse(regexp_replace(x.m, '[ -]', '', 'g'))[i] as int) end)) % 10 = 0 else false end",
        "phone": "length(regexp_replace(x.m, '[^0-9]', '', 'g')) between 9 and 15",
        "iban": "not regexp_matches(right(x.l, 1), '[A-Za-z0-9]') and not regexp_matches(left(x.r, 1), '[A-Za-z0-9]') and list_reduce(list_transform(string_split(replace(x.m, ' ', '')[5:] || replace(x.m, ' ', '')[:4], ''), lambda c: case when ascii(c) >= 65 then ascii(c) - 55 else ascii(c) - 48 end), lambda a, b: case when b >= 10 then (a * 100 + b) % 97 else (a * 10 + b) % 97 end, 0) = 1",
        "ssn": "not regexp_matches(right(x.l, 1), '[A-Za-z0-9]') and not regexp_matches(left(x.r, 1), '[A-Za-z0-9]')",
        "birth": "not regexp_matches(right(x.l, 1), '[A-Za-z0-9]') and not regexp_matches(left(x.r, 1), '[A-Za-z0-9]')",
        "secret": "regexp_matches(x.m, '^([^0-9]*[0-9]){4}') and regexp_matches(x.m, '^([^A-Za-z]*[A-Za-z]){4}')",
        "tel": "not regexp_matches(right(x.l, 1), '[A-Za-z0-9]') and not regexp_matches(left(x.r, 1), '[A-Za-z0-9]') and right(x.l, 1) not in ('+', '-', '.', ')')",
    }
    parts = []
    for i, k in enumerate(KINDS):
        score = f"{k.prior}::double + case when regexp_matches(right(x.l, {NEAR_CHARS}), '(?i)(?:{k.near})') or regexp_matches(left(x.r, {NEAR_CHARS}), '(?i)(?:{k.near})') then {NEAR_BONUS}::double else 0.0::double end"
        keep = "true" if k.base else f"{score} >= {KEEP}"
        parts.append(f"""select doc_id, {i} as k, '{k.name}' as kind, x.s as s, x.s + length(x.m) as e, {score} as score, {str(k.base).lower()} as base
from (select doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'m': m[i], 'l': p[i], 'r': p[i + 1],
  's': coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) + list_sum(list_transform(p[1:i], lambda y: length(y)))}})) as x
  from (select doc_id, regexp_extract_all(t, '{k.plain}') as m, string_split_regex(t, '{k.plain}') as p from d)) where {checks[k.name]} and {keep}""")
    joined = " union all ".join(parts)
    listed = "coalesce(string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s, k, e){}, '')"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
f as ({joined}),
g as (select doc_id, {', '.join(f"count(*) filter (kind = '{k.name}') as n_{k.name}" for k in KINDS if k.base)},
  {listed.format(' filter (base)')} as base, {listed.format('')} as spans, count(*) as n_all, string_agg(printf('%.1f', score), ',' order by s, k, e) as scores from f group by doc_id)
select d.doc_id, {', '.join(f"coalesce(n_{k.name}, 0) as n_{k.name}" for k in KINDS if k.base)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores, coalesce(n_all, 0) as n_all from d left join g using (doc_id)"""


OP5_SQL = _sql()
