"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Turns are dealt along (conversation, turn) and numbered in that order, so that
256 neighbours form a chunk and a conversation of any length is many chunks. A
chunk's turns are collected as sorted structs of a role's initial and a fault,
without texts, and folded by aggregate() over four (cost, audit) structs, one for
each state of the grammar (s?(ua)+)?. A chunk that continues a conversation is
folded from each state it may begin in; 64 such tables at a time are composed to
one until a conversation has one. Only the digest of the repaired texts is made
by a worker, which streams a conversation's sorted turns.

Defined results: turns are ordered by turn (null first), role, digest of the text
and copy; a null role or text counts as one space; conversations with a null id
are one conversation; equal rows are told apart by their place. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import written

#: Neighbouring turns that are folded as one chunk are 2 ** CHUNK; tables composed at once.
CHUNK, COMPOSED = 8, 64
#: More than any cost.
NEVER = 1 << 50
#: What an edit costs, and a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_SPACE = " \t\n\x0b\f\r"
_STRUCT = "struct<cost:bigint,audit:string>"


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with damage told by crc32 of `conv_id:turn` modulo 20: rows dropped, emptied, cut, repeated or given another role."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("_kind")).where("_kind != 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def placed(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) plus place: a number that grows along (conv_id, turn, role, digest of text), chunk by chunk in partitions. Written once, as the numbers hold for one run only."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "_digest", "_id"]
    rows = turns.withColumns({"_digest": F.unhex(F.md5("text")), "_id": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return written(dealt.drop("_id"), "turns")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role_initial, fault) of placed rows: blank, duplicate, truncated or none; the first that holds counts.

    A duplicate is a row that is not the least place of its (conversation, role,
    text). The least places come from a combining minimum and meet the rows by
    place, which is unique, so a text that is said a million times is no hot key.
    """
    seen = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), "role", F.hex("_digest"))))
    bare = F.rtrim("text", F.lit(_SPACE))
    base = rows.select("conv_id", "turn", "place", F.left("role", F.lit(1)).alias("initial"), seen.alias("_seen"), (bare == "").alias("_blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("_cut"))
    first = base.groupBy("_seen").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("_first"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_cut"), "truncated").otherwise("none")
    return base.join(first, "place", "left").select("conv_id", "turn", "place", "initial", fault.alias("fault"))


def _said(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("bigint").alias("cost"), audit.alias("audit"))


def _then(s: Column, cost: Column | int, letter: Column | str) -> Column:
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return _said(s["cost"] + cost, F.concat(s["audit"], letter))


def _once(x: Column, f) -> Column:
    """f of x, which is worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _inserted(s: Column) -> Column:
    """The four structs after an insertion, where it is cheaper: user before anything but user, assistant after user."""
    to_u = F.least(s["s2"], *[_then(s[k], INSERT, "I") for k in ("s0", "s1", "s3")])
    to_a = F.least(s["s3"], _then(s["s2"], INSERT, "I"))
    return F.struct(s["s0"].alias("s0"), s["s1"].alias("s1"), to_u.alias("s2"), to_a.alias("s3"))


def _step(s: Column, t: Column) -> Column:
    """The four structs after a turn: states are nothing yet, system, user and assistant last."""

    def taken(c: Column) -> Column:
        never = _said(F.lit(NEVER), F.lit(""))
        stays = t["fault"].isin("none", "truncated")
        cost = F.when(t["fault"] == "truncated", TRUNCATED).otherwise(0)

        def kept(s: Column, role: str) -> Column:
            same = t["initial"] == role
            return F.when(stays, _then(s, cost + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R"))).otherwise(never)

        gone = {k: _then(c[k], DELETE, "D") for k in ("s0", "s1", "s2", "s3")}
        system = F.when(stays & (t["initial"] == "s"), _then(c["s0"], cost, "K")).otherwise(never)
        return F.struct(
            gone["s0"].alias("s0"), F.least(gone["s1"], system).alias("s1"),
            F.least(gone["s2"], kept(F.least(c["s0"], c["s1"], c["s3"]), "u")).alias("s2"), F.least(gone["s3"], kept(c["s2"], "a")).alias("s3"),
        )

    return _once(_inserted(s), taken)


def _begin(state: int) -> Column:
    return F.struct(*[_said(F.lit(0 if k == state else NEVER), F.lit("")).alias(f"s{k}") for k in range(4)])


def folded(turns: Column, begins: Column) -> Column:
    """array of four arrays of four (cost, audit): what sorted turns cost from a state to a state; a null row for a state that they cannot begin in."""

    def row(state: int) -> Column:
        s = F.aggregate(turns, _begin(state), _step)
        return F.when(F.lit(True) if state == 0 else begins, _once(s, lambda x: F.array(x["s0"], x["s1"], x["s2"], x["s3"])))

    return F.array(*[row(k) for k in range(4)])


def _composed(tables: Column) -> Column:
    """One table of tables in a row."""

    def both(a: Column, b: Column) -> Column:
        def cell(row: Column, x: int) -> Column:
            through = [_said(F.get(row, F.lit(m))["cost"] + F.get(F.get(b, F.lit(m)), F.lit(x))["cost"], F.concat(F.get(row, F.lit(m))["audit"], F.get(F.get(b, F.lit(m)), F.lit(x))["audit"])) for m in range(4)]
            return F.least(*through)

        return F.transform(a, lambda row: F.when(row.isNotNull(), F.array(*[cell(row, x) for x in range(4)])))

    return F.aggregate(F.slice(tables, F.lit(2), F.size(tables)), F.get(tables, F.lit(0)), both)


def _chunks(told: DataFrame) -> DataFrame:
    """A row for each chunk of a conversation: counts, what its ends are, and its table."""
    t = F.array_sort(F.collect_list(F.struct("place", "turn", "initial", "fault")))
    chunk = told.groupBy("conv_id", F.shiftright("place", CHUNK).alias("chunk")).agg(t.alias("t"))
    n = lambda fault: F.size(F.filter("t", lambda x: x["fault"] == fault)).cast("bigint")
    begin, end = F.get("t", F.lit(0)), F.element_at("t", -1)
    pairs = F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t") - 1).alias("b"))
    fair = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    given = F.filter(F.transform("t", lambda x: x["turn"]), lambda x: x.isNotNull())
    # A conversation that begins inside a chunk begins in it.
    begins = begin["place"].bitwiseAND((1 << CHUNK) - 1) == 0
    return chunk.select(
        "conv_id", "chunk", n("blank").alias("blank"), n("duplicate").alias("duplicate"), n("truncated").alias("truncated"),
        F.size(F.filter(pairs, lambda p: ~fair(p["a"]["initial"], p["b"]["initial"]))).cast("bigint").alias("illegal"),
        F.size(F.array_distinct(given)).cast("bigint").alias("distinct"), F.array_min(given).alias("low"), F.array_max(given).alias("high"),
        begin["initial"].alias("first_initial"), end["initial"].alias("last_initial"), folded(F.col("t"), begins).alias("table"),
    )


def _whole(chunks: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, table): one row a conversation.

    A window over a conversation sees one row for 256 turns.
    """
    w = Window.partitionBy("conv_id").orderBy("chunk")
    edged = chunks.withColumns({"n": F.row_number().over(w) - 1, "_last": F.lag("last_initial").over(w), "_high": F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    edged = edged.withColumns({
        "illegal": F.col("illegal") + (F.col("_last").isNotNull() & ~F.concat("_last", "first_initial").isin("su", "ua", "au")).cast("bigint"),
        "distinct": F.col("distinct") - F.coalesce(F.col("low") == F.col("_high"), F.lit(False)).cast("bigint"),
    })
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "distinct")]
    tables = F.transform(F.array_sort(F.collect_list(F.struct("n", "table"))), lambda x: x["table"])
    rows = edged.groupBy("conv_id", F.floor(F.col("n") / COMPOSED).cast("int").alias("n")).agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), tables.alias("t"))
    rows = rows.withColumn("table", _composed(F.col("t"))).drop("t")
    most = edged.agg(F.max("n")).first()[0] or 0
    while (most := most // COMPOSED) > 0:
        rows = rows.groupBy("conv_id", F.floor(F.col("n") / COMPOSED).cast("int").alias("n")).agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "distinct")], F.min("low").alias("low"), F.max("high").alias("high"), tables.alias("t"))
        rows = rows.withColumn("table", _composed(F.col("t"))).drop("t")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("bigint")
    return rows.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "table")


def _best(table: Column) -> Column:
    """Cost and audit from nothing to nothing or to an assistant's turn."""
    row = F.get(table, F.lit(0))
    return F.least(F.get(row, F.lit(0)), F.get(row, F.lit(3)), _then(F.get(row, F.lit(2)), INSERT, "I"))


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of placed rows and edits (conv_id, audit).

    A worker streams a conversation's audit and then its turns in order; it holds
    the audit, a batch and a digest, so that a conversation's texts are never
    together. A digest is sequential by definition.
    """
    given = edits.select("conv_id", F.lit(-1).cast("bigint").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    dealt = rows.select("conv_id", "place", "role", "text").unionByName(given).repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = None, []
        for b in batches:
            for conv, place, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place == -1:
                    if now is not None:
                        made.append((now.conv, now.close()))
                    now = Repair(conv, text)
                else:
                    now.turn(role, text)
            if made:
                yield _rows(made)
                made = []
        if now is not None:
            yield _rows([(now.conv, now.close())])

    return dealt.mapInArrow(digests, f"conv_id {dict(rows.dtypes)['conv_id']}, repaired_sha256 string")


def _rows(made: list[tuple[object, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], pa.int64() if not any(isinstance(c, str) for c, _ in made) else pa.string()), pa.array([d for _, d in made], pa.string())], ["conv_id", "repaired_sha256"])


class Repair:
    """Follows an audit along a conversation's turns and digests what it leaves."""

    def __init__(self, conv: object, audit: str):
        self.conv, self.audit, self.at, self.user, self.lines, self.digest = conv, audit, 0, True, 0, hashlib.sha256()

    def _add(self, role: str, text: str) -> None:
        if self.lines:
            self.digest.update(b"\n")
        self.digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._add(self._next(), "")
            self.at += 1

    def _next(self) -> str:
        """The role that the grammar asks for."""
        self.user = not self.user
        return "assistant" if self.user else "user"

    def turn(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self._add(self._next(), text)
        elif edit == "K":
            self._add(role, text)
            if role[:1] != "s":
                self._next()

    def close(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


def repair(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Every conv_id of conversations with what is wrong with its turns (conv_id, turn, role, text), the cheapest edits and a digest of the repaired conversation.

    A conversation without turns has zeros, an empty audit and the digest of an empty text.
    """
    rows = placed(turns)
    whole = written(_whole(_chunks(faults(rows))).withColumn("_best", _best(F.col("table"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "_best.cost", "_best.audit"), "edits")
    texts = repaired(rows, whole)
    told = conversations.select("conv_id").distinct()
    for made, names in ((whole, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), (texts, ("repaired_sha256",))):
        told = told.join(made.select(F.col("conv_id").alias("_conv"), *names), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return told.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def op11(conversations: DataFrame) -> DataFrame:
    return repair(conversations, damaged(conversations))


#: For a second engine: crc32 bit by bit, the same fold as a list_reduce that carries the repaired text too.
_CRC = "list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, strlen({k})), lambda i: ascii(substr({k}, i + 1, 1))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1))))"


def _sql() -> str:
    def then(s: str, cost: str, letter: str, text: str | None = None) -> str:
        text = f"{s}.z" if text is None else f"list_append({s}.z, {text})"
        return f"{{'c': {s}.c + {cost}, 'a': {s}.a || {letter}, 'z': {text}}}"

    never = f"{{'c': {NEVER}, 'a': '', 'z': ['']}}"
    start = "{'c': 0::bigint, 'a': '', 'z': []::varchar[]}"
    cost = f"case when t.f = 3 then {TRUNCATED} else 0 end"
    keep = lambda s, role, name: f"case when t.f in (0, 3) then {then(s, f'({cost}) + case when t.i = {chr(39)}{role}{chr(39)} then 0 else {REROLE} end', f'case when t.i = {chr(39)}{role}{chr(39)} then {chr(39)}K{chr(39)} else {chr(39)}R{chr(39)} end', f'case when t.i = {chr(39)}{role}{chr(39)} then t.r else {chr(39)}{name}{chr(39)} end || {chr(39)}:{chr(39)} || t.x')} else {never} end"
    u = f"least(s2, {', '.join(then(s, str(INSERT), chr(39) + 'I' + chr(39), chr(39) + 'user:' + chr(39)) for s in ('s0', 's1', 's3'))})"
    a = f"least(s3, {then('s2', str(INSERT), chr(39) + 'I' + chr(39), chr(39) + 'assistant:' + chr(39))})"
    gone = lambda s: then(s, str(DELETE), "'D'")
    system = f"case when t.f in (0, 3) and t.i = 's' then {then('s0', f'({cost})', chr(39) + 'K' + chr(39), 't.r || ' + chr(39) + ':' + chr(39) + ' || t.x')} else {never} end"
    return f"""with recursive named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
 kinds as (select *, xor({_CRC.format(k='k')}, 4294967295) % 20 as kind from named),
 damage as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy from kinds where kind <> 0),
 ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as p, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from damage),
 marked as (select *, row_number() over (partition by conv_id, role, text order by p) as same, left(role, 1) as i, lag(left(role, 1)) over (partition by conv_id order by p) as before from ordered),
 told as (select *, case when bare = '' then 1 when same > 1 then 2 when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as f from marked),
 r as (select conv_id, 0::bigint as p, {start} as s0, {never} as s1, {never} as s2, {never} as s3 from (select distinct conv_id from told)
  union all select conv_id, p, {gone('s0')}, least({gone('s1')}, {system}), least({gone('u')}, {keep('m', 'u', 'user')}), least({gone('a')}, {keep('u', 'a', 'assistant')})
  from (select r.conv_id, r.p + 1 as p, s0, s1, {u} as u, {a} as a, least(s0, s1, {a}) as m, {{'f': t.f, 'i': t.i, 'r': t.role, 'x': t.text}} as t from r join told t on r.conv_id is not distinct from t.conv_id and t.p = r.p + 1)),
 ends as (select conv_id, arg_max(least(s0, s3, {then('s2', str(INSERT), chr(39) + 'I' + chr(39), chr(39) + 'assistant:' + chr(39))}), p) as best from r group by conv_id),
 counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (f = 1) as blank, count(*) filter (f = 2) as duplicate, count(*) filter (f = 3) as truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal from told group by conv_id),
 every as (select distinct conv_id from conversations)
 select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.z, chr(10)), '')) as repaired_sha256
 from every e left join counts c on e.conv_id is not distinct from c.conv_id left join ends b on e.conv_id is not distinct from b.conv_id"""


OP11_SQL = _sql()
