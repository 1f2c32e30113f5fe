"""Line dedup by site-relative frequency.

A line of a host is boilerplate if the share of the host's pages that hold it
exceeds a ratio. Lines are compared by a 64-bit hash inside their host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import checkpointed

#: Shares of a host's lines that its total meets.
SALTS = 32


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that the frame does not hold yet, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """(host, line_hash, pages, host_pages) of every line above the ratio.

    Blank lines (nothing but 0x20 and 0x09 to 0x0D) never count. min_pages: a line on fewer pages
    is never boilerplate, so that a host of one page keeps its text.
    """
    rows = docs.select(host.cast("string").alias("host"), text.alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = (
        rows.where(F.col("text").isNotNull())
        .select("host", F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line_hash"))
        .groupBy("host", "line_hash")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    # A host may hold most lines: its total goes along to each of SALTS shares of them.
    right = totals.select(F.col("host").alias("_host"), "host_pages", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.col("line_hash"), F.lit(SALTS)).cast("int")
    return (
        counts.join(right, F.col("host").eqNullSafe(F.col("_host")) & (salt == F.col("_salt")))
        .where(F.col("pages") > F.lit(float(max_ratio)) * F.col("host_pages"))
        .select("host", "line_hash", "pages", "host_pages")
    )


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def _hashes(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~_blank(x))
    return F.transform(lines, lambda x: F.xxhash64(x))


def _listed(found: DataFrame, n_host: str, n_cut: str) -> DataFrame:
    """A host's boilerplate lines as one array of arrays, a line in the array that its hash tells, so that none is long."""
    most = found.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    slots = 1 << min(10, (most // 16).bit_length())
    by_slot = found.groupBy("host", F.pmod("line_hash", F.lit(slots)).alias("slot")).agg(F.collect_set("line_hash").alias("lines"))
    every = by_slot.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "lines"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint")), lambda i: F.coalesce(F.try_element_at("m", i), F.array().cast("array<bigint>")))
    return every.select(F.col("host").alias(n_host), filled.alias(n_cut))


def _is_cut(cuts: Column, line: Column) -> Column:
    h = F.xxhash64(line)
    return F.array_contains(F.get(cuts, F.pmod(h, F.size(cuts)).cast("int")), h)


def line_dedup(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    key: str = "doc_id",
    max_ratio: float = 0.1,
    min_pages: int = 3,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """All rows and columns of docs with boilerplate lines cut from the text, plus n_lines and n_dropped.

    A null text stays null with 0 lines; an empty text has one line. A null host
    is a host of its own. Rows repeat as they come; an empty table gives no rows;
    columns of any name stay, beside n_lines and n_dropped. If the boilerplate lines
    number at most broadcast_rows, they go to every task as one list for each
    host; beyond that, lines meet them in a shuffled semi-join and come back to
    their rows by key, host and a 64-bit hash of the text, each of which may be null.
    """
    found = checkpointed(boilerplate(docs, F.col(host), F.col(text), max_ratio, min_pages))
    n_host, n_key, n_text, n_cut, n_lines, n_dropped = _fresh(docs, "_host", "_key", "_text", "_cut", "n_lines", "n_dropped")
    if found.count() <= broadcast_rows:
        cuts = _listed(found, n_host, n_cut)
        joined = docs.join(F.broadcast(cuts), F.col(host).cast("string").eqNullSafe(F.col(n_host)), "left").drop(n_host)
    else:
        lines = docs.where(F.col(text).isNotNull()).select(
            F.col(key).alias(n_key), F.xxhash64(text).alias(n_text), F.col(host).cast("string").alias(n_host), F.explode(F.array_distinct(_hashes(F.col(text)))).alias("line_hash")
        )
        hit = lines.join(found.select("host", F.col("line_hash").alias("lh")), F.col(n_host).eqNullSafe(F.col("host")) & (F.col("line_hash") == F.col("lh")), "left_semi")
        cuts = hit.groupBy(n_key, n_host, n_text).agg(F.array(F.collect_set("line_hash")).alias(n_cut))
        own = F.col(key).eqNullSafe(F.col(n_key)) & F.col(host).cast("string").eqNullSafe(F.col(n_host)) & (F.xxhash64(text) == F.col(n_text))
        joined = docs.join(cuts, own, "left").drop(n_key, n_host, n_text)
    split = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col(n_cut).isNull(), split).otherwise(
        F.filter(split, lambda x: _blank(x) | ~_is_cut(F.col(n_cut), x))
    )
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long")
    m = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(kept)).cast("long")
    order = [F.array_join(kept, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*order, n.alias(n_lines), (n - m).alias(n_dropped))


def op1(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "source", "n_lines", "n_dropped", "text")


OP1_SQL = r"""
with lines as (
  select doc_id, source, l, i from (
    select doc_id, source, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
tot as (select source, count(*) as n from documents group by source),
cut as (
  select c.source, c.l from (
    select source, l, count(*) as pages from (select distinct doc_id, source, l from lines where regexp_matches(l, '[^\x20\x09-\x0D]')) group by source, l) c
  join tot t on c.source is not distinct from t.source
  where c.pages >= 3 and c.pages > cast(0.1 as double) * t.n),
marked as (
  select a.doc_id, a.l, a.i, b.l is not null as gone
  from lines a left join cut b on a.source is not distinct from b.source and a.l = b.l),
per as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
         coalesce(string_agg(l, chr(10) order by i) filter (not gone), '') as text
  from marked group by doc_id)
select d.doc_id, d.source, coalesce(p.n_lines, 0) as n_lines, coalesce(p.n_dropped, 0) as n_dropped,
       case when d.text is null then null else p.text end as text
from documents d left join per p on d.doc_id = p.doc_id
"""
