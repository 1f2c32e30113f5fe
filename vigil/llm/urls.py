"""URL filters: rules by host and path, and a classifier of segmented names for all other urls.

Names such as cheappills are cut into words by a unigram Viterbi: each distinct
run of letters of a host or path meets the counts of words by its parts (an
equi-join), and the cheapest way through known words and unknown letters wins.
Counts come from hyphenated names of all urls and from the words of all pages.
Multinomial naive Bayes then learns from distinct pairs of host and path, of which
those with a seed word are the class to block, and adds up the log odds of a url's
words. A word counts once in a host and once in a path, however often it is
repeated there. Hosts and paths are scored once each, so a hot host is few rows until the
last join, which adaptive execution splits.

Defined results: a null url, or one without ://, has an empty host and path, no
rule and the verdict of the prior; repeated rows and null ids stay; an empty table
gives no rows. Digits of a path count as one sign. Only page_id, url and html are
read, so extra columns of any name do no harm. A run of n letters has at most
LONGEST * n parts, made by a worker piece by piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import written

from .workers import tidy

#: (host, path, verdict). They are compiled into the plan, so a list of them is short.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that mark a host or path to learn from as one to block, and how often each counts as seen.
SEEDS, SEEN = ("ads", "adult", "bets", "casino", "lottery", "pills", "poker", "porn", "spam", "viagra", "warez"), 100
#: How many words of all classes each class is smoothed with.
PULL = 10.0
#: Letters of the longest word that is counted; longer runs are still unknown words of any length.
LONGEST = 24
#: Rows that a worker hands on at once.
ROWS = 20_000
_LETTERS = r"a-z\x{80}-\x{10FFFF}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def parsed(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled): the longest rule that fits, and its verdict; null without one."""
    part = lambda pattern: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://" + pattern, 1), F.lit(""))
    rows = pages.select("page_id", lowered(part("([^/?#]*)")).alias("host"), part("[^/?#]*([^?#]*)").alias("path"))
    host, fits = F.concat(F.lit("."), F.col("host")), []
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits.append(F.when(F.endswith(host, F.lit(f".{h}")) & F.startswith("path", F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("ruled"))))
    none = F.lit(None).cast("struct<rule:string,ruled:string>")
    return rows.withColumn("_r", F.coalesce(*fits, none)).select("page_id", "host", "path", "_r.rule", "_r.ruled")


def _runs(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"[{_LETTERS}]+"), F.lit(0))


def counted(items: DataFrame, pages: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(word, n): words of names that are parted by other signs than dots and slashes, whole words of pages (html), and seeds."""
    names = items.select(F.explode(F.split("value", "[./]")).alias("p")).select(_runs(F.col("p")).alias("r")).where(F.size("r") > 1).select(F.explode("r").alias("word"))
    rows = [names.where(F.length("word") <= LONGEST)]
    if "html" in pages.columns:
        own = f"^[^{_LETTERS}]*+([{_LETTERS}]{{1,{LONGEST}}}+)[^{_LETTERS}]*+$"
        rows.append(pages.select(F.explode(F.split("html", r"[\x20\x09-\x0D]+")).alias("w")).select(F.regexp_extract(lowered(F.col("w")), own, 1).alias("word")).where("word != ''"))
    found = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    made = pages.sparkSession.createDataFrame([(s, SEEN) for s in seeds], "word string, n bigint")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).unionByName(made).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(run: str, known: dict[int, list[tuple[int, float]]], total: float) -> list[str]:
    """The cheapest words of a run. known: by end, (length, cost) of parts that are words; other letters are unknown words, dearer with each letter. Of ties the longer last word wins, known before unknown."""
    n, opened = len(run), math.log10(total) - 1
    best, last = [0.0] * (n + 1), [0] * (n + 1)
    open_cost, open_at = math.inf, 0
    for end in range(1, n + 1):
        if best[end - 1] + opened < open_cost:
            open_cost, open_at = best[end - 1] + opened, end - 1
        open_cost += 1
        cost, begin = math.inf, 0
        for length, c in sorted(known.get(end, ()), reverse=True):
            if best[end - length] + c < cost:
                cost, begin = best[end - length] + c, end - length
        if open_cost < cost:
            cost, begin = open_cost, open_at
        best[end], last[end] = cost, begin
    words = []
    while n:
        words.append(run[last[n] : n])
        n = last[n]
    return words[::-1]


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct runs. Parts travel with a digest of their run, not with the run."""
    total = float(max(counts.agg(F.sum("n")).first()[0] or 0, 10))
    keyed = runs.select("run", F.unhex(F.md5("run")).alias("id"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends, words = [], [], []
        names = ["id", "end", "word"]
        for b in batches:
            for run, key in zip(b.column("run").to_pylist(), b.column("id").to_pylist(), strict=True):
                for begin in range(len(run)):
                    for end in range(begin + 1, min(begin + LONGEST, len(run)) + 1):
                        ids.append(key)
                        ends.append(end)
                        words.append(run[begin:end])
                    if len(ids) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ends, pa.int32()), pa.array(words)], names)
                        ids, ends, words = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ends, pa.int32()), pa.array(words)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for run, edges in zip(b.column("run").to_pylist(), b.column("edges").to_pylist(), strict=True):
                known: dict[int, list[tuple[int, float]]] = {}
                for e in edges or ():
                    known.setdefault(e["end"], []).append((e["length"], math.log10(total / e["n"])))
                made.append(viterbi(run, known, total))
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(made, pa.list_(pa.string()))], ["run", "words"])

    found = keyed.mapInArrow(lambda b: tidy(parts(b)), "id binary, end int, word string").join(counts, "word")
    edges = found.groupBy("id").agg(F.collect_list(F.struct("end", F.length("word").alias("length"), "n")).alias("edges"))
    return keyed.join(edges, "id", "left").select("run", "edges").mapInArrow(lambda b: tidy(cut(b)), "run string, words array<string>")


def odds(pairs: DataFrame, named: DataFrame) -> tuple[DataFrame, float]:
    """((word, odds), prior) of pairs (host, path) and named (kind, value, words, marked): log odds of a word in pairs to block against others.

    A pair is one to block if its host or path is marked. Counts of a class are
    smoothed towards the word's share of all words, with the weight of PULL words,
    so that a rare word of one class says nothing for the other.
    """
    for kind in ("host", "path"):
        marks = named.where((F.col("kind") == kind) & F.col("marked")).select(F.col("value").alias(kind), F.lit(True).alias(f"_{kind}"))
        pairs = pairs.join(marks, kind, "left")
    bad = F.col("_host").isNotNull() | F.col("_path").isNotNull()
    pairs = written(pairs.select("host", "path", bad.alias("bad")), "pairs")
    counts = [pairs.groupBy(F.lit(k).alias("kind"), F.col(k).alias("value")).agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")) for k in ("host", "path")]
    words = named.join(counts[0].unionByName(counts[1]), ["kind", "value"]).select(F.explode("words").alias("word"), "bad", "good")
    by = written(words.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "words")
    b, g = (float(x) for x in by.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first())
    n = pairs.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    share = PULL * (F.col("bad") + F.col("good")) / F.lit(b + g)
    told = F.log((F.col("bad") + share) / F.lit(b + PULL)) - F.log((F.col("good") + share) / F.lit(g + PULL))
    return by.select("word", told.alias("odds")), math.log((n[0] + 1) / (n[1] + 1))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of pages (page_id, url, and html where there is one): the rule's verdict, else block where the log odds are above 0."""
    rows = parsed(pages, rules).withColumn("_path", F.regexp_replace(lowered(F.col("path")), "[0-9]+", "#"))
    pairs = written(rows.select("host", F.col("_path").alias("path")).distinct(), "names")
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("host", "path")])
    items = pairs.select(F.inline(both)).distinct()
    counts = written(counted(items, pages, seeds), "counts")
    runs = items.select("kind", "value", F.explode(_runs(F.col("value"))).alias("run"))
    cut = segmented(runs.select("run").distinct(), counts)
    words = runs.join(cut, "run").groupBy("kind", "value").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"))
    named = written(words.withColumn("marked", F.arrays_overlap("words", F.array(*map(F.lit, seeds)))), "segmented")
    told, prior = odds(pairs, named)
    scores = named.select("kind", "value", F.explode("words").alias("word")).join(told, "word").groupBy("kind", "value").agg(F.sum("odds").alias("score"))
    for kind, c in (("host", "host"), ("path", "_path")):
        rows = rows.join(scores.where(F.col("kind") == kind).select(F.col("value").alias(c), F.col("score").alias(f"_{kind}_score")), c, "left")
    score = F.lit(prior) + F.coalesce("_host_score", F.lit(0.0)) + F.coalesce("_path_score", F.lit(0.0))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def op12(pages: DataFrame) -> DataFrame:
    return judge(pages)
