"""URL filters: parsing and rules against plain Python, segmentation against trying all cuts, scores rebuilt by hand."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vigil.llm import urls


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule(host, path):
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "https://x.example.net/en/1?a=/b", "https://example.net/EN/1", "http://notexample.net/en/", "http://www.Example.com/de/5#x", "http://xorg/fr/", "http://ORG/fr/", "a://b://c.org/fr/1", "http://é中.org/fr/ü?", "http://u:p@h.org:80/fr/\nx", "http://" + "z" * 3000 + ".com/", "http://a.com/" + "pills" * 200]
BAD = [f"http://{s}{n}.example.com/en/{i}" for i, (s, n) in enumerate((s, n) for s in ("", "www.", "m.") for n in ("cheap-pills", "casino-win", "free-bets", "spam-farm"))]
GOOD = [f"http://{s}{n}.example.com/en/{i}.html" for i, (s, n) in enumerate((s, n) for s in ("", "www.", "m.", "blog.") for n in ("garden", "rivers", "books", "maps-old", "weather", "news", "music", "stones"))]


@pytest.fixture(scope="module")
def pages(spark):
    every = URLS + BAD + GOOD + [GOOD[0]] * 3 + ["http://cheapwinfree.example.com/en/9", "http://gardenbooks.example.com/en/9"]
    html = "<p>A garden of books and music. Weather, maps! (stones)"
    return spark.createDataFrame([(i if i % 9 else None, u, None if i % 4 == 0 else html, 1, "x") for i, u in enumerate(every)], "page_id bigint, url string, html string, host int, Verdict string").cache()


def test_rules_and_verdicts(pages):
    got = urls.judge(pages)
    rows = got.collect()
    want = Counter((r.page_id, *parsed(r.url), rule(*parsed(r.url))[0]) for r in pages.collect())
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == want and got.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    for r in rows:
        fixed = rule(r.host, r.path)[1]
        assert r.verdict == (fixed or ("block" if r.score > 0 else "allow"))
    by = {r.host: r.verdict for r in rows if r.rule is None}
    assert all(by[parsed(u)[0]] == "block" for u in BAD) and all(by[parsed(u)[0]] == "allow" for u in GOOD)
    assert by["cheapwinfree.example.com"] == "block" and by["gardenbooks.example.com"] == "allow"
    assert urls.judge(pages.drop("html")).count() == len(rows) and urls.judge(pages.limit(0)).count() == 0


def test_scores(pages):
    """The odds, counted again from the words that the operator cut."""
    spark = pages.sparkSession
    rows = urls.parsed(pages).collect()
    items = {("host", r.host) for r in rows} | {("path", re.sub("[0-9]+", "#", re.sub("[A-Z]", lambda m: m[0].lower(), r.path))) for r in rows}
    runs = {x for _, v in items for x in re.findall("[a-z\x80-\U0010ffff]+", v)}
    frame = spark.createDataFrame(list(items), "kind string, value string")
    cut = {r.run: r.words for r in urls.segmented(spark.createDataFrame([(x,) for x in runs], "run string"), urls.counted(frame, pages)).collect()}
    assert set(cut) == runs and all("".join(w) == x for x, w in cut.items())
    assert cut["gardenbooks"] == ["garden", "books"] and cut["cheapwinfree"] == ["cheap", "win", "free"] and cut["pills" * 200] == ["pills"] * 200
    words = {k: sorted({w for x in re.findall("[a-z\x80-\U0010ffff]+", k[1]) for w in cut[x]}) for k in items}
    marked = {k for k, w in words.items() if set(w) & set(urls.SEEDS)}
    shape = lambda p: re.sub("[0-9]+", "#", re.sub("[A-Z]", lambda m: m[0].lower(), p))
    pairs = {(r.host, shape(r.path)) for r in rows}
    count, n = (Counter(), Counter()), [0, 0]
    for h, p in pairs:
        good = not {("host", h), ("path", p)} & marked
        n[good] += 1
        count[good].update(words[("host", h)] + words[("path", p)])
    total = [sum(c.values()) for c in count]
    share = lambda w: urls.PULL * (count[0][w] + count[1][w]) / sum(total)
    odds = {w: math.log((count[0][w] + share(w)) / (total[0] + urls.PULL)) - math.log((count[1][w] + share(w)) / (total[1] + urls.PULL)) for w in set(count[0]) | set(count[1])}
    prior = math.log((n[0] + 1) / (n[1] + 1))
    for r in urls.judge(pages).collect():
        path = re.sub("[0-9]+", "#", re.sub("[A-Z]", lambda m: m[0].lower(), r.path))
        assert r.score == pytest.approx(prior + sum(odds[w] for k in (("host", r.host), ("path", path)) for w in words[k]))


def test_viterbi():
    rng = random.Random(3)
    total = 1000.0
    for _ in range(300):
        run = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        counts = {w: rng.randint(1, 50) for w in {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(6)}}
        known = {}
        for i in range(len(run)):
            for j in range(i + 1, len(run) + 1):
                if run[i:j] in counts:
                    known.setdefault(j, []).append((j - i, math.log10(total / counts[run[i:j]])))
        cost = lambda w: min(math.log10(total / counts[w]) if w in counts else math.inf, len(w) + math.log10(total) - 1)
        best = min(sum(cost(w) for w in re.split(" ", "".join(c + (" " if m >> k & 1 else "") for k, c in enumerate(run)))) for m in range(1 << (len(run) - 1)))
        words = urls.viterbi(run, known, total)
        assert "".join(words) == run and sum(map(cost, words)) == pytest.approx(best)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(None, "http://a.com/x")] * 5, "page_id bigint, url string").withColumn("html", F.lit(None).cast("string"))
    assert urls.op12(df).distinct().count() == 1 and urls.op12(df).count() == 5
