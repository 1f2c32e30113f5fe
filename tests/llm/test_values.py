"""What operators make of null, empty, long and repeated rows, by value; base spans of personal data against plain patterns."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from vigil.llm import lines, maxent, media, mixing, pieces, pii, quality

LONG = "word " * 20_000 + "a" * 50_000
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    every = [int(c) for c in digits][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(every)) % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": True, "ip": all(int(x) <= 255 for x in found.split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base_spans(text):
    """(kind, start, end), by start and kind, of the matches of each pattern that pass their test."""
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if valid(k, m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def card(rng, n):
    digits = [rng.randrange(10) for _ in range(n - 1)]
    return "".join(map(str, digits)) + next(str(c) for c in range(10) if luhn("".join(map(str, digits)) + str(c)))


def test_base_spans(spark):
    rng = random.Random(6)
    bits = ["a.b@c.de", "x@y", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "+49 (30) 123-4567", "+1", "+12345678901234567", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "\U0001f600", " ", ".", "-", "@", "00", "mail me: ", "007", "1.256.3.4"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ","]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    texts += [f"pay {card(rng, n)} now" for n in range(10, 22)] + [None, "", "1" * 60_000, "a" * 60_000 + "@b.c", "1.1.1.1 " * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for r in pii.op5(df).collect():
        want = base_spans(texts[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in BASE)
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


ROWS = [(0, None, "s"), (1, "", "s"), (2, " \n", "s"), (3, "body one\nmenu", "s"), (4, "menu\nbody two", "s"), (5, "menu", "s"), (5, "menu", "s"), (None, "menu\n\nmenu", "s"), (6, LONG, None), (6, LONG, None)]


def test_values_of_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string").withColumns({"n_lines": F.lit("x"), "Copies": F.lit("y"), "payload_bytes": F.lit("z")}).repartition(3)
    cut = {(r.doc_id, r.text, r.n_dropped) for r in lines.op1(df).collect()}
    assert cut == {(0, None, 0), (1, "", 0), (2, " \n", 0), (3, "body one", 1), (4, "body two", 1), (5, "", 1), (None, "", 2), (6, LONG, 0)}
    sizes = {(r.doc_id, r.size, r.source_size) for r in mixing.op3(df).collect()}
    assert sizes == {(0, 0, 10), (1, 0, 10), (2, 0, 10), (3, 3, 10), (4, 3, 10), (5, 1, 10), (None, 2, 10), (6, 20_001, 40_002)}
    mixed = mixing.mix_plan(df).collect()
    assert len(mixed) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in mixed)
    for r in media.op2(df).collect():
        text = (dict((k, t) for k, t, _ in ROWS)[r.doc_id] or "").encode()
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_equal_rows_get_equal_results(spark):
    df = spark.createDataFrame([(i % 3, f"some words {i % 3} here", "en", "s", 1) for i in range(30)] + [(9, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3)], "doc_id bigint, quality int, toxic int")
    for run in (pii.op5, maxent.op10, pieces.op9, lambda d: quality.op7(d, labels)):
        rows = run(df).collect()
        plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else repr(x) for x in r)
        assert len(rows) == 31 and len(set(map(plain, rows))) == 4
