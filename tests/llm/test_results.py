"""Results against brute force, SQL, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from vigil.llm import fingerprints, jaccard, langid, lines, maxent, media, mixing, pieces, pii, quality, registry
from vigil.llm.words import Words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in rows), key=repr)
    assert sorted(want.columns) == cols
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want.select(*cols).fetchall())


def test_line_dedup_both_ways(docs):
    small = {tuple(r) for r in lines.line_dedup(docs).collect()}
    assert {tuple(r) for r in lines.line_dedup(docs, broadcast_rows=-1).collect()} == small


def test_mix_emits_the_plan(docs):
    want = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in mixing.mix(docs).collect()) == want
    assert {r.doc_id: r.copies for r in mixing.mix_plan(docs, broadcast_rows=-1).collect() if r.copies} == want


def test_cross_parsing(docs):
    labelled = langid.sample(docs)
    model = langid.Model(tuple(labelled))
    symbols = [model.symbols(langid._points(r.text)) for r in docs.limit(20).collect()]
    got = model.phrases(symbols)
    for i, (_, sample) in enumerate(labelled):
        known = "".join(chr(s + 40) for s in model.symbols(langid._points(sample)))
        for j, s in enumerate(symbols):
            text, n, held = "".join(chr(x + 40) for x in s), int(len(s) > 0), ""
            for c in text:
                if held + c in known:
                    held += c
                else:
                    n, held = n + 1, c if c in known else ""
            assert got[i, j] == n


def test_language_accuracy(docs):
    want = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.op4(docs).collect() if r.held_out]
    assert sum(r.lang_pred == want[r.doc_id] for r in got) >= 0.95 * len(got)


def test_pii_positions(docs, texts):
    got = {r.doc_id: r.spans for r in pii.op5(docs).collect()}
    for i, t in texts.items():
        mails = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert [s for s in got[i].split(",") if s.startswith("email")] == mails


def test_pii_cases(spark):
    cases = ["a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111 1111 1111, 4111 1111 1111 1112", "+1 (988) 555-2485 ok", "iban DE89 3704 0044 0532 0130 00.", "call 555-123-4567 now", "id 555-123-4567", "a" * 100_000 + "@", "1" * 100_000]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.op5(df).collect()}
    assert got[0].spans == "email:0:5,email:5:11,ip:16:23,ip:24:31" and got[1].n_card == 1 and got[2].n_phone == 1
    assert got[3].spans == "iban:5:32" and got[4].spans == "tel:5:17" and got[5].spans == got[6].spans == got[7].spans == ""


def components(sets, percent):
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(t, k):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k,percent,scheme", [(3, 90, "parts"), (5, 80, "prefix"), (3, 80, "parts")])
@pytest.mark.parametrize("block", [300, 400_000])
def test_jaccard(spark, k, percent, scheme, block):
    random.seed(k * percent)
    words = [f"w{i}" for i in range(300)]
    made = {}
    for g in range(12):
        base = [random.choice(words) for _ in range(random.choice([2, 6, 12, 40, 90]))]
        for _ in range(8):
            edit = list(base)
            for _ in range(random.randint(0, 3)):
                edit[random.randrange(len(edit))] = random.choice(words)
            made[len(made)] = " ".join(edit)
    made |= {1000: "", 1001: None, 1002: "  "}
    df = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    got = {r.id: (r.n_shingles, r.component) for r in jaccard.join(df, k, percent, block, scheme).collect()}
    sets = {i: shingles(t, k) for i, t in made.items()}
    assert got == {i: (len(sets[i]), c) for i, c in components(sets, percent).items()}


def test_link_with_many_groups(monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SETS", 1)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(60)] + [np.unique(np.append(np.arange(40), rng.integers(40, 45, 2)).astype(np.uint64)) for _ in range(10)]
    got = jaccard.link(sets, 80)
    want = components({i: set(s.tolist()) for i, s in enumerate(sets)}, 80)
    assert len({(g, want[i]) for i, g in enumerate(got)}) == len(set(want.values())) == len(set(got.tolist()))


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in registry.queries()["op7_quality"](spark, sf).collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in got) >= 0.95 * len(got)


def test_fingerprints(docs, texts):
    order = sorted(texts, reverse=True)
    nxt = dict(zip(order, order[1:] + order[:1]))
    cut = lambda t: set(tuple(WORD.findall(t)[i : i + 5]) for i in range(max(1, len(WORD.findall(t)) - 4))) if WORD.search(t) else set()
    errors = []
    for r in fingerprints.op8(docs).collect():
        t, n = texts[r.doc_id], len(texts[r.doc_id]) // 3
        edited = t[: len(t) - n] + texts[nxt[r.doc_id]][:n]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = cut(t), cut(edited)
        errors.append(abs(len(a & b) / max(1, len(a | b)) - r.near_edited))
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.3


def test_pieces_equal_the_library(texts):
    import sentencepiece

    enc, lib = pieces.Encoder(pieces.load(pieces.default_path())), sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    random.seed(3)
    odd = ["", " ", "   hi  there\n\n x", " " * 40 + "a" + " " * 17, "é中😀\tx\0y", "▁a ▁", "a" * 3000, "\r\n \r\n", "mississippi", "￾\0"]
    odd += ["".join(random.choice("abcdeéß .,\n\t  中▁0123Thein") for _ in range(random.randint(1, 80))) for _ in range(200)]
    every = list(texts.values()) + odd
    ids, ends = enc.encode(every)
    for i, t in enumerate(every):
        assert ids[ends[i] : ends[i + 1]].tolist() == lib.encode(t), t[:50]


@pytest.mark.parametrize("distinct,size", [(3000, 60_000), (60_000, 200_000), (200, 2_200_000)])
def test_pieces_of_many_characters(distinct, size):
    """More distinct keys than packed ranks of 63 bits take."""
    import sentencepiece

    enc, lib = pieces.Encoder(pieces.load(pieces.default_path())), sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    rng = np.random.default_rng(5)
    some = [0x20] * 8 + list(range(0x61, 0x7B)) + list(range(0xA1, 0x250)) + list(range(0x3041, 0x3097)) + list(range(0x4E00, 0xD7A4)) + list(range(0x20000, 0x2A6D7))
    points = np.array(some, np.uint32)[rng.integers(0, distinct, size)]
    text = points.tobytes().decode("utf-32-le")
    words = [w for w, k in enc.ids.items() if len(w) > 8]
    text += "".join(w.replace(pieces.MARK, " ") for w in rng.choice(words, 2000))
    ids, ends = enc.encode([text])
    assert ids.tolist() == lib.encode(text) and ends.tolist() == [0, len(ids)]


def test_pieces_of_a_long_unit_without_spaces():
    """200,000 characters without a space are cut where no piece holds two neighbours, and give the library's pieces."""
    import time

    import sentencepiece

    enc, lib = pieces.Encoder(pieces.load(pieces.default_path())), sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    rng = random.Random(4)
    text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200_000))
    began = time.time()
    ids, ends = enc.encode([text])
    assert time.time() - began < 5 and ids.tolist() == lib.encode(text) and ends.tolist() == [0, len(ids)]
    for _ in range(400):
        text = "".join(rng.choice(["中文", "文", "字", "a", "the", " ", "  ", "é", "\U0001f600", "\n", "ing"]) for _ in range(rng.randint(0, 12)))
        assert enc.encode([text])[0].tolist() == lib.encode(text)


def test_pieces_of_units_read_before(texts, monkeypatch):
    """Units of earlier texts are not indexed again; forgetting and equal hashes change no piece."""
    import sentencepiece

    lib, every = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path()), list(texts.values())
    enc = pieces.Encoder(pieces.load(pieces.default_path()))
    indexed, read = [], enc.read
    monkeypatch.setattr(enc, "read", lambda points, begin, sizes: indexed.append(int(sizes.sum())) or read(points, begin, sizes))
    enc.encode(every)
    first = sum(indexed)
    ids, ends = enc.encode(every[::-1])
    assert sum(indexed) - first < first / 50
    assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(every))][::-1] == [lib.encode(t) for t in every]

    def rough(self, points, begin, count, distinct=pieces.Encoder.distinct):
        which, first, h = distinct(self, points, begin, count)
        return which, first, h % np.uint64(7)

    monkeypatch.setattr(pieces, "_UNITS", 200)
    monkeypatch.setattr(pieces, "_CHARS", 1000)
    for coarse in (False, True):
        if coarse:
            monkeypatch.setattr(pieces.Encoder, "distinct", rough)
        enc = pieces.Encoder(pieces.load(pieces.default_path()))
        for t in [*every[:40], "", "\ue000 \U0010fffd \ue000", " ", *[t[:90] for t in every[:40]], *every[:40]]:
            assert enc.encode([t])[0].tolist() == lib.encode(t)


def test_pieces_round_trip(docs):
    rows = pieces.tokenize(docs.select("doc_id", "text"))
    assert rows.where("not exact").count() == 0
    assert pieces.detokenize(rows.withColumnRenamed("text", "was")).where("text <> was").count() == 0


def test_media(docs, texts):
    for r in media.op2(docs).collect():
        b = texts[r.doc_id].encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(p)).hexdigest()


def test_media_shares_chunks(spark):
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(90_000))
    made = {1: body, 2: body + "tail", 3: "head" + body, 4: body, 5: body[:50_000] + "x" + body[50_000:]}
    df = spark.createDataFrame(list(made.items()), "doc_id bigint, text string").repartition(3)
    kept = media.encode(df)
    assert kept.packs.count() == 4 and kept.places.where("not own").count() > 10
    chunks = media.store(kept)
    assert chunks.count() == chunks.select("digest").distinct().count() == kept.places.select("digest").distinct().count()
    assert {r.key: r.n_bytes for r in media.describe(kept).collect()} == {i: len(t) for i, t in made.items()}


def test_gear_cuts(texts):
    files = [media.wav(t.encode()) for t in texts.values()] + [bytes(40_000)]
    gear = [int(x) for x in media._GEAR]
    for f, got in zip(files, media.cuts(files)):
        want, last, h = [], 0, 0
        for i, c in enumerate(f):
            h = ((h << 1) + gear[c]) & 0xFFFFFFFF
            if i + 1 - last >= media.LEAST and h >> (32 - media.MASK_BITS) == 0 or i + 1 - last >= media.MOST:
                want.append(i + 1)
                last = i + 1
        assert got == want + [len(f)] * (last < len(f))


def test_maxent(docs, texts):
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter(w for i, t in texts.items() if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    rows = maxent.score(docs, block_bytes=50_000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_maxent_keeps_word_histories_apart(spark):
    """30,000 words, each followed by one of three classes of its own: more than rows of the weight table."""
    rng = random.Random(4)
    heads = {f"q{i}": rng.choice(["alpha", "beta", "gamma"]) for i in range(30_000)}
    text = lambda: " ".join(f"{w} {heads[w]}" for w in rng.choices(list(heads), k=2_000))
    df = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id bigint, text string").repartition(4)
    rows = maxent.score(df, block_bytes=800_000).collect()
    held = [r for r in rows if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert len(rows) == 200 and gain > 0.45, gain


def test_maxent_shares_are_told_by_all_blocks(spark, monkeypatch):
    """Every training token speaks for a share: tokens told in all blocks are those of all training documents."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(["a", "b", "cd", "efg", "hi"], k=60))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(12)
    kept, plain = [], maxent.written
    monkeypatch.setattr(maxent, "written", lambda df, name: kept.append((name, plain(df, name))) or kept[-1][1])
    rows = {r.doc_id: r for r in maxent.score(df, block_bytes=1_000).collect()}
    table = dict(kept)["kept"].select("held_out", "n_tokens", "evidence", "alone").collect()
    told = [r for r in table if r.evidence]
    assert len(told) > 8 and sum(len(r.held_out) for r in table) == len(docs) == len(rows)
    assert all(any(r.evidence) for r in told if not all(r.held_out))


def test_maxent_blocks_meet_in_shares(spark, monkeypatch):
    """Blocks meet their counts in four shares, none of them with nearly all documents, and give the scores of one meeting."""
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["a", "b", "cd", "efg", "hi"], k=60))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(12, "doc_id")
    once = sorted(maxent.score(df, block_bytes=1_000).collect())
    kept, plain = [], maxent.written
    monkeypatch.setattr(maxent, "MET_BYTES", 1_000)
    monkeypatch.setattr(maxent, "written", lambda df, name: kept.append((name, plain(df, name))) or kept[-1][1])
    shares = sorted(maxent.score(df, block_bytes=1_000).collect())
    sizes = [sum(len(r.held_out) for r in t.select("held_out").collect()) for name, t in kept if name == "kept"]
    assert len(sizes) == 4 and sum(sizes) == len(docs) and max(sizes) < len(docs) / 2
    assert [r[:5] for r in shares] == [r[:5] for r in once]
    assert np.allclose([r[5:] for r in shares], [r[5:] for r in once], rtol=1e-6)


def test_maxent_sums_by_group():
    """Small and large groups have the sums that a reduction gives, to the last bit."""
    rng = np.random.default_rng(2)
    for groups in (1, 40, 3_000):
        g, rows = rng.normal(size=(2_000, 16)).astype(np.float32), np.sort((rng.random(8_000) ** 3 * groups).astype(np.int64))
        first, order = np.flatnonzero(np.diff(rows, prepend=-1)), rng.permutation(8_000) % 2_000
        got = maxent._grouped(g, order, first, np.diff(np.append(first, len(rows))))
        assert np.array_equal(got, np.add.reduceat(g.take(order, 0), first, axis=0))


def test_maxent_evidence_by_ratio():
    """Counting tokens by ratio gives the shares that the log probabilities of all tokens give."""
    rng = np.random.default_rng(3)
    p = rng.uniform(1e-6, 0.3, 20_000)
    rates = [(np.where(rng.random(len(p)) < 0.4, rng.uniform(0, 1, len(p)), 0), rng.integers(0, 9, len(p))) for _ in range(2)]
    got, q = maxent.evidence(p, rates), p
    for found, (rate, size) in zip(got, rates):
        want = np.stack([np.bincount(size, np.log(q + x * (rate - q)) - np.log(q), maxent.SIZES) for x in maxent.SHARES], axis=1)
        assert np.abs(found - want).max() < 0.01 * np.abs(want).max() and (maxent._best(found) == maxent._best(want)).all()
        q = q + maxent.SHARES[maxent._best(want)][size] * (rate - q)


def test_words():
    odd = ["", " a  b\x0bc\n", "Ab é x", "one"]
    w = Words([t.encode() for t in odd])
    by = {}
    for i, t in enumerate(odd):
        found = WORD.findall(lower(t))
        assert len(w.text(i)) == len(found)
        for h, x in zip(w.text(i).tolist(), found):
            assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_language_choice_and_score(monkeypatch):
    """The least phrases times bits over length wins, of equals the first by name; texts of all lengths are read whole, alone or side by side."""
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(4))
    samples = tuple((lang, " ".join(word(letters) for _ in range(150))) for lang, letters in (("aa", "abcd"), ("bb", "cdef"), ("cc", "cdef"), ("dd", "fghi")))
    samples = (*samples[:2], ("cc", samples[1][1]), samples[3])
    texts = ["", "123", "abca bcab", "fedc cdef", *[" ".join(word("abcdefghi") for _ in range(n)) for n in (1, 3, 40, 700, 4000)]]
    found = []
    for alone in (0, 2, 100):
        monkeypatch.setattr(langid, "ALONE", alone)
        model = langid.Model(samples)
        found.append(model.predict(texts))
    assert found[0] == found[1] == found[2]
    model = langid.Model(samples)
    for t, lang, score in zip(texts, *found[0]):
        s = model.symbols(langid._points(t))
        if not (s != langid.SPACE).any():
            assert (lang, score) == (langid.UND, 0.0)
            continue
        cost = []
        for _, sample in samples:
            known, n, held = "".join(chr(x + 40) for x in model.symbols(langid._points(sample))), 1, ""
            for c in (chr(x + 40) for x in s):
                if held + c in known:
                    held += c
                else:
                    n, held = n + 1, c if c in known else ""
            cost.append(n * math.log2(len(known)) / len(s))
        best = min(cost)
        assert lang == ("aa", "bb", "cc", "dd")[cost.index(best)]
        assert math.isclose(score, 1 / sum(2 ** -((c - best) * min(len(s), langid.WEIGHED)) for c in cost), rel_tol=1e-9)
    assert found[0][0][3] == "bb"


def test_hundred_languages(spark):
    made = [(100 * j + i, f"w{j:02d}{chr(97 + j % 26)}{chr(97 + j // 26)} text{i}", f"l{j:03d}") for j in range(100) for i in range(20)]
    got = langid.sample(spark.createDataFrame(made, "doc_id bigint, text string, lang string"))
    assert len(got) == 100


def test_votes_are_exact_and_ties_are_firm(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    made = [(i, " ".join(rng.choices(words, k=rng.choice([3, 30]))) if i % 9 else "tie text") for i in range(400)]
    made += [(7, "zz shares an id"), (7, "aa shares an id"), (8, None)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    voters = quality.fit(docs.repartition(5), labels)
    again = quality.fit(docs.orderBy("text").repartition(3), labels)
    assert np.array_equal(voters.vectors, again.vectors) and np.array_equal(voters.labels, again.labels)
    texts = [(t or "").encode() for _, t in made]
    rows = quality.counts(texts)
    got = voters.scores(rows)
    for i, x in enumerate(voters.embed(rows)):
        if not rows[i].any():
            assert got[i] == voters.prior
            continue
        near = [round(float(x @ v), 4) for v in voters.vectors]
        top = sorted(range(len(near)), key=lambda j: (-near[j], j))[: quality.NEIGHBOURS]
        weight = [max(0.0, near[j]) ** 8 for j in top]
        want = (sum(w for w, j in zip(weight, top) if voters.labels[j]) + voters.prior * 1e-3) / (sum(weight) + 1e-3)
        assert abs(got[i] - want) < 1e-9
    for a in (1, 7, 512):
        assert np.array_equal(np.concatenate([voters.scores(rows[i : i + a]) for i in range(0, len(rows), a)]), got)


def test_fingerprint_bits(spark):
    """Every bin rebuilt by plain Python from the same hashes."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    chain = lambda xs, h=42: [h := xxhash.xxh64_intdigest(struct.pack("<q", signed(x)), seed=h) for x in xs][-1]
    rng = random.Random(1)
    texts = ["one", "two words", "", None, " ".join(f"w{rng.randrange(40)}" for _ in range(9)), " ".join(f"w{rng.randrange(400)}" for _ in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    shift = 64 - fingerprints.BIN_BITS
    for r in fingerprints.op8(df).collect():
        words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in WORD.findall(texts[r.doc_id] or "")]
        k = fingerprints.WORDS
        hashes = [chain(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        least = {}
        for h in hashes:
            least[h >> shift] = min(h, least.get(h >> shift, h))
        full = [least[b] for b in sorted(least)]
        made = [least[b] if b in least else min(full, key=lambda m: signed(chain([b, m >> shift]))) for b in range(fingerprints.BINS)] if full else []
        order = [*range(fingerprints.BINS // 2, fingerprints.BINS), *range(fingerprints.BINS // 2)]
        assert r.fingerprint == "".join(f"{made[b] & 255:02x}" for b in order) if made else r.fingerprint == ""


def test_maxent_probabilities():
    """Scores of a block by plain loops; classes, cells and words of a leaf each add up to 1."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "cat", "dog", "the", "X", "run"], n)).encode() for n in (0, 1, 2, 5, 40, 40)] + [b"cat dog"] * 2
    ids, bounds = maxent.tokens(texts)
    vocab, codes = np.unique(ids, return_inverse=True)
    held = np.array([False, True, False, True, False, False, False, True])
    k = maxent.Block(0, vocab, codes, bounds, held, None)
    class_of = rng.integers(0, maxent.CLASSES, maxent.STARTS)
    weights = rng.normal(size=(2 * maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    seqs = [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))]
    train = [s for s, h in zip(seqs, held) if not h]
    start = int(maxent._START)
    c = collections.Counter(w for s in train for w in s)
    two = collections.Counter(p for s in train for p in zip([start, *s], s))
    three = collections.Counter(p for s in train for p in zip([start, start, *s], [start, *s], s))
    leaf = {w: int(class_of[w & (maxent.STARTS - 1)]) * maxent.CELLS + ((w >> 9) & (maxent.CELLS - 1)) for w in map(int, vocab)}
    n, v = np.zeros(maxent.CLASSES * maxent.CELLS), np.zeros(maxent.CLASSES * maxent.CELLS)
    for w, x in c.items():
        n[leaf[w]] += x
        v[leaf[w]] += 1
    share = np.zeros((2, maxent.SIZES))
    share[0, 1:], share[1, 1:] = 0.3, 0.5
    followed = np.array([[two[p] for s in seqs for p in zip([start, *s], s)], [three[p] for s in seqs for p in zip([start, start, *s], [start, *s], s)]])
    got = maxent.Model(weights, class_of, n, v, share).scores(k, np.array([c[int(w)] for w in vocab]), followed, len(train))
    first, second = maxent.features(ids, bounds, class_of)
    soft = lambda rows: (lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum())(sum(weights[r].astype(np.float64) for r in rows))
    at = 0
    for d, s in enumerate(seqs):
        total, own = 0.0, int(not held[d])
        for i, w in enumerate(s):
            p_class, p_cell = soft(first[:, at]), soft(second[:, at])
            assert math.isclose(p_class.sum(), 1) and math.isclose(p_cell.sum(), 1)
            p = p_class[leaf[w] // maxent.CELLS] * p_cell[leaf[w] % maxent.CELLS] * (c[w] + 0.5) / (n[leaf[w]] + 0.5 * (v[leaf[w]] + 1))
            one, before = (s[i - 1] if i else start), (s[i - 2] if i > 1 else start)
            times = c[one] if i else len(train)
            pair_times = two[(before, one)] if i else len(train)
            for x, m, part in ((two[(one, w)], times, 0.3), (three[(before, one, w)], pair_times, 0.5)):
                m, x = max(m - own, 0), max(x - own, 0)
                if m:
                    p += part * (x / m - p)
            total += math.log10(p)
            at += 1
        assert math.isclose(got[3][d], total, rel_tol=1e-5), d


def test_link_across():
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 400, 40).astype(np.uint64)) for _ in range(12)]
    vary = lambda b: np.unique(np.append(rng.permutation(b)[: len(b) - rng.integers(0, 6)], rng.integers(0, 400, 2)).astype(np.uint64))
    left, right = [vary(base[i % 6]) for i in range(30)], [vary(base[i % 12]) for i in range(60)]
    pairs = jaccard.link_across(left, np.arange(30), right, 1000 + np.arange(60), 70)
    top = {i: i for i in [*range(30), *range(1000, 1060)]}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        assert 100 * len(np.intersect1d(left[a], right[b])) >= 70 * len(np.union1d(left[a], right[b]))
        top[max(find(a), find(1000 + b))] = min(find(a), find(1000 + b))
    for a in range(30):
        for b in range(60):
            if 100 * len(np.intersect1d(left[a], right[b])) >= 70 * len(np.union1d(left[a], right[b])):
                assert find(a) == find(1000 + b)


def test_mix_of_rows_without_ids(spark):
    """1,000 rows without an id, half of them equal, come near their target."""
    made = [(None, f"s{i % 2}", "some words here" if i % 4 < 2 else f"some words {i}") for i in range(1000)]
    plan = mixing.mix_plan(spark.createDataFrame(made, "doc_id bigint, source string, text string").repartition(4))
    for r in plan.groupBy("source").agg({"target": "max", "*": "count"}).collect():
        taken = plan.where(plan.source == r["source"]).selectExpr("sum(copies * size) as x").first().x
        assert abs(taken - r["max(target)"]) < 0.05 * r["max(target)"]


def test_very_many_numbers_in_one_text(spark):
    import time

    text = " ".join(str(10**12 + i) for i in range(200_000)) + " " + " ".join(f"a{i}@b.example" for i in range(20_000))
    df = spark.createDataFrame([(1, text), (2, "my token = '0a1b2c3d4e5f60718293a4b5c6' and 0a1b2c3d4e5f60718293a4b5c6"), (3, "x " * 40 + "0a1b2c3d4e5f60718293a4b5c6"), (4, "born 2001-02-03, due 2001-02-03 or not " + "y " * 30 + "2001-02-03")], "doc_id bigint, text string")
    at = time.time()
    got = {r.doc_id: r for r in pii.op5(df).collect()}
    assert time.time() - at < 60 and got[1].n_email == 20_000
    assert got[2].spans.startswith("secret:12:38") and got[3].spans == "" and got[4].spans.startswith("birth:5:15") and got[4].n_all == 1


def test_pipeline_stages_by_hand(spark, docs, texts):
    """Every stage of the pipeline on its own input, rebuilt by plain Python."""
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline
    import sentencepiece

    stages = dict(corpus_pipeline.STAGES)
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = langid.sample(rows)
    kept = {r.doc_id: r for r in stages["language_id"](spark, rows, SF).collect()}
    langs = langid.Model(tuple(labelled)).predict([texts[i] or "" for i in texts])[0]
    assert set(kept) == {i for i, lang in zip(texts, langs) if lang != "und"}

    docs2 = spark.createDataFrame(list(kept.values()), rows.schema)
    cut = {r.doc_id: r for r in stages["line_dedup"](spark, docs2, SF).collect()}
    pages, hosts = collections.Counter(), collections.Counter()
    for r in kept.values():
        hosts[r.source] += 1
        pages.update((r.source, x) for x in set(r.text.split("\n")) if WORD.search(x))
    gone = {(h, x) for (h, x), n in pages.items() if n >= 3 and n > 0.1 * hosts[h]}
    want = {i: "\n".join(x for x in r.text.split("\n") if (r.source, x) not in gone) for i, r in kept.items()}
    assert {i: r.text for i, r in cut.items()} == want and all(r.n_chars == len(want[i]) for i, r in cut.items())

    docs3 = spark.createDataFrame(list(cut.values()), rows.schema)
    near = {r.doc_id: r for r in stages["near_duplicates"](spark, docs3, SF).collect()}
    top = components({i: shingles(t, 5) for i, t in want.items()}, 80)
    assert set(near) == {i for i, t in want.items() if top[i] == i or not shingles(t, 5)}

    docs4 = spark.createDataFrame(list(near.values()), rows.schema)
    mixed = collections.Counter(r.doc_id for r in stages["source_mixing"](spark, docs4, SF).collect())
    size = {i: len(WORD.findall(r.text)) for i, r in near.items()}
    sources = sorted({r.source for r in near.values()}, key=lambda x: (x is None, (x or "").encode()))
    have = {x: sum(size[i] for i, r in near.items() if r.source == x) for x in sources}
    weight = {x: i % 3 + 1 for i, x in enumerate(sources)}
    full: set = set()
    while True:
        rest, free = sum(have.values()) - sum(3 * have[x] for x in full), sum(weight[x] for x in sources if x not in full)
        more = {x for x in sources if x not in full and 3 * have[x] * free <= weight[x] * rest}
        if not more:
            break
        full |= more
    target = {x: 3 * have[x] if x in full else weight[x] * rest / free for x in sources}
    for i, r in near.items():
        rate = target[r.source] / have[r.source] if have[r.source] else 0
        u = int(hashlib.md5(f"mix:{i}:{hashlib.md5(r.text.encode()).hexdigest()}:0".encode()).hexdigest()[:15], 16) / 2**60
        assert mixed[i] == math.floor(rate) + (u < rate - math.floor(rate)), i

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for r in stages["sentencepiece"](spark, docs4, SF).collect():
        assert list(r.ids) == library.encode(near[r.doc_id].text), r.doc_id


def test_pipeline_of_nothing(spark, docs):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "")
        assert rows.count() == 0
