"""Media columns by content-defined chunking.

A media file (8-bit mono PCM in a WAV container) is cut where a rolling gear hash
of the last 32 bytes has its top bits clear. Each distinct file becomes a pack: its ordered chunk digests, and
the bodies of those chunks that it owns. A chunk that many files hold is owned by
one of them, which joins on the digest settle. Reading a file back borrows the
other bodies by their digests and checks the whole against its own digest, so of
all bytes only repeated chunks move a second time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import release, written

from .components import hubs, salted
from .words import slices

#: Chunk sizes in bytes: least, most; the mean beyond the least is 2 ** MASK_BITS.
LEAST, MOST, MASK_BITS = 512, 16_384, 12
BLOCK, RATE_HZ, LEVEL = 64, 8_000, 12
#: Files that borrow a chunk from one task, about.
BORROWERS = 1_000
#: The compression dictionary: bytes, and the files and bytes of each that it is trained on at most.
DICTIONARY, SAMPLE_FILES, SAMPLE_BYTES = 65_536, 600, 4_096
_GEAR = np.random.Generator(np.random.PCG64(64)).integers(0, 2**32, 256, dtype=np.uint32)


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of BLOCK."""
    size = max(BLOCK, -(-len(text) // BLOCK) * BLOCK)
    return text + bytes(size - len(text))


def wav(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE_HZ, RATE_HZ, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    """The payload of wav()."""
    head = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if head[0] != b"RIFF" or head[11] != b"data" or head[10] != 8 or head[12] != len(media) - 44:
        raise ValueError("not an 8-bit PCM file of its stated size")
    return media[44:]


def cuts(files: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each file."""
    raw = np.frombuffer(b"".join(files), np.uint8)
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k)) if len(h) > k else h[k:]
    spots = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, base, i = [], 0, 0
    spots = spots.tolist()
    for f in files:
        ends, last, size = [], 0, len(f)
        while last < size:
            while i < len(spots) and spots[i] - base < last + LEAST:
                i += 1
            end = spots[i] - base if i < len(spots) else size
            last = min(end, last + MOST, size)
            ends.append(last)
        while i < len(spots) and spots[i] - base <= size:
            i += 1
        base += size
        out.append(ends)
    return out


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def feature(payload: bytes) -> str:
    """Mean, deviation, rate of turns about the mean, and shares of eight amplitude bands."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean()
    turns = np.count_nonzero(np.diff(x > mean)) / len(x)
    bands = np.bincount(x >> 5, minlength=8) / len(x)
    return ",".join(f"{v:.4f}" for v in (mean, x.std(), turns, *bands))


@dataclass(frozen=True)
class Media:
    """files: (key, n_bytes, media_sha) of every row.

    packs: (media_sha, digests, bodies, whole, lends) of distinct files, a table in the
    shared folder; bodies are null at places that another pack owns, whole says
    that there are none, lends lists owned places that others borrow. places: (media_sha, place, digest, own, n) of all chunks,
    n the places that hold the digest. dictionary: what bodies are compressed with,
    trained on a bounded sample; empty if there was too little to train on. rows: of files.
    """

    files: DataFrame
    packs: DataFrame
    places: DataFrame
    dictionary: bytes
    rows: int


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[bytes], list[bytes]]]:
    for b in batches:
        for first, texts in slices(b.column("text")):
            yield b, first, texts, [wav(padded(t)) for t in texts]


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, first, texts, files in _media(batches):
        sha = [hashlib.sha256(f).digest() for f in files]
        yield pa.RecordBatch.from_arrays([b.column("key").slice(first, len(texts)), pa.array(list(map(len, texts))), pa.array(sha, pa.binary())], ["key", "n_bytes", "media_sha"])


def dictionary(texts: DataFrame) -> bytes:
    """Trained on the starts of SAMPLE_FILES texts, the first of the table's partitions; the driver asks for no more."""
    some = texts.where("text is not null").select(F.substring("text", 1, SAMPLE_BYTES).alias("text")).limit(SAMPLE_FILES)
    samples = [r["text"].encode()[:SAMPLE_BYTES] for r in some.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _loaded(shared: bytes) -> dict[str, zstandard.ZstdCompressionDict]:
    return {"dict_data": zstandard.ZstdCompressionDict(shared)} if shared else {}


def _cut(with_bodies: bool, shared: bytes = b""):
    """(media_sha, digests, bodies) of the files that a task meets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        press = zstandard.ZstdCompressor(level=LEVEL, write_dict_id=False, **_loaded(shared))
        for _, _, _, files in _media(batches):
            names, lists, bodies = [], [], []
            for f, ends in zip(files, cuts(files)):
                sha = hashlib.sha256(f).digest()
                if sha not in seen:
                    seen.add(sha)
                    parts = [f[a:b] for a, b in zip([0, *ends], ends)]
                    names.append(sha)
                    lists.append(list(map(_digest, parts)))
                    bodies.append([press.compress(p) for p in parts] if with_bodies else [])
            columns = [pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary())), pa.array(bodies, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["media_sha", "digests", "bodies"])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Media:
    """The media of every text as UTF-8, padded; a null text is empty, null and repeated keys stay. Rows repeat in files as they come; equal texts are one pack; an empty table has no files and packs."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind, total = rows.schema["key"].dataType.simpleString(), rows.count()
    texts, out = rows.select("text"), "media_sha binary, digests array<binary>, bodies array<binary>"
    lists = texts.mapInArrow(_cut(False), out).groupBy("media_sha").agg(F.first("digests").alias("digests"))
    places = lists.select("media_sha", F.posexplode("digests").alias("place", "digest"))
    owners = places.groupBy("digest").agg(F.min(F.struct("media_sha", "place")).alias("owner"), F.count(F.lit(1)).alias("n"))
    own = F.struct("media_sha", "place") == F.col("owner")
    met = salted(places, owners, "digest", F.xxhash64("media_sha", "place"), hubs(owners, "digest", total))
    marked = written(met.select("media_sha", "place", "digest", own.alias("own"), "n"), "places")
    owned = marked.where("own").groupBy("media_sha").agg(F.collect_list("place").alias("owned"), F.collect_list(F.when(F.col("n") > 1, F.struct("place", "n"))).alias("lends"))
    shared = dictionary(texts)
    files = texts.mapInArrow(_cut(True, shared), out).groupBy("media_sha").agg(F.first(F.struct("digests", "bodies")).alias("p"))
    held = F.transform("p.bodies", lambda b, i: F.when(F.array_contains("owned", i), b))
    whole = F.size(F.coalesce("owned", F.array().cast("array<int>"))) == F.size("p.digests")
    packs = written(files.join(owned, "media_sha", "left").select("media_sha", F.col("p.digests").alias("digests"), held.alias("bodies"), whole.alias("whole"), F.coalesce("lends", F.array().cast("array<struct<place:int,n:bigint>>")).alias("lends")), "packs")
    release(docs.sparkSession)
    return Media(rows.mapInArrow(_files, f"key {kind}, n_bytes bigint, media_sha binary"), packs, marked, shared, total)


def store(media: Media) -> DataFrame:
    """(digest, body): every chunk once."""
    chunks = F.explode(F.arrays_zip("digests", "bodies")).alias("c")
    return media.packs.select(chunks).select(F.col("c.digests").alias("digest"), F.col("c.bodies").alias("body")).where("body is not null")


def decode(media: Media) -> DataFrame:
    """(media_sha, digests, bodies, lent): of each distinct file the owned bodies in order, null where borrowed, and the borrowed as (place, body). Whole packs are read where they lie."""
    # A chunk that very many files hold is lent in shares of BORROWERS files, so that they need not meet in one task.
    shares = lambda n: F.ceil(n / BORROWERS).cast("bigint")
    of = F.transform("lends", lambda x: F.struct(F.get("digests", x["place"]).alias("digest"), F.get("bodies", x["place"]).alias("body"), F.sequence(F.lit(0).cast("bigint"), shares(x["n"]) - 1).alias("share")))
    lent = media.packs.where(F.size("lends") > 0).select(F.inline(of)).withColumn("share", F.explode("share"))
    asked = media.places.where("not own").withColumn("share", F.pmod(F.xxhash64("media_sha"), shares(F.col("n"))))
    given = asked.join(lent, ["digest", "share"]).groupBy("media_sha").agg(F.collect_list(F.struct("place", "body")).alias("lent"))
    named = media.packs.select("media_sha", "digests", "bodies", "whole")
    none = F.lit(None).cast("array<struct<place:int,body:binary>>").alias("lent")
    parts = named.where("not whole").drop("whole").join(given, "media_sha", "left")
    return named.where("whole").drop("whole").select("*", none).unionByName(parts)


def _read(shared: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(**_loaded(shared))
        yield from (_opened(press, b) for b in batches)

    return run


def _opened(press: zstandard.ZstdDecompressor, b: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for sha, digests, own, lent in zip(*(b.column(c) for c in ("media_sha", "digests", "bodies", "lent"))):
        parts = own.as_py()
        for p in lent.as_py() or []:
            parts[p["place"]] = p["body"]
        parts = list(map(press.decompress, parts))
        media = b"".join(parts)
        if list(map(_digest, parts)) != digests.as_py() or hashlib.sha256(media).digest() != sha.as_py():
            raise ValueError("chunks do not give the stored media")
        x = samples(media)
        rows.append((sha.as_py(), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-BLOCK:]), len(media), feature(x)))
    names = ["media_sha", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def describe(media: Media) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row, from the chunks read back."""
    read = decode(media).mapInArrow(
        _read(media.dictionary), "media_sha binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, feature string"
    )
    # A text that very many rows hold meets them in shares.
    counts = media.files.groupBy("media_sha").agg(F.count(F.lit(1)).alias("n"))
    met = salted(media.files, read, "media_sha", F.monotonically_increasing_id(), hubs(counts, "media_sha", media.rows))
    return met.select(
        "key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media_sha")).alias("media_sha256"), "feature"
    )


def op2(docs: DataFrame) -> DataFrame:
    return describe(encode(docs)).withColumnRenamed("key", "doc_id")
