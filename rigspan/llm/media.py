"""Media columns: content-defined chunks, deduplicated by digest, rebuilt and verified.

A payload is cut where a rolling gear hash of its last bytes has zero low
bits, so equal passages give equal chunks wherever they stand. What is kept are
two tables in the shared folder: the chunk store, one row per digest, and the
ordered chunk list of every payload. Chunks that occur once are written by the
task that cuts them, in the order of their payload; only those that may occur
more often are shuffled, to keep one copy. A Bloom filter of bounded size tells
the tasks which these are; one that it names wrongly is just shuffled alone.

Media are read back from the two tables alone. Chunks that still lie side by
side in the store are put together where they lie and held against the list;
the others meet their lists by payload. Every chunk is checked against its
digest and every payload against its own, and only then yields features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, few_or_shuffled, hot_keys, in_arrow, materialize, spread_join
from .decontaminate import bloom, passes

LEAST, MASK_BITS, MOST = 512, 11, 8192
PAD = 64
MAGIC = b"CDC1"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes, zero-padded to a positive multiple of 64, and their count before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % PAD or (PAD if not data else 0))


def gear_table(seed: int = 23) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint32)


def gear_hashes(data: bytes, gear: np.ndarray) -> np.ndarray:
    """At every byte the sum of gear[b] << age over the last 32 bytes, by doubling the span."""
    h = gear[np.frombuffer(data, np.uint8)]
    span = 1
    while span < 32:
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint32(span)
        h, span = h + older, 2 * span
    return h


def cut(payload: bytes, gear: np.ndarray) -> list[bytes]:
    """Chunks of LEAST to MOST bytes (the last may be shorter)."""
    n = len(payload)
    if n <= LEAST:
        return [payload]
    marks = np.flatnonzero((gear_hashes(payload, gear) >> np.uint32(32 - MASK_BITS)) == 0) + 1
    chunks, at = [], 0
    while at < n:
        end = min(at + MOST, n)
        k = np.searchsorted(marks, at + LEAST)
        if k < len(marks) and marks[k] < end:
            end = int(marks[k])
        chunks.append(payload[at:end])
        at = end
    return chunks


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def squeeze(chunk: bytes) -> bytes:
    return zlib.compress(chunk, 6)


def list_mark(digests: list[bytes]) -> bytes:
    """Stands for an ordered list of digests."""
    return digest(b"".join(digests))


def stored_form(digests: list[bytes], packed: list[bytes]) -> bytes:
    """Manifest (count, then digest and packed length of each chunk) and the packed chunks."""
    head = MAGIC + struct.pack("<I", len(digests))
    return head + b"".join(d + struct.pack("<I", len(p)) for d, p in zip(digests, packed, strict=True)) + b"".join(packed)


def read_back(media: bytes) -> tuple[bytes, int]:
    """Payload and chunk count of a stored form; every chunk is checked against its digest."""
    if media[:4] != MAGIC:
        raise ValueError("not a stored media item")
    (n,) = struct.unpack_from("<I", media, 4)
    at, body, out = 8, 8 + 20 * n, []
    for _ in range(n):
        d, (size,) = media[at : at + 16], struct.unpack_from("<I", media, at + 16)
        chunk = zlib.decompress(media[body : body + size])
        if digest(chunk) != d:
            raise ValueError("a chunk does not match its digest")
        out.append(chunk)
        at, body = at + 20, body + size
    return b"".join(out), n


FEATURES = "sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_FEATURE_NAMES = [f.split()[0] for f in FEATURES.split(", ")]


def features(sha: bytes, media: bytes) -> tuple:
    """What the bytes that were read back say; raises if they are not the payload."""
    payload, chunks = read_back(media)
    read = hashlib.sha256(payload)
    if read.digest() != sha:
        raise ValueError("the payload read back is not the one stored")
    samples = np.frombuffer(payload, np.uint8)
    steps = int(np.abs(np.diff(samples.astype(np.int16))).sum())
    feature = f"chunks={chunks};mean={samples.mean():.4f};peak={int(samples.max())};variation={steps / max(1, len(samples) - 1):.4f}"
    return (sha, len(payload), read.hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature)


def _feature_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _FEATURE_NAMES)


class Stored(NamedTuple):
    """Tables in the shared folder.

    documents: id, n_bytes, sha (of the payload). lists: sha, digests (in the
    payload's order), one row per payload. store: digest, data (packed), one
    row per digest; of a chunk that occurs once also home, its payload, and
    pieces, the length of that payload's list if all its chunks occur once.
    """

    documents: DataFrame
    lists: DataFrame
    store: DataFrame


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its length, payload digest, and its chunks' digests in order."""
    gear = gear_table()
    for batch in batches:
        sizes, shas, digests = [], [], []
        for text in batch.column("text").to_pylist():
            n, payload = payload_of(text)
            sizes.append(n)
            shas.append(hashlib.sha256(payload).digest())
            digests.append([digest(c) for c in cut(payload, gear)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array(digests, pa.list_(pa.binary()))],
            ["id", "n_bytes", "sha", "digests"],
        )


def _spelled(batches: Iterator[pa.RecordBatch], held) -> Iterator[tuple[bytes, list[bytes], list[bytes], np.ndarray]]:
    gear, (words, bits) = gear_table(), held.value
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            for text in batch.slice(at, 200).column("text").to_pylist():
                _, payload = payload_of(text)
                chunks = cut(payload, gear)
                digests = [digest(c) for c in chunks]
                keys = np.array([xxhash.xxh64_intdigest(d, 42) for d in digests], np.uint64)  # as Spark's xxhash64
                yield hashlib.sha256(payload).digest(), digests, chunks, passes(keys, words, bits)


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _own(batches, held) -> Iterator[pa.RecordBatch]:
    """Chunks that occur once, packed, payload by payload; pieces is 0 where the payload has others too."""
    make = partial(_rows, names=["digest", "data", "home", "pieces"], types=[pa.binary(), pa.binary(), pa.binary(), pa.int32()])
    rows = []
    for sha, digests, chunks, shared in _spelled(batches, held):
        pieces = 0 if shared.any() else len(chunks)
        rows += [(d, squeeze(c), sha, pieces) for d, c, s in zip(digests, chunks, shared.tolist(), strict=True) if not s]
        if len(rows) >= 1000:
            yield make(rows)
            rows = []
    yield make(rows)


def _shared(batches, held) -> Iterator[pa.RecordBatch]:
    """Packed chunks that may be shared; copies within a task go out once."""
    make = partial(_rows, names=["digest", "data"], types=[pa.binary(), pa.binary()])
    rows, sent = [], set()
    for _, digests, chunks, shared in _spelled(batches, held):
        for d, c, s in zip(digests, chunks, shared.tolist(), strict=True):
            if s and d not in sent:
                sent.add(d)
                rows.append((d, squeeze(c)))
        if len(rows) >= 1000:
            yield make(rows)
            rows = []
        if len(sent) > 1_000_000:
            sent.clear()
    yield make(rows)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Stored:
    """Write every document's payload as chunks. Equal texts share their list, equal chunks their row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    zero, empty = F.lit(0).cast("long"), F.lit(b"")
    schema = rows.select("id", zero.alias("n_bytes"), empty.alias("sha"), F.array(empty).alias("digests")).schema
    for f in schema:
        f.nullable = True
    listed = materialize(in_arrow(rows, _list, schema))
    lists = materialize(listed.groupBy("sha").agg(F.first("digests").alias("digests")))
    occurs = listed.select(F.explode("digests").alias("digest")).groupBy(F.xxhash64("digest").alias("key")).agg(F.count("*").alias("n"))
    held = docs.sparkSession.sparkContext.broadcast(bloom(occurs.where("n > 1").select("key"), "key"))  # of bounded size
    texts = rows.select("text")
    own = in_arrow(texts, partial(_own, held=held), "digest binary, data binary, home binary, pieces int")
    shared = in_arrow(texts, partial(_shared, held=held), "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))
    store = materialize(own.unionByName(shared, allowMissingColumns=True))
    return Stored(listed.select("id", "n_bytes", "sha"), lists, store)


RUNS = f"mark binary, {FEATURES}"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of neighbouring chunks that are all of one payload its features and a mark of their order; of others sha alone."""
    types = [pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    make = partial(_rows, names=["mark", *_FEATURE_NAMES], types=types)
    rows, run = [], None

    def close() -> None:
        if run and len(run[2]) == run[1]:
            rows.append((list_mark(run[2]), *features(run[0], stored_form(run[2], run[3]))))
        elif run:
            rows.append((None, run[0], *[None] * (len(_FEATURE_NAMES) - 1)))

    for batch in batches:
        for d, data, home, pieces in zip(*(batch.column(c).to_pylist() for c in ("digest", "data", "home", "pieces")), strict=True):
            if run and run[0] != home:
                close()
                run = None
            run = run or (home, pieces, [], [])
            run[2].append(d), run[3].append(data)
            if len(rows) >= 500:
                yield make(rows)
                rows.clear()
    close()
    yield make(rows)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [list_mark(d) for d in batch.column("digests").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("sha"), pa.array(marks, pa.binary())], ["sha", "wanted"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = []
            for r in batch.slice(at, 500).to_pylist():
                chunks = {c["digest"]: c["data"] for c in r["chunks"]}
                if any(d not in chunks for d in r["digests"]):
                    raise ValueError("a chunk of the list is not in the store")
                rows.append(features(r["sha"], stored_form(r["digests"], [chunks[d] for d in r["digests"]])))
            yield _feature_batch(rows)


def read_media(lists: DataFrame, store: DataFrame) -> DataFrame:
    """sha and features of every list, from the chunks in the store.

    Raises if a chunk is missing or damaged, or a payload is not the one stored.
    """
    own = store.where("home is not null")
    tried = materialize(in_arrow(own.where("pieces > 0").select("digest", "data", "home", "pieces"), _runs, RUNS))
    runs, torn = tried.where("mark is not null"), tried.where("mark is null").select("sha").distinct()
    wanted = in_arrow(lists.select("sha", "digests"), _marks, "sha binary, wanted binary")
    wrong = F.raise_error(F.lit("chunks in the store differ from the list")).cast("string")
    whole = runs.join(wanted, "sha").withColumn("feature", F.when(F.col("mark") == F.col("wanted"), F.col("feature")).otherwise(wrong)).select(_FEATURE_NAMES)

    rest = materialize(lists.join(runs.select("sha"), "sha", "left_anti"))
    asked = rest.select("sha", F.explode(F.array_distinct("digests")).alias("digest"))
    often = asked.groupBy("digest").agg(F.count("*").alias("n"))
    common = store.where("home is null").select("digest", "data")
    fetched = spread_join(asked, common, "digest", hot_keys(often, "digest", "n"), "sha").where("data is not null")
    mine = lambda rows: rows.select(F.col("home").alias("sha"), "digest", "data")
    # a payload's chunks are torn where a task's share of the store ends
    parts = mine(own.where("pieces > 0")).join(few_or_shuffled(torn), "sha", "left_semi")
    chunks = parts.unionByName(mine(own.where("pieces = 0"))).unionByName(fetched.select("sha", "digest", "data"))
    both = chunks.select("sha", F.lit(None).cast("array<binary>").alias("digests"), F.struct("digest", "data").alias("c")).unionByName(
        rest.select("sha", "digests", F.lit(None).cast("struct<digest:binary,data:binary>").alias("c"))
    )
    joined = both.groupBy("sha").agg(F.first("digests", ignorenulls=True).alias("digests"), F.collect_list("c").alias("chunks"))
    known = materialize(whole.unionByName(in_arrow(joined.where("digests is not null"), _assemble, FEATURES)))
    drop_table(tried, rest)
    return known


def columns_of(stored: Stored, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes and the features of every document, from the stored tables."""
    known = read_media(stored.lists, stored.store)
    payloads = stored.documents.groupBy("sha").agg(F.count("*").alias("m"))
    # a text's features once, however many rows hold it
    documents = stored.documents.withColumn("__spread", F.xxhash64("id"))
    out = spread_join(documents, known, "sha", hot_keys(payloads, "sha", "m"), "__spread")
    return out.select(F.col("id").alias(id_col), "n_bytes", *[c for c in _FEATURE_NAMES if c != "sha"])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the features of every document's payload as read back from the stored tables.

    Equal texts share payload, chunks and values. Null text is an empty one:
    64 zero bytes. Repeated rows and null ids stay. Other columns are left out.
    Raises if a payload read back differs from the one stored. The tables stay;
    :func:`store_media` hands them out.
    """
    return columns_of(store_media(docs, id_col, text_col), id_col)
