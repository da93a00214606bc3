"""Packing: minimum bin slack over the multiset of remaining lengths.

Documents become token ids; whole windows are cut off and what remains is
packed. The plan needs only how many pieces there are of each length (at most
one count per length up to the window). It takes the longest length left, and
a bitset subset-sum program finds the multiset of the others that fills the
window closest; backtracking gives the counts, and the pattern repeats as
often as they allow. Pieces then look up their place by length and rank, so
no task sees more than its share.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize

END_ID = 1
CAPACITY = 2048
#: Pieces that share a hashed part: whole windows of 16-bit ids are 64 MB a part.
PART_PIECES = 16_000


# fixed value: how byte-level BPE files split a text before merging
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, if the file's merges stand in the order of ids; else None."""
    import json

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or model.get("type") != "BPE" or file.get("normalizer") or model.get("ignore_merges"):
        return None
    # printable bytes stand for themselves, the others for the code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in file.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(x + y, -1) for x, y in pairs]
    return ranks if ids == sorted(ids) and (not ids or ids[0] >= 256) and len(ids) + 256 == len(ranks) else None


def packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit values."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def narrowed(ids: bytes) -> bytes:
    """32-bit ids in 16 bits each where all fit; an odd byte in front tells which form it is.

    Pieces are written and shuffled in this form.
    """
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\4" + ids


def widened(data: bytes) -> bytes:
    return data[1:] if data[0] == 4 else np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes()


class Encoder(dict):
    """Little-endian 32-bit ids of a text by a byte-level BPE file, plus the end id.

    A single space between two other characters always opens a new token, so
    texts are encoded in parts cut there; this dictionary keeps the ids of at
    most ``keep`` parts. Parts go through a merger built from the file's own
    ranks. Texts with other runs of white space, or with a special token's
    name, are encoded whole by the tokenizer itself, as is everything of a
    file whose merges are not in the order of ids.
    """

    def __init__(self, path: str, keep: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        super().__init__()
        self.keep, self.tokenizer = keep, Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if ranks := byte_ranks(path):
            import tiktoken

            self.merge = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> bytes | bool:
        """Ids of a part behind its space; False for one that cannot stand alone."""
        out = self[part] = packed(self.merge(" " + part)) if part and part == part.strip() else False
        return out

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        found = list(map(self.__getitem__, rest))
        if len(self) > self.keep:
            self.clear()
        if False in found or (first and self[first] is False) or any(x in text for x in self.special):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        head = packed(self.merge(first)) if first else b""
        return head + b"".join(found)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        end = packed([END_ID])
        return [(self.ids(t) if t else b"") + end for t in texts]


def closest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest that fits ``room``.

    Bit s of a stage's bitset says that some multiset of the lengths so far sums to s.
    """
    reach, stages = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        if not (k := min(int(counts[length]), room // length)):
            continue
        stages.append((length, k, reach))
        step = 1
        while k:
            take = min(step, k)
            reach |= reach << (length * take)
            k, step = k - take, 2 * step
        reach &= (1 << (room + 1)) - 1
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, k, before in reversed(stages):
        used = 0
        while not before >> (left - used * length) & 1:
            used += 1
        if used:
            chosen[length] = used
            left -= used * length
    return chosen


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset): which ranks of a length go where.

    From its first rank on, ``copies`` pieces of a length at a time go to one
    sequence after another, side by side from ``offset``.
    """
    counts = np.array(counts, np.int64)
    given, rows, sequence = np.zeros_like(counts), [], 0
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            chosen = closest(counts, capacity - longest)
            counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(int(counts[x]) // k for x, k in chosen.items())
            offset = 0
            for length in sorted(chosen, reverse=True):
                k = chosen[length]
                rows.append((length, int(given[length]), k, sequence, offset))
                given[length] += times * k
                counts[length] -= times * k
                offset += length * k
            sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null and empty texts are the end id alone. Repeated rows and null ids are
    documents of their own. Every id lies in one piece; pieces lie side by
    side from offset 0. ids: the piece's ids as little-endian 32-bit values,
    with ``keep_ids``. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                owner, start, length, crc, total, ids = [], [], [], [], [], []
                for k, data in enumerate(encoder(batch.column("text").to_pylist())):
                    n = len(data) // 4
                    for s in range(0, n, capacity):
                        piece = data[4 * s : 4 * (s + capacity)]
                        owner.append(k), start.append(s), length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece)), total.append(n), ids.append(narrowed(piece) if keep_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(owner, pa.int32()))]
                    + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                    + [pa.array(ids, pa.binary())],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )

    long = F.lit(0).cast("long")
    schema = rows.select(
        "id", long.alias("start"), long.alias("length"), long.alias("ids_crc32"), long.alias("doc_tokens"),
        F.lit(b"").alias("ids"),
    ).schema
    for f in schema:
        f.nullable = True
    pieces = materialize(in_arrow(rows, cut, schema))
    # ranks within a length, without a task per length: hashed parts, and counts of the parts before
    parts = max(1, pieces.count() // PART_PIECES)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counted = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    table = plan(counts, capacity)
    held = docs.sparkSession.sparkContext.broadcast(table)  # a few rows per length, whatever the data

    ranked = pieces.withColumn(
        "at", F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32", "doc_tokens")) - 1
    ).join(firsts, ["length", "part"])
    ranked = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("at")).alias("rank"), "ids")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        keys = (table[:, 0] << 45) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, (length << 45) + rank, side="right") - 1]
            ahead = rank - row[:, 1]
            columns = [batch.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")]
            columns += [pa.array(row[:, 3] + ahead // row[:, 2]), pa.array(row[:, 4] + ahead % row[:, 2] * length)]
            columns.append(pa.array([None if x is None else widened(x) for x in batch.column("ids").to_pylist()], pa.binary()))
            yield pa.RecordBatch.from_arrays(
                columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            )

    schema = ranked.select(
        "id", "start", "length", "ids_crc32", "doc_tokens", long.alias("sequence_id"), long.alias("offset"), "ids"
    ).schema
    placed = in_arrow(ranked, place, schema).withColumnRenamed("id", id_col)
    return placed if keep_ids else placed.drop("ids")
