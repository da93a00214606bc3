"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Word n-grams of the test items, hashed, go into a Bloom filter of bounded
   size. One pass over the documents keeps only the positions that pass it.
2. Those join the items' n-grams exactly. Counted over all documents, a seed
   is rare if few documents hold it. An item and a document become candidates
   by one rare seed, or by a fair share of the item's n-grams, whatever their
   counts: a passage that leaked into very many documents is found as well.
   Who holds that share holds one of the item's rarest n-grams too, all but
   the commonest: only those are joined to find pairs.
3. Candidates are aligned by words around their seeds (match 2, mismatch and
   gap -1). The score is the alignment's over that of a full copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, few_or_shuffled, hot_keys, in_arrow, materialize, spread_join

PUNCTUATION = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»“”‘’–—…"
MOST_BLOOM_BITS = 29  # 2**29 bits: 64 MB


class WordHasher:
    """64-bit hashes of a text's words: lower-cased, without punctuation around them."""

    def __init__(self, keep: int = 300_000):
        self.keep, self.known = keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        chunks = text.split() if text else []
        known = self.known
        try:
            out = list(map(known.__getitem__, chunks))
        except KeyError:
            if len(known) > self.keep:
                known.clear()
            for c in chunks:
                if c not in known:
                    word = c.lower().strip(PUNCTUATION)
                    known[c] = (xxhash.xxh3_64_intdigest(word) | 1) if word else 0
            out = list(map(known.__getitem__, chunks))
        h = np.array(out, np.uint64)
        return h[h > 0]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of word hashes; a shorter text is one gram."""
    k = min(n, len(h))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - k + 1, np.uint64(k))
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word hashes: score, and the first and last word of the passage in it."""
    n = len(item)
    before, start_before = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    steps = np.arange(n + 1)
    best = (0, 0, -1)
    for j, word in enumerate(passage):
        diagonal = before[:-1] + np.where(item == word, 2, -1)
        up = before[1:] - 1
        now, start = np.zeros(n + 1, np.int64), np.full(n + 1, j + 1)
        take = np.maximum(np.maximum(diagonal, up), 0)
        now[1:] = take
        fresh = np.where(before[:-1] > 0, start_before[:-1], j)
        start[1:] = np.where(take == 0, j + 1, np.where(take == diagonal, fresh, start_before[1:]))
        # gaps along the item: the best of all cells before, less one per step
        reach = np.maximum.accumulate(now + steps)
        source = np.maximum.accumulate(np.where(now + steps == reach, steps, 0))
        gapped = reach - steps
        start = np.where(gapped > now, start[source], start)
        now = np.maximum(now, gapped)
        if (top := int(now.max())) > best[0]:
            best = (top, int(start[int(now.argmax())]), j)
        before, start_before = now, start
    return best


def _probe(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return g >> np.uint64(64 - bits), g & np.uint64((1 << bits) - 1)


def bloom(keys: DataFrame, key: str) -> tuple[np.ndarray, int]:
    """Bloom filter (16 bits a key, two probes) of 64-bit hashes, at most 2**MOST_BLOOM_BITS bits."""
    n = keys.count()
    bits = int(min(MOST_BLOOM_BITS, max(12, np.ceil(np.log2(16 * max(n, 1))))))
    k = F.col(key)
    probes = F.explode(F.array(F.shiftrightunsigned(k, 64 - bits), k.bitwiseAND(F.lit((1 << bits) - 1))))
    words = keys.select(probes.alias("p")).groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(cast(1 as bigint), cast(p & 63 as int)))").alias("b")
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    rows = words.toPandas()  # at most 2**(MOST_BLOOM_BITS - 6) rows
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return out, bits


def passes(g: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    p, q = _probe(g, bits)
    six, low = np.uint64(6), np.uint64(63)
    hit = (words[p >> six] >> (p & low)) & np.uint64(1)
    return ((words[q >> six] >> (q & low)) & hit).astype(bool)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    n: int = 3,
    rare_share: float = 1e-4,
    rare_least: int = 20,
    coverage: float = 0.25,
    least_score: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """id, item, score (0 to 1), first_word, last_word, n_seeds of each document that holds an item.

    A seed is rare if at most max(``rare_least``, ``rare_share`` of all)
    documents hold it. score: alignment over that of a whole copy; pairs from
    ``least_score`` on are returned, one row per document and item, words
    counted from 0 without bare punctuation. Null and blank texts or items
    hold nothing; null ids are passed over; rows that share an id count as one
    document and keep their best alignment. An item of fewer than ``n`` words
    is one gram of its own length, sought in the documents by that length. Other
    columns are left out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    tests = items.select(F.col(item_col).cast("long").alias("item"), F.col("text" if "text" in items.columns else text_col).alias("text")).where("item is not null and text is not null")

    def spell_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        with np.errstate(over="ignore"):
            for batch in batches:
                for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    h = hasher(text)
                    g = grams(h, n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(g), item, np.int64)),
                            pa.array(np.arange(len(g), dtype=np.int32)),
                            pa.array(g.view(np.int64)),
                            pa.array([h.tobytes()] + [None] * (len(g) - 1) if len(g) else [], pa.binary()),
                        ],
                        ["item", "at", "gram", "words"],
                    )

    spelled = materialize(in_arrow(tests, spell_items, "item long, at int, gram long, words binary"))
    words, bits = bloom(spelled.select("gram").distinct(), "gram")
    length = F.octet_length("words") / 8
    lengths = sorted(r.k for r in spelled.where("at = 0").select(F.least(length, F.lit(n)).cast("int").alias("k")).distinct().collect())  # at most n
    held = docs.sparkSession.sparkContext.broadcast((words, bits))  # of bounded size

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (words, bits) = WordHasher(), held.value
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, ats, found = [], [], []
                for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    h = hasher(text)
                    for k in lengths:
                        g = grams(h, k) if len(h) >= k else h[:0]
                        at = np.flatnonzero(passes(g, words, bits))
                        if len(at):
                            ids.append(np.full(len(at), id_, np.int64))
                            ats.append(at.astype(np.int32))
                            found.append(g[at].view(np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (ids, ats, found)], ["id", "at", "gram"]
                    )

    hits = materialize(in_arrow(texts, seek, "id long, at int, gram long"))
    n_docs = texts.count()
    seeds = spelled.select("item", F.col("at").alias("item_at"), "gram")
    met = hits.select("id", "gram").distinct()
    # documents per gram; the Bloom filter's few false grams match no seed
    df = materialize(met.groupBy("gram").agg(F.count("*").alias("df")))
    rare = F.col("df") <= max(rare_least, int(rare_share * n_docs))
    of_item = Window.partitionBy("item")
    known = (
        seeds.select("item", "gram").distinct().join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        .withColumns({"n_grams": F.count("*").over(of_item), "rank": F.row_number().over(of_item.orderBy("df", "gram"))})
        .where("df > 0").withColumn("rare", rare)
    )
    known = materialize(known)
    # one of the rarest grams but for the ``coverage`` share, or a rare one
    first = known.where(F.col("rare") | (F.col("rank") <= F.col("n_grams") - F.ceil(coverage * F.col("n_grams")) + 1))
    of_gram = first.groupBy("gram").agg(F.collect_list("item").alias("items"))
    often = df.join(of_gram.select("gram"), "gram", "left_semi")
    joined = spread_join(met, of_gram, "gram", hot_keys(often, "gram", "df"), "id").where("items is not null")
    maybe = materialize(joined.select("id", F.explode("items").alias("item")).distinct())
    per_pair = maybe.join(met, "id").join(known.select("item", "gram", "n_grams", "rare"), ["item", "gram"]).groupBy("id", "item", "n_grams").agg(
        F.count("*").alias("n_seeds"), F.count_if("rare").alias("n_rare")
    )
    fair = (F.col("n_rare") > 0) | (F.col("n_seeds") >= coverage * F.col("n_grams"))
    pairs = materialize(per_pair.where(fair).select("id", "item", "n_seeds"))
    # where in the document an item would start, by each of the pair's seeds
    starts = (
        pairs.join(hits, "id").join(seeds, ["item", "gram"])
        .groupBy("id", "item", "n_seeds").agg(F.array_sort(F.collect_set(F.col("at") - F.col("item_at"))).alias("starts"))
    )
    item_words = spelled.where("at = 0").select("item", F.col("words").alias("item_words"))
    wanted = few_or_shuffled(pairs.select("id").distinct())

    def spell_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            rows = [hasher(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], ["id", "doc_words"])

    bodies = in_arrow(texts.join(wanted, "id", "left_semi"), spell_docs, "id long, doc_words binary")

    def align_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                item = np.frombuffer(r["item_words"], np.uint64)
                doc = np.frombuffer(r["doc_words"], np.uint64)
                wide, spans = len(item) // 2 + 2, []
                for s in r["starts"]:  # windows that meet become one
                    lo, hi = max(0, s - wide), min(len(doc), s + len(item) + wide)
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(hi, spans[-1][1])
                    else:
                        spans.append([lo, hi])
                best = (0, 0, -1)
                for lo, hi in spans:
                    score, first, last = align(item, doc[lo:hi])
                    if score > best[0]:
                        best = (score, lo + first, lo + last)
                out.append((r["id"], r["item"], best[0] / (2 * len(item)), best[1], best[2], r["n_seeds"]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "item", "score", "first_word", "last_word", "n_seeds"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    scored = in_arrow(
        bodies.join(starts, "id").join(item_words, "item"),
        align_all,
        "id long, item long, score double, first_word long, last_word long, n_seeds long",
    ).where(F.col("score") >= least_score)
    best = scored.groupBy("id", "item").agg(F.max(F.struct("score", "first_word", "last_word", "n_seeds")).alias("b"))
    out = materialize(best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.*"))
    drop_table(spelled, hits, df, known, maybe, pairs)
    held.unpersist()
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    found = few_or_shuffled(find_contamination(docs, items, id_col=id_col, **options).select(id_col).distinct())
    return docs.join(found, id_col, "left_anti").select(docs.columns)
