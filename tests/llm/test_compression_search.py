"""Vector codes, ranked search and suffix dedup against brute force and on edge cases."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rigspan.llm import lexical, queries, suffixes, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, rank string, k string, digest string"
EDGE = [
    (1, None, 1.0, "x", "y", "z"),
    (2, "", 1.0, "x", "y", "z"),
    (3, " \n\t ", 1.0, "x", "y", "z"),
    (4, "one", 1.0, "x", "y", "z"),
    (5, "lorem ipsum dolor " * 3000, 1.0, "x", "y", "z"),
    (6, "same row", 1.0, "x", "y", "z"),
    (6, "same row", 1.0, "x", "y", "z"),
    (None, "no id at all", 1.0, "x", "y", "z"),
    (8, "日本語 ünï 😀 \u0000   x" + "y" * 5000, None, None, None, None),
]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


# --- vector codes ----------------------------------------------------------


def test_equal_average_search_is_exact_and_breaks_ties_low():
    rng = np.random.default_rng(3)
    for spread in (2, 5, 4000):
        for entries in (1, 2, 16):
            book, parts = rng.integers(-spread, spread + 1, (entries, 8)), rng.integers(-spread, spread + 1, (500, 8))
            apart = ((parts[:, None] - book[None]) ** 2).sum(2)
            code, best = vectors.nearest(parts, book)
            assert (code == apart.argmin(1)).all() and (best == apart.min(1)).all()


def test_vectors_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, id string, error string"
    good = [[float(x) for x in range(k, k + 8)] for k in range(5)]
    rows = [(k, v, k % 2 or None, "c", "i", "e") for k, v in enumerate(good)]
    rows += [(7, None, 1, "c", "i", "e"), (8, [*good[0][:7], None], 1, None, None, None), (9, [*good[0][:7], math.nan], 1, None, None, None), (10, [*good[0][:7], math.inf], 1, None, None, None)]
    rows += [(11, [1.0] * 4, 1, None, None, None), (1, good[1], 1, None, None, None), (None, good[2], None, None, None, None)]
    out, books = vectors.compress(spark.createDataFrame(rows, schema), parts=4, entries=3, rounds=2)
    got = out.collect()
    assert sorted((r.vec_id for r in got), key=str) == [0, 1, 1, 2, 3, 4, None] and books.shape == (4, 3, 2)
    by_label = collections.defaultdict(int)
    labels = {k: k % 2 or None for k in range(5)} | {None: None}
    for r in got:
        by_label[labels[r.vec_id]] += r.error
    assert all(r.label_error == by_label[labels[r.vec_id]] and len(r.code) == 8 for r in got)
    assert len({r.codebooks_sha256 for r in got}) == 1
    assert vectors.compress(spark.createDataFrame([], schema))[0].count() == 0
    with pytest.raises(ValueError, match="cannot be cut"):
        vectors.compress(spark.createDataFrame(rows, schema), parts=3)


# --- ranked search ---------------------------------------------------------


def _ranked(docs, items, top):
    find = lambda t: re.findall(lexical.TERM, (t or "").translate(UPPER))
    held = [(i, collections.Counter(find(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 50 + (50 * c.total() * n_docs) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(find(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def test_ranked_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "w" + str(int(rng.paretovariate(0.7)) % 300)
    docs = [(k, " ".join(word() for _ in range(rng.choice([0, 3, 20, 200])))) for k in range(400)]
    docs += [(k, "w1 w2 w299") for k in range(400, 500)] + [(499, "w1 w2 w299"), (None, "w1 w2 w299"), (500, None)]
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 4, 30])))) for k in range(25)] + [(3, "w1 w2"), (None, "w299"), (9, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for block in (4 << 20, 60):  # in one block of items, and in many
        got = lexical.rank(frame, asked, top=10, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, got), key=str) == _ranked(docs, items, 10)


def test_buckets_and_coordinates_prune():
    import pyarrow as pa

    lists = lambda x, kind: pa.array(x, pa.list_(kind))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([50.0, 5.0, 3.0]), lists([[0, 1], [0, 1], [1]], pa.int32()), lists([[30, 40], [3, 4], [3]], pa.int32())], ["id", "norm", "terms", "impacts"])
    chunk, terms, weights = lexical.Chunk([batch], 2), np.array([0, 1]), np.array([9, 1])
    rest = np.array([math.sqrt(82), 1.0, 0.0])
    assert not len(chunk.search(terms, weights, rest, 500, np.array([9, 1]))[0])  # shorter than sqrt(82) * 50
    docs, scores = chunk.search(terms, weights, rest, 300, np.array([9, 1]))
    assert docs.tolist() == [0] and scores.tolist() == [310]  # the others fall by their first coordinate


def test_ranked_search_edge_cases(spark, edge, none):
    items = edge.select(F.col("doc_id").alias("item_id"), "text", "rank", "score")
    got = lexical.rank(edge, items).collect()
    assert {r.item_id for r in got} == {4, 5, 6, None, 8} and sum(r.item_id == 6 for r in got) == 4
    assert lexical.rank(none, items).count() == lexical.rank(edge, items.where("false")).count() == 0


# --- suffix dedup ----------------------------------------------------------


def _removed(docs, least):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(d[p : p + least] for _, d in data for p in range(len(d) - least + 1))
    out = []
    for i, d in data:
        mark = bytearray(len(d))
        for p in range(len(d) - least + 1):
            if seen[d[p : p + least]] > 1:
                mark[p : p + least] = b"\1" * least
        runs = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.append((i, len(d), sum(mark), runs, hashlib.sha256(bytes(b for b, m in zip(d, mark, strict=True) if not m)).hexdigest()))
    return sorted(out, key=str)


def _kept(df, least):
    return sorted(map(tuple, suffixes.remove_repeats(df, least).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randint(0, 9999))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(30)[:150], text(60)

    def edited():
        words = base.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = word()
        return " ".join(words)

    kinds = [
        lambda: text(rng.randint(0, 40)), lambda: text(3) + passage[rng.randint(0, 60) : rng.randint(60, 150)] + text(4), edited, lambda: base,
        lambda: "ab" * rng.randint(0, 80) + rng.choice(["", "x", "é日本"]) + "a" * rng.randint(0, 120), lambda: passage[: rng.randint(30, 150)] + passage[rng.randint(0, 100) :],
        lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 300))), lambda: rng.choice([None, "", base[:20], base[5:70], "abc" * 60]),
    ]
    docs = [(k, rng.choice(kinds)()) for k in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert _kept(df, 40 + 57 * (seed - 1)) == _removed(docs, 40 + 57 * (seed - 1))


def test_suffix_dedup_edge_cases(spark, edge, none):
    docs = [(r[0], r[1]) for r in EDGE]
    assert _kept(edge, 32) == _removed(docs, 32)
    assert suffixes.remove_repeats(none).count() == 0
    spans = {r.doc_id: [(s["from"], s["to"]) for s in r.spans] for r in suffixes.remove_repeats(edge, 32).collect()}
    assert spans[4] == [] and spans[5] == [(0, 54000)]
    with pytest.raises(ValueError, match="32 bytes"):
        suffixes.remove_repeats(edge, 8)


def test_query_removes_what_repeats(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.QUERIES["op13_suffix_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == _removed(docs, 400)


def test_anchors_depend_on_their_window_alone():
    rng = np.random.default_rng(9)
    spelling = suffixes.Spelling(400)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8)
    last = np.full(len(data), len(data) - spelling.span, np.int32)
    whole, first = suffixes.anchors(data, last, spelling)
    part, _ = suffixes.anchors(data[70_001:90_000], np.full(19_999, 19_999 - spelling.span, np.int32), spelling)
    # the windows of the part are those of the whole between its ends, and so are their anchors
    behind = np.append(first[1:], len(data))
    inside = whole[(behind > 70_001) & (first <= 90_000 - spelling.span)]
    assert inside.tolist() == (part + 70_001).tolist() and np.diff(whole).max() <= spelling.window


def test_suffix_dedup_of_copies_in_many_shards_and_of_periods(spark):
    """Copies in other tasks, texts of more phrases than are followed, and tiles at text ends."""
    rng = random.Random(21)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    docs = [(k, base[rng.randint(0, 90) : 610 + rng.randint(0, 90)] if k % 3 else base) for k in range(30)]
    docs += [(100 + k, "xy" * rng.randint(20, 160) + str(k % 4)) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert _kept(df, 64) == _removed(docs, 64)


def test_open_neighbours_ask_once(spark):
    """Starts next to each other that share their inner phrases are one range, whatever phrases end there."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = text(3000)
    docs = [(hashlib.md5(t).digest(), t) for t in (f"{text(500)}{base}{text(500)}".encode() for _ in range(3))]
    df = spark.createDataFrame([(bytearray(d), bytearray(t)) for d, t in docs], "digest binary, text binary").repartition(3)
    spelling = suffixes.Spelling(400)
    shards, found = suffixes.repeated_intervals(df, spelling)
    segments = shards.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(suffixes._segments(spelling), suffixes.SEGMENT)
    rows = [r for r in segments.collect() if r.kind == suffixes.OPEN]
    ends = {(bytes(r.digest), r.to + 1, r.anchor, r.lo, r.hi, r.depth) for r in rows}
    assert rows and not [r for r in rows if (bytes(r.digest), r["from"], r.anchor, r.lo, r.hi, r.depth) in ends]
