"""The pipeline's stages, each on what the one before kept."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rigspan.llm import common, neardup, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, seen = docs.columns, [docs.count()]
    bench = [r.text for r in queries.table(spark, SF, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialize(stage(spark, docs, SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        seen.append(docs.count())
        texts = [r.text for r in docs.collect()] if "text" in docs.columns else []
        if name == "near_duplicates":
            groups = neardup.near_duplicates(docs).collect()
            assert all(r.kept for r in groups)
        if name == "decontamination":
            assert not any(b in t for t in texts for b in bench)
        if name == "pii":
            assert seen[-1] == seen[-2]
            originals = {r.text for r in queries.table(spark, SF, "documents").collect()}
            found = re.compile(r"\S+@mail\d\.example\.com|\b\d{16}\b|\b(?:\d{1,3}\.){3}\d{1,3}\b")
            old = {m for t in originals for m in found.findall(t)}
            assert not old & {m for t in texts for m in found.findall(t)}
    assert seen[0] > seen[1] > seen[2] >= seen[3]
    packed = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r[1] for r in packed) <= 2048


def test_run(spark):
    """The whole run: windows are whole, and hold the ids of the documents that the stages keep."""
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(rows[0].asDict())
    lengths = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert all(lengths[r.doc_id] == r.doc_tokens for r in rows)
    assert len(lengths) < queries.table(spark, SF, "documents").count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kinds string, score double, digest string, component string"
LONG = "some words that go on and on " * 4000
EDGES = [(k, t, None, "s", 3, "k", 0.5, "d", "c") for k, t in ((1, None), (2, ""), (3, " \n "), (4, LONG), (5, "same row of words here"), (5, "same row of words here"), (None, "no id at all in this row"), (7, "password=**** 日本 \u0000 x"))]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_rows(spark, stage):
    """Nulls, empty and very long texts, repeated rows, clashing names, an empty table: columns stay, clean rows too."""
    docs = spark.createDataFrame(EDGES, SCHEMA)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    texts = sorted(str(r.text) for r in out.collect())
    want = sorted(str(r[1]) for r in EDGES)
    if stage is corpus_pipeline.drop_near_copies:
        want.remove("same row of words here")
    assert texts == want
    none = stage(spark, docs.where("false"), SF)
    assert none.columns == docs.columns and none.count() == 0


def test_packing_stage_on_odd_rows(spark):
    docs = spark.createDataFrame(EDGES, SCHEMA)
    out = corpus_pipeline.pack_windows(spark, docs, SF).collect()
    assert sum(r.start == 0 for r in out) == len(EDGES)
    assert corpus_pipeline.pack_windows(spark, docs.where("false"), SF).count() == 0


def test_packed_windows_hold_their_ids(spark):
    docs = spark.createDataFrame([(k, "one two three " * k) for k in range(900, 903)], "doc_id long, text string")
    out = corpus_pipeline.pack_windows(spark, docs, SF).collect()
    assert sum(r.length for r in out) > 2048
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in out)


def test_packing_query_reads_placed_ids(spark, monkeypatch):
    """The query's digests are those of the ids that the operator placed."""
    pack = queries.packing.pack
    nulled = lambda *a, **b: pack(*a, **b).withColumn("ids_crc32", F.lit(None).cast("long"))
    want = {(r.doc_id, r.start): r.ids_crc32 for r in queries.op8_packing(spark, SF).collect()}
    monkeypatch.setattr(queries.packing, "pack", nulled)
    got = {(r.doc_id, r.start): r.ids_crc32 for r in queries.op8_packing(spark, SF).collect()}
    assert got == want and None not in got.values()
