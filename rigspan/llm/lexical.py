"""Ranked lexical search: the best documents for every query text, by buckets of vector length.

A document is a vector of impacts, one for each of its terms that a query
holds; a query is a vector of term weights; the score is their product. Impact
vectors are ordered by length and dealt into buckets, longest first. A bucket
whose longest vector times the query's length stays under the query's 50th best
score so far is skipped (Cauchy-Schwarz). Inside a bucket only the query's
heaviest coordinates are added up until what is left cannot lift any document
over that score; documents whose partial score and remaining bound stay below
it fall away, and the survivors are scored again, exactly, in integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents that a task looks at together.
CHUNK = 8192


def terms_of(text: str | None) -> list[str]:
    return re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER))) if text else []


def _counted(known: dict[str, int]) -> Callable:
    """Per document: id, number of terms, and the known ones with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = Counter(terms_of(text))
                met = [(known[t], c) for t, c in words.items() if t in known]
                n.append(words.total()), terms.append([t for t, _ in met]), counts.append([c for _, c in met])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["id", "n", "terms", "counts"]
            )

    return run


def _frequencies(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(held[met])], ["term", "df"])

    return run


def _impacts(docs: int, length: int) -> Callable:
    """Impact of every kept term and the length of the vector; ``salt`` deals equal lengths apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("counts")
            many = counts.value_lengths().to_numpy().astype(np.int64)
            tf, n = counts.flatten().to_numpy().astype(np.int64), batch.column("n").to_numpy()
            m = np.repeat(100 - 50 + (50 * n * docs) // length, many)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
            norm = np.sqrt(np.add.reduceat(impact.astype(np.float64) ** 2, np.cumsum(many) - many)) if len(many) else np.zeros(0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(impact.astype(np.int32)))
            salt = pa.array(np.arange(len(many), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(norm), salt, batch.column("terms"), lists], ["id", "norm", "salt", "terms", "impacts"])

    return run


def _best(pairs: list[tuple], top: int) -> list[tuple]:
    return sorted(pairs, key=lambda p: (-p[0], p[1] is None, p[1] if p[1] is not None else 0))[:top]


class Chunk:
    """Documents of one bucket, longest vector first, with their postings by term."""

    def __init__(self, batches: list[pa.RecordBatch], size: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.ids, self.norms = table.column("id"), column("norm").to_numpy()
        self.lengths = column("terms").value_lengths().to_numpy().astype(np.int64)
        self.terms, self.impacts = column("terms").flatten().to_numpy(), column("impacts").flatten().to_numpy().astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        order = np.argsort(self.terms, kind="stable")
        self.holders = np.repeat(np.arange(len(self.norms)), self.lengths)[order]
        self.by_term = self.impacts[order]
        self.at = np.searchsorted(self.terms[order], np.arange(size + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, rest: np.ndarray, least: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may score ``least`` or more, with their exact scores. Terms come heaviest first; rest[j]: length of what follows j of them."""
        slack = 1 + 1e-9  # bounds are floating: they may only err upward
        longest = self.norms.max() * slack
        if rest[0] * longest + 1 < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        within = np.flatnonzero(rest * longest + 1 < least)
        focus = int(within[0]) if len(within) else len(terms)
        partial = np.zeros(len(self.norms), np.int64)
        met = np.zeros(len(self.norms), bool)
        for term, weight in zip(terms[:focus].tolist(), weights[:focus].tolist(), strict=True):
            a, b = self.at[term], self.at[term + 1]
            partial[self.holders[a:b]] += weight * self.by_term[a:b]
            met[self.holders[a:b]] = True
        # a document without any focus coordinate is bounded by the rest alone, which is too little
        left = np.flatnonzero(met & (partial + rest[focus] * self.norms * slack + 1 >= least))
        if not len(left):
            return left, np.zeros(0, np.int64)
        many = self.lengths[left]
        first = np.cumsum(many) - many
        flat = np.arange(many.sum()) - np.repeat(first, many) + np.repeat(self.starts[left], many)
        return left, np.add.reduceat(dense[self.terms[flat]] * self.impacts[flat], first)


def _searcher(queries: list[tuple[int, list[int], list[int]]], least: dict[int, int], size: int, top: int) -> Callable:
    """Each task's best documents for every query; ``least`` has the scores that a document must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {k: [] for k, _, _ in queries}
        reach = {k: max(1, least.get(k, 1)) for k, _, _ in queries}
        vectors = []
        for k, terms, weights in queries:
            w = np.array(weights, np.int64)
            squares = np.concatenate([np.cumsum((w.astype(np.float64) ** 2)[::-1])[::-1], [0.0]])
            vectors.append((k, np.array(terms, np.int64), w, np.sqrt(squares)))

        dense = np.zeros(size, np.int64)

        def look(held: list[pa.RecordBatch]) -> None:
            chunk = Chunk(held, size)
            for k, terms, weights, rest in vectors:
                dense[terms] = weights
                docs, scores = chunk.search(terms, weights, rest, reach[k], dense)
                dense[terms] = 0
                docs, scores = docs[scores >= reach[k]], scores[scores >= reach[k]]
                if len(docs) > top:
                    bar = np.partition(scores, len(scores) - top)[len(scores) - top]
                    docs, scores = docs[scores >= bar], scores[scores >= bar]
                if len(docs):
                    ids = chunk.ids.take(pa.array(docs)).to_pylist()
                    best[k] = _best(best[k] + list(zip(scores.tolist(), ids, strict=True)), top)
                    if len(best[k]) == top:
                        reach[k] = max(reach[k], best[k][-1][0])

        held, rows, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field("id").type
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= CHUNK:
                look(held)
                held, rows = [], 0
        if held:
            look(held)
        out = [(k, score, doc) for k, pairs in best.items() for score, doc in pairs]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in out], pa.int64()), pa.array([d for _, _, d in out], kind), pa.array([s for _, s, _ in out], pa.int64())], ["k", "doc", "score"])

    return run


def _blocks(items: DataFrame, most_bytes: int) -> Iterator[list[Row]]:
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append(row)
        held += len(row.text or "")
        if held >= most_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("k").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, block: list[Row], top: int) -> DataFrame | None:
    texts = [list(dict.fromkeys(terms_of(row.text))) for row in block]
    known = {t: j for j, t in enumerate(sorted({t for terms in texts for t in terms}))}
    if not known:
        return None
    kind = docs.schema["id"].dataType.simpleString()
    counted = materialize(in_arrow(docs, _counted(known), f"id {kind}, n long, terms array<int>, counts array<int>"))
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
    if not total.docs:
        return None
    # one row per known term: bounded by the block
    df = {r.term: r.df for r in in_arrow(counted.select("terms"), _frequencies(len(known)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = [math.floor(1000 * math.log((2 * total.docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(known))]
    queries = []
    for k, terms in enumerate(texts):
        ids = sorted((known[t] for t in terms if known[t] in df), key=lambda t: (-weight[t], t))
        queries.append((k, ids, [weight[t] for t in ids]))
    holding = counted.where(F.size("terms") > 0)
    impacts = in_arrow(holding, _impacts(total.docs, total.length), f"id {kind}, norm double, salt int, terms array<int>, impacts array<int>")
    dealt = impacts.repartitionByRange(F.desc("norm"), "salt").withColumn("bucket", F.spark_partition_id())
    ordered = materialize(dealt.sortWithinPartitions(F.desc("norm")))
    found = f"k long, doc {kind}, score long"
    columns = ["id", "norm", "terms", "impacts"]
    first = ordered.agg(F.min("bucket")).first()[0]
    # the longest vectors set the scores that every other bucket has to reach
    ahead = materialize(in_arrow(ordered.where(F.col("bucket") == F.lit(first)).select(columns), _searcher(queries, {}, len(known), top), found))
    least = {r.k: r.score for r in _ranked(ahead, top).where(F.col("rank") == top).select("k", "score").collect()}
    behind = in_arrow(ordered.where(F.col("bucket") > F.lit(first)).select(columns), _searcher(queries, least, len(known), top), found)
    ranked = _ranked(ahead.unionByName(behind), top)
    return ranked


def rank(docs: DataFrame, items: DataFrame, top: int = 50, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``top`` best documents of every item: item id, rank (from 1), document id, score.

    Terms are maximal runs of letters and digits, A-Z lower-cased, and of all
    characters beyond ASCII. A term weighs floor(1000 ln((2N + 2) / (2df + 1)));
    a document of n terms has the impact 10^9 tf div (1000 tf + 20 m) with m =
    50 + 50 n N div L. Items are queries in blocks of ``block_bytes`` of text;
    for each block all documents are read, and only its vocabulary is handed to
    the tasks. Equal scores go by ascending id, a null id last. Null and empty
    texts hold no term: such documents are not counted, such items have no
    rows. A row of either table is a document or item of its own, so repeated
    rows give repeated results. Empty tables give no rows. Other columns are
    left out, so their names cannot clash.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    kinds = f"item {items.schema['item'].dataType.simpleString()}, k long"
    shape = [F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score"]
    out = None
    for block in _blocks(items, block_bytes):
        ranked = _search_block(docs, block, top)
        if ranked is not None:
            names = spark.createDataFrame([(row.item, k) for k, row in enumerate(block)], kinds)
            part = ranked.join(F.broadcast(names), "k").select(*shape)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.where("false").select(F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.lit(0).alias("rank"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("score")).select(*shape)
    return out


def rank_sql(top: int = 50) -> str:
    """The same over ``documents`` and ``benchmark`` in DuckDB SQL, every document scored."""
    terms = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'))"
    return f"""with d as materialized (select row_number() over () as r, doc_id, text from documents),
    b as materialized (select row_number() over () as k, item_id, text from benchmark),
    w as (select r, {terms} as term from d),
    c as materialized (select r, term, count(*) as tf from w group by r, term),
    n as materialized (select r, cast(sum(tf) as bigint) as n from c group by r),
    t as (select count(*) as docs, cast(sum(n) as bigint) as len from n),
    f as (select term, cast(floor(1000 * ln((2 * t.docs + 2)::double / (2 * count(*) + 1))) as bigint) as weight from c, t group by term, t.docs),
    q as (select distinct k, term from (select k, {terms} as term from b)),
    s as (select q.k, c.r, cast(sum(f.weight * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + (50 * n.n * t.docs) // t.len)))) as bigint) as score
      from q join f on f.term = q.term join c on c.term = q.term join n on n.r = c.r, t group by q.k, c.r)
    select item_id, rank::int as rank, doc_id, score from (select b.item_id, d.doc_id, s.score, row_number() over (partition by s.k order by s.score desc, d.doc_id) as rank
      from s join d on d.r = s.r join b on b.k = s.k where s.score > 0) where rank <= {top}"""
