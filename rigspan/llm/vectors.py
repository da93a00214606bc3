"""Vector code compression: product codes whose codebooks are searched in equal-average order.

A vector is cut into equal parts, each part is coded by the nearest of a few
entries. Entries are sorted by the sum of their components; the search starts
at a part's own sum and goes outward on both sides. By Cauchy-Schwarz a squared
distance is at least the squared gap of the sums over the dimension, so a side
whose gap says more than the best distance is done. All arithmetic is on
integers; tasks send counts and sums per entry, so a round costs the driver
one small table whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_or_shuffled, in_arrow, materialize

#: Quantised components stay below this in size, so that no square leaves 64 bits in parts of up to 64 components.
MOST = 1 << 24


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of ``book`` for every row of ``parts``; ties go to the lower index."""
    n, dim = parts.shape
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    own = parts.sum(1)
    right = np.searchsorted(sums, own)
    left = right - 1
    far = np.int64(1) << 62
    best, code = np.full(n, far // dim), np.full(n, len(book))
    going = np.arange(n)
    while len(going):
        low, high = left[going], right[going]
        below = np.where(low >= 0, own[going] - sums[np.maximum(low, 0)], far)
        above = np.where(high < len(sums), sums[np.minimum(high, len(sums) - 1)] - own[going], far)
        gap = np.minimum(below, above)
        # a gap that reaches the best distance exactly may still hide a tie of a lower index
        open_ = gap < far
        open_[open_] = gap[open_] ** 2 <= dim * best[going][open_]
        going, low, high, down = going[open_], low[open_], high[open_], (below <= above)[open_]
        entry = order[np.where(down, low, high)]
        apart = ((parts[going] - book[entry]) ** 2).sum(1)
        better = (apart < best[going]) | ((apart == best[going]) & (entry < code[going]))
        best[going[better]], code[going[better]] = apart[better], entry[better]
        left[going[down]] -= 1
        right[going[~down]] += 1
    return code, best


def quantised(vectors: DataFrame, vector_col: str, scale: int = 4096) -> DataFrame:
    """``vectors`` with whole-number components ``__q``, without rows whose vector is null or holds null, NaN or infinity."""
    x = F.col(vector_col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = lambda v: F.floor(v.cast("double") * scale)
    checked = lambda v: F.when(F.abs(whole(v)) < MOST, whole(v)).otherwise(F.raise_error(F.lit("a component is too large for 64-bit distances"))).cast("int")
    return vectors.where(x.isNotNull() & F.forall(x, finite)).withColumn("__q", F.transform(x, checked))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("__q").flatten().to_numpy().astype(np.int64).reshape(-1, width)


def _sums(books: np.ndarray) -> Callable:
    parts, _, dim = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            rows = _rows(batch, parts * dim)
            for p in range(parts):
                mine = rows[:, p * dim : (p + 1) * dim]
                code, _ = nearest(mine, books[p])
                counts[p] += np.bincount(code, minlength=books.shape[1])
                np.add.at(sums[p], code, mine)
        at = np.argwhere(counts)
        met = counts[at[:, 0], at[:, 1]]
        flat = sums[at[:, 0], at[:, 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(met), pa.array(flat.tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"]
        )

    return run


def _codes(books: np.ndarray, keep: list[str]) -> Callable:
    parts, _, dim = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch, parts * dim)
            found = [nearest(rows[:, p * dim : (p + 1) * dim], books[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], 1)
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(text, pa.string()), pa.array(error, pa.int64())], [*keep, "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (part, entry, component).

    Columns: id, code (two hex digits a part), error (squared distance summed
    over parts), label_error (errors summed over equal labels, nulls together)
    and codebooks_sha256. The codebooks start as the parts of the ``entries``
    vectors of smallest id (rows that repeat an id count one by one; null ids
    come last); each round assigns all parts and replaces every used entry by
    the floored mean of its parts. Fewer vectors give smaller codebooks.
    Dropped: null vectors, vectors with null or non-finite components, and
    vectors whose width is not that of the vector of smallest id. Repeated
    rows keep a row each; an empty table has no rows and no codebooks. A width
    that ``parts`` does not divide and components too large for 64-bit
    distances raise. Other columns are left out, so their names cannot clash.
    """
    rows = quantised(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")), "vector", scale).drop("vector")
    rows = materialize(rows)
    first = rows.orderBy(F.asc_nulls_last("id"), "__q").limit(entries).collect()
    width = len(first[0]["__q"]) if first else parts
    if width % parts or not width:
        raise ValueError(f"a width of {width} cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("__q") == width)
    start = np.array([r["__q"] for r in first if len(r["__q"]) == width], np.int64).reshape(-1, parts, width // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        sent = in_arrow(rows.select("__q"), _sums(books), "part int, entry int, n long, sums array<long>")
        # one row per used entry reaches the driver: parts x entries at most
        total = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width // parts)]
        for r in sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
            books[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(width // parts)]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    coded = in_arrow(rows.select("id", "label", "__q"), _codes(books, ["id", "label"]), schema) if first else rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    per_label = few_or_shuffled(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("__label")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), books


def compress_sql(parts: int = 8, entries: int = 16, rounds: int = 6, dim: int = 8, scale: int = 4096) -> str:
    """The same over table ``embeddings`` in DuckDB SQL, every round spelled out, every entry compared."""
    width = parts * dim
    apart = " + ".join(f"(x.v[{k}] - b.v[{k}]) * (x.v[{k}] - b.v[{k}])" for k in range(1, dim + 1))
    mean = ", ".join(f"cast(floor(sum(v[{k}]) / count(*)) as bigint)" for k in range(1, dim + 1))
    kept = f"list_count(embedding) = len(embedding) and len(embedding) = {width} and len(list_filter(embedding, lambda e: isfinite(e))) = {width}"
    texts = [
        f"q as (select vec_id, label, [cast(floor({scale} * cast(e as double)) as bigint) for e in embedding] as v from embeddings where {kept})",
        f"x as materialized (select vec_id, label, p, v[p * {dim} + 1 : p * {dim} + {dim}] as v from q, range({parts}) t(p))",
        f"b0 as materialized (select p, dense_rank() over (partition by p order by vec_id) - 1 as e, v from x qualify row_number() over (partition by p order by vec_id) <= {entries})",
    ]
    near = lambda k: f"a{k} as materialized (select x.vec_id, x.p, any_value(x.label) as label, any_value(x.v) as v, arg_min(b.e, ({apart}, b.e)) as e, min({apart}) as d from x join b{k} b on x.p = b.p group by x.vec_id, x.p)"
    for k in range(rounds):
        texts += [near(k), f"b{k + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{k} b left join (select p, e, [{mean}] as v from a{k} group by p, e) m on m.p = b.p and m.e = b.e)"]
    texts += [
        near(rounds),
        "c as (select vec_id, any_value(label) as label, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from "
        f"a{rounds} group by vec_id)",
        f"h as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds})",
    ]
    return f"with {', '.join(texts)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from c, h"
