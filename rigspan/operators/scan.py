"""Running aggregates and folds in blocks: no task or window holds a whole group.

A group's rows are dealt into blocks by their order column, so that a block's
number is known without looking at other rows. Each block is aggregated on its
own; a small table of blocks is scanned for what stands before each; rows take
that with them into their block's window. Every step is keyed by (group, block).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK = "__block"


def blocked(rows: DataFrame, order: str, width: int) -> DataFrame:
    """``rows`` with their block: ``order`` (a whole number) divided by ``width``."""
    return rows.withColumn(BLOCK, F.floor(F.col(order) / F.lit(width)).cast("long"))


def entries(blocks: DataFrame, keys: list[str], before: dict[str, Column]) -> DataFrame:
    """The table of blocks with window expressions over the blocks before each, in order."""
    past = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*keys, BLOCK, *[c.over(past).alias(name) for name, c in before.items()])


def running_sums(rows: DataFrame, keys: list[str], order: list[str], width: int, sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running totals, the row's own included, in the order of ``order`` (its first column deals the blocks)."""
    cut = blocked(rows.withColumns({f"__{n}": c for n, c in sums.items()}), order[0], width)
    blocks = cut.groupBy(*keys, BLOCK).agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    carried = entries(blocks, keys, {f"__{n}_in": F.sum(f"__{n}") for n in sums})
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(carried, [*keys, BLOCK])
    totals = {n: F.coalesce(f"__{n}_in", F.lit(0)) + F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) for n in sums}
    return out.select(*rows.columns, *[c.alias(n) for n, c in totals.items()])


def running_max(rows: DataFrame, keys: list[str], order: str, width: int, value: Column, out: str) -> DataFrame:
    """``rows`` with the largest ``value`` up to each row."""
    cut = blocked(rows.withColumn("__x", value), order, width)
    carried = entries(cut.groupBy(*keys, BLOCK).agg(F.max("__x").alias("__m")), keys, {"__in": F.max("__m")})
    inside = Window.partitionBy(*keys, BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(carried, [*keys, BLOCK]).select(*rows.columns, F.greatest("__in", F.max("__x").over(inside)).alias(out))


def last_rows(rows: DataFrame, keys: list[str], order: list[str], width: int, value: str, size: int, out: str) -> DataFrame:
    """``rows`` with the array of the last ``size`` values up to each row, oldest first."""
    cut = blocked(rows, order[0], width)
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    near = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    # a block's tail: at most size - 1 values, and of as many blocks as may be needed for them
    at = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*[F.desc(c) for c in order]))
    tails = cut.withColumn("__at", at).where(F.col("__at") < size).groupBy(*keys, BLOCK).agg(F.transform(ordered, lambda x: x["__v"]).alias("__tail"))
    past = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(1 - size, -1)
    carried = tails.select(*keys, BLOCK, F.flatten(F.collect_list("__tail").over(past)).alias("__in"))
    own = F.collect_list(value).over(near.rowsBetween(1 - size, 0))
    both = F.concat("__in", "__own")
    joined = cut.withColumn("__own", own).join(carried, [*keys, BLOCK])
    return joined.select(*rows.columns, F.slice(both, F.greatest(F.size(both) - (size - 1), F.lit(1)), F.lit(size)).alias(out))


def around(rows: DataFrame, keys: list[str], order: list[str], width: int, value: Column, before: str, after: str) -> DataFrame:
    """``rows`` with the last and the next non-null ``value``, the row's own included."""
    cut = blocked(rows.withColumn("__x", value), order[0], width)
    at = F.struct(*order)
    held = F.when(F.col("__x").isNotNull(), at)
    blocks = cut.groupBy(*keys, BLOCK).agg(F.max_by("__x", held).alias("__last"), F.min_by("__x", held).alias("__first"))
    past = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, BLOCK, F.last("__last", ignorenulls=True).over(past).alias("__before"), F.last("__first", ignorenulls=True).over(ahead).alias("__after"))
    up = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, BLOCK).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    near = cut.join(carried, [*keys, BLOCK])
    return near.select(
        *rows.columns,
        F.coalesce(F.last("__x", ignorenulls=True).over(up), "__before").alias(before),
        F.coalesce(F.last("__x", ignorenulls=True).over(down), "__after").alias(after),
    )


def _offsets(table: pa.Table, by: list[str]) -> np.ndarray:
    """Where the runs of equal ``by`` begin, and the number of rows."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in by:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def _whole(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``by`` as tables of whole groups; the last group of a batch waits for its other rows."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            last = int(_offsets(table, by)[-2])
            if held and (last or any(table.column(c)[0] != held[-1].column(c)[0] for c in by)):
                yield pa.concat_tables([*held, table.slice(0, last)]).combine_chunks()
                held = []
            elif last:
                yield table.slice(0, last)
            held.append(table.slice(last))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _in_groups(rows: DataFrame, by: list[str], order: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over tables that hold whole groups, many small ones at once, their rows in order: no call, batch or frame per group."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, by):
            yield from run(table).to_batches()

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(walk, schema)


def composed(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    width: int,
    summarise: Callable[[dict[str, np.ndarray]], list],
    summary: str,
    enter: Callable[[list[tuple]], list],
    state: str,
    fold: Callable[[dict[str, np.ndarray], tuple | None], tuple],
    schema: str,
) -> DataFrame:
    """A fold over the rows of each group that is cut into blocks.

    ``summarise`` says of a block, given as arrays by column, what it makes of
    every state it may be entered with (a row of ``summary``); ``enter`` takes a
    group's summaries in order and gives each block's state on entry (a row of
    ``state``; None for the first); ``fold`` runs a block from that state and
    gives the columns of ``schema`` that ``rows`` has not, in order. Only
    summaries of a group ever meet. Rows without a key or a place in the order
    are left out.
    """
    by = [*keys, BLOCK]
    cut = blocked(rows, order[0], width).dropna(subset=by)
    kinds = dict(cut.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in by)
    types = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    summed, entered, out = types(f"{head}, {summary}"), types(f"{head}, {state}"), types(schema)
    states, fresh = entered.names[len(by) :], [c for c in out.names if c not in rows.columns]

    def built(of: pa.Schema, kept: pa.Table, made: dict[str, list]) -> pa.Table:
        return pa.table([pa.array(made[f.name], f.type) if f.name in made else kept.column(f.name).cast(f.type) for f in of], names=of.names)

    def blocks_of(table: pa.Table, at: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        arrays = {c: table.column(c).to_numpy() for c in table.column_names if c not in by}
        return ({c: v[i:j] for c, v in arrays.items()} for i, j in zip(at[:-1], at[1:], strict=True))

    def sum_up(table: pa.Table) -> pa.Table:
        at = _offsets(table, by)
        made = zip(*[summarise(block) for block in blocks_of(table, at)], strict=True)
        return built(summed, table.take(at[:-1]), dict(zip(summed.names[len(by) :], map(list, made), strict=True)))

    def chain(table: pa.Table) -> pa.Table:
        at = _offsets(table, keys)
        summaries = list(zip(*[table.column(c).to_pylist() for c in summed.names[len(by) :]], strict=True))
        met = [s for i, j in zip(at[:-1], at[1:], strict=True) for s in enter(summaries[i:j])]
        return built(entered, table, dict(zip(states, map(list, zip(*met, strict=True)), strict=True)))

    def run(table: pa.Table) -> pa.Table:
        # each block's rows follow the row with its state
        first = table.filter(pc.invert(table.column("__is_row")))
        own = table.filter(table.column("__is_row")).select([c for c in table.column_names if c not in states])
        begins = zip(*[first.column(c).to_pylist() for c in states], strict=True)
        made: list[list] = [[] for _ in fresh]
        for block, s in zip(blocks_of(own, _offsets(own, by)), begins, strict=True):
            for column, values in zip(made, fold(block, None if None in s else s), strict=True):
                column.extend(values)
        return built(out, own, dict(zip(fresh, made, strict=True)))

    blocks = _in_groups(cut, by, order, sum_up, f"{head}, {summary}")
    begins = _in_groups(blocks, keys, [BLOCK], chain, f"{head}, {state}")
    both = begins.withColumn("__is_row", F.lit(False)).unionByName(cut.withColumn("__is_row", F.lit(True)), allowMissingColumns=True)
    return _in_groups(both, by, ["__is_row", *order], run, schema)
