"""Tables of the engine's shapes, derived from the driver's tables, for Spark and as SQL.

``SQL`` holds each as a common table expression; :func:`view` builds the same
frame with Spark expressions. Bags, robots and runs are ranges of their base
table's keys: their number grows with the table, not their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name: (base table, columns in Spark SQL, columns in DuckDB SQL)
_CMD = (
    "case when event_id % 20 <> 0 then null when event_type in ('click', 'view') then 1 when event_type = 'purchase' then 2 "
    "when event_type = 'error' then case when event_id % 40 = 0 then 3 else 2 end "
    "else case when event_id % 60 = 0 then 4 else 2 end end as cmd"
)
_TOPIC = "case when event_id % 20 = 0 then 'control' else event_type end as topic"
_MICROS = ("unix_micros(cast(ts as timestamp)) as t_us", "epoch_us(ts) as t_us")


def _slice(first: int, last: int, name: str, cast: bool = True) -> tuple[str, str]:
    return (
        f"transform(slice(embedding, {first}, {last - first + 1}), x -> cast(x as double)) as {name}",
        f"embedding[{first}:{last}]::double[] as {name}",
    )


def _both(*columns: str | tuple[str, str]) -> tuple[list[str], list[str]]:
    pairs = [c if isinstance(c, tuple) else (c, c) for c in columns]
    return [a for a, _ in pairs], [b for _, b in pairs]


def _div(a: str, b: str, name: str) -> tuple[str, str]:
    return f"{a} div {b} as {name}", f"{a} // {b} as {name}"


def _el(k: int) -> str:
    return f"cast(embedding[{k - 1}] as double)", f"embedding[{k}]::double"


def _box(expr: str, name: str) -> tuple[str, str]:
    import re

    return tuple(re.sub(r"@(\d+)", lambda m, s=side: _el(int(m[1]))[s], expr) + f" as {name}" for side in (0, 1))


_QN = "sqrt(@19*@19 + @20*@20 + @21*@21 + @22*@22)"
TABLES: dict[str, tuple[str, tuple[list[str], list[str]]]] = {
    "messages": ("events", _both(_div("user_id", "15", "bag"), "event_id as seq", _MICROS, _TOPIC, _CMD, "value")),
    "steps": ("embeddings", _both("vec_id % 25 as episode_id", _div("vec_id", "25", "step"), _slice(1, 8, "qpos"), _slice(9, 15, "action"))),
    "poses": (
        "embeddings",
        _both("vec_id as id", *[_box(f"@{16 + k}", n) for k, n in enumerate(("px", "py", "pz"))], *[_box(f"@{19 + k} / {_QN}", n) for k, n in enumerate(("qx", "qy", "qz", "qw"))]),
    ),
    "scores": ("embeddings", _both("vec_id as id", _slice(1, 10, "scores"), "cast(label as bigint) as target")),
    "boxes": (
        "embeddings",
        _both("vec_id % 2 as side", "cast(label as bigint) as grp", "vec_id as id", _box("@31", "cx"), _box("@32", "cy"), _box("abs(@33) + 0.01", "w"), _box("abs(@34) + 0.01", "h")),
    ),
    "rewards": (
        "orders",
        _both(_div("o_custkey", "30", "rollout"), "o_orderkey as t", "case when o_orderstatus = 'P' then null else 5 - cast(substr(o_orderpriority, 1, 1) as bigint) end as reward"),
    ),
    "contacts": (
        "lineitem",
        _both(
            "l_suppkey % 50 as rollout", "l_partkey % 40 as t", "'red_box' as geom1",
            "case l_returnflag when 'A' then 'vx300s_left/10_left_gripper_finger' when 'R' then 'vx300s_right/10_right_gripper_finger' else 'table' end as geom2",
        ),
    ),
    "contacts_peg": (
        "lineitem",
        _both(
            "l_suppkey % 50 as rollout", "l_partkey % 40 as t",
            "case when l_returnflag = 'A' and l_linestatus = 'F' then concat('socket-', cast(1 + l_linenumber % 4 as varchar(9))) when l_returnflag = 'N' and l_linestatus = 'F' then 'socket-1' else 'red_peg' end as geom1",
            "case when l_returnflag = 'A' and l_linestatus = 'F' then 'vx300s_left/10_left_gripper_finger' when l_returnflag = 'A' then 'vx300s_right/10_right_gripper_finger' "
            "when l_returnflag = 'N' then 'table' when l_linestatus = 'F' then concat('socket-', cast(1 + l_linenumber % 4 as varchar(9))) else 'pin' end as geom2",
        ),
    ),
    "metrics": (
        "orders",
        _both(_div("o_custkey", "150", "run"), "o_orderkey as seq", "o_orderkey % 100 as epoch", "case when o_orderstatus = 'F' then 'train' else 'val' end as phase", "o_custkey % 4 as rank", "o_totalprice as value"),
    ),
    "latency": ("events", _both(_div("user_id", "15", "robot"), "event_id as seq", _MICROS, "value / 1000 as sec")),
    "logits": ("events", _both(_div("user_id", "15", "robot"), "event_id as seq", _MICROS, "value / 50 - 1 as x")),
    "ragged": (
        "documents",
        _both(
            _div("doc_id", "8", "batch"), "doc_id as id",
            ("transform(split(text, ' '), w -> cast(length(w) as bigint)) as v", "[length(w)::bigint for w in string_split(text, ' ')] as v"),
        ),
    ),
    "mask_pixels": ("part", _both("cast(p_size as bigint) as mask_id", "p_partkey % 37 as y", "p_partkey % 53 as x")),
    "joints": (
        "events",
        _both(
            _div("user_id", "15", "bag"), "event_id as seq",
            (
                "case event_id % 3 when 0 then array('j1', 'j2', 'j3') when 1 then array('j2', 'j3', 'j1') else array('j3', 'j1', 'j2') end as names",
                "case event_id % 3 when 0 then ['j1', 'j2', 'j3'] when 1 then ['j2', 'j3', 'j1'] else ['j3', 'j1', 'j2'] end as names",
            ),
            ("array(value, value / 2, value / 3) as pos", "[value, value / 2, value / 3] as pos"),
        ),
    ),
}
SQL = {name: f"select {', '.join(columns[1])} from {base}" for name, (base, columns) in TABLES.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, (columns, _) = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*columns)


def oracle(body: str, *names: str, also: str = "") -> str:
    """A SQL text whose common table expressions are the named fixtures."""
    parts = [f"{n} as ({SQL[n]})" for n in names] + ([also] if also else [])
    return f"with recursive {', '.join(parts)} {body}" if parts else body
