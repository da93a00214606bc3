"""Stored episodes, statistics and results: what is written, and what a scan leaves out."""

import pytest
from pyspark.sql import functions as F

from rigspan.functions import geometry as geo
from rigspan.sources import store


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("store"))
    steps = spark.range(4000).selectExpr("id div 1000 as bag", "id div 100 % 10 as episode_id", "id % 100 as step", "array(cast(id as double)) as qpos", "array(1.0D, 2.0D) as action")
    spans = steps.groupBy("bag", "episode_id").agg(F.lit(0).cast("long").alias("start_us"), F.lit(9).cast("long").alias("stop_us")).unionByName(spark.sql("select 9L as bag, 0L as episode_id, 0L as start_us, 1L as stop_us"))
    joints = spark.createDataFrame([(0, 5, ["b"]), (0, 2, ["a", "é"])], "bag long, seq long, names array<string>")
    store.write_store(steps, store.episode_attributes(spans, joints, fps=25), where)
    return where


def test_attributes(spark, path):
    meta = {(r.bag, r.episode_id): r for r in store.read_meta(spark, path).collect()}
    assert len(meta) == 41 and meta[9, 0].steps == 0 and meta[3, 9].steps == 100
    assert meta[0, 4].joint_names == ["a", "é"] and meta[1, 0].joint_names is None
    assert (meta[0, 0].fps, meta[0, 0].sim, meta[0, 0].stop_us) == (25, False, 9)


def test_a_slice_reads_its_folder_and_columns_alone(spark, path):
    out = store.read_steps(spark, path, bag=2, episode=3, first=10, n=5, fields=["qpos"])
    assert sorted(r.qpos[0] for r in out.collect()) == [2310.0, 2311.0, 2312.0, 2313.0, 2314.0]
    plan = out._jdf.queryExecution().explainString(out.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = plan[plan.index("Scan parquet") :] if "(1) Scan parquet" not in plan else plan[plan.index("(1) Scan parquet") :]
    assert "PartitionFilters: [" in scan and "bag" in scan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = scan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(episode_id,3)" in pushed and "LessThan(step,15)" in pushed
    assert "action" not in scan.split("ReadSchema: ")[1].split("\n")[0]


def test_whole_store_and_empty_slices(spark, path):
    assert store.read_steps(spark, path).count() == 4000
    assert store.read_steps(spark, path, bag=7).count() == store.read_steps(spark, path, bag=1, episode=1, first=100).count() == 0


def test_statistics_are_checked_when_loaded(spark, tmp_path):
    stats = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "dim long, mean double, std double")
    store.write_statistics({"qpos": stats, "action": stats.where("dim = 0")}, str(tmp_path / "s"))
    assert store.read_statistics(spark, str(tmp_path / "s"), {"qpos": 2, "action": 1}).count() == 3
    for widths in ({"qpos": 3}, {"image": 1}):
        with pytest.raises(ValueError, match="do not fit"):
            store.read_statistics(spark, str(tmp_path / "s"), widths)


def test_results_are_appended(spark, tmp_path):
    path = str(tmp_path / "r")
    returned = spark.createDataFrame([(0, 6, 4, True), (1, 1, 1, False), (2, 0, None, False)], "rollout long, total long, highest long, success boolean")
    store.append_result(returned, "a", path)
    store.append_result(returned.where("false"), "b", path)
    rows = {r.name: r for r in spark.read.parquet(path).collect()}
    assert rows["a"].reached == [2, 2, 1, 1, 1] and rows["a"].success_rate == pytest.approx(1 / 3) and rows["a"].rates[4] == pytest.approx(1 / 3)
    assert rows["b"].rollouts == 0 and rows["b"].success_rate is None and rows["b"].rates == [None] * 5


def test_a_turn_from_an_orientation(spark):
    half = 0.5**0.5
    lit = lambda *v: [F.lit(float(x)) for x in v]
    row = spark.range(1).select(F.array(*geo.axis_angle(lit(2, 0, 0), F.lit(90.0))).alias("a"), F.array(*geo.turned(lit(half, half, 0, 0), lit(1, 0, 0), F.lit(90.0))).alias("t"), F.array(*geo.turned(lit(half, 0, 0, half), lit(0, 1, 0), F.lit(180.0))).alias("u")).first()
    assert row.a == pytest.approx([half, half, 0, 0]) and row.t == pytest.approx([0, 1, 0, 0], abs=1e-12)
    assert row.u == pytest.approx([0, -half, half, 0], abs=1e-12)
