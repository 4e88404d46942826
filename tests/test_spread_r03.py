"""Rows made of a small file lie in as many tasks as there is work for, and none go through the driver."""

from pyspark.sql import functions as F

from hydrospark.catalog import QUERIES, base
from hydrospark.catalog.q_crossings import all_flags
from hydrospark.operators import regions as R
from hydrospark.session import cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(spark, tmp_path, n=4000):
    """One file of n parts, as the queries read them; other tables as small as they may be."""
    spark.range(1, n + 1).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(25).selectExpr("CAST(id AS INT) AS n_nationkey").coalesce(1).write.parquet(str(tmp_path / "nation.parquet"))
    return str(tmp_path)


def tasks(df):
    """Partitions of the result that hold rows."""
    return df.groupBy(F.spark_partition_id()).count().count()


def test_peak_discharge_is_dealt_before_it_is_multiplied(spark, tmp_path):
    d = folder(spark, tmp_path)
    for name in ("q_gpdm", "c4"):
        df = QUERIES[name](spark, d)
        assert tasks(df) > 8, name


def test_flags_of_crossings_pass_no_exploded_rows_through_the_driver(spark, tmp_path):
    flags = all_flags(base.Inputs(spark, folder(spark, tmp_path)))
    assert "BroadcastHashJoin" not in plan(flags)
    assert tasks(flags) > 8
    assert flags.count() == 4000 * 4 * 3


def test_donors_of_a_target_are_ranked_where_it_was_dealt_to(spark, tmp_path):
    spark.range(3000).selectExpr("id AS point_id", "id * 1.0 AS a", "id % 17 * 1.0 AS b").coalesce(1).write.parquet(str(tmp_path / "t"))
    targets = spark.read.parquet(str(tmp_path / "t"))
    gauged = targets.where("point_id % 100 = 0")
    got = R.roi_distance(targets, gauged, ["a", "b"], 5)
    assert tasks(got) > 8
    assert got.count() == 3000 * 5 and got.where("rank = 1 AND site % 100 = 0 AND site <> donor").count() == 0


def test_pool_tests_lie_by_set(spark, monkeypatch):
    members = cut(spark.range(30000).selectExpr("id % 3000 AS s", "id div 3000 + id % 7 AS donor").coalesce(1))
    series = spark.createDataFrame([(d, float((d * 37 + y * y * 11) % 101)) for d in range(20) for y in range(6)], "donor bigint, x double")
    seen = []
    monkeypatch.setattr(R, "cut", lambda df: (seen.append(df.rdd.getNumPartitions()), cut(df))[1])
    assert R.ad_statistics(members, series, ["s"]).count() == 3000 and seen[0] > 8
