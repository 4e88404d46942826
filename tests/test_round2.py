"""Cases that once gave wrong answers: text periods, text and wide ids, gauges, searches without a target, small event records."""

import pytest
from pyspark.sql import functions as F

from hydrospark.operators import gauge as G, ordered as O, spatial as S
from hydrospark.plans import summary


def test_share_at_the_largest_period_as_text(spark):
    flags = spark.createDataFrame(
        [(1, "Box", "25yr", "Not Vulnerable"), (1, "Box", "100yr", "Vulnerable"), (1, "Box", "50yr", "Not Vulnerable"), (2, None, "100yr", "Not Vulnerable"),
         (3, "Bridge", "100yr", "Vulnerable")], "point_id long, pour_sha string, return_period string, vuln string").withColumn("m", F.lit("x"))
    row = summary.vulnerable_share(flags, ["m"]).first()
    assert (row["return_period"], row["culverts"], row["vulnerable"]) == ("100yr", 2, 1)
    inventory = spark.createDataFrame([(1, "Box"), (2, None), (3, "Bridge"), (4, "Arch")], "point_id long, pour_sha string")
    row = summary.vulnerable_share(flags, ["m"], inventory).first()
    assert (row["culverts"], row["vulnerable"], round(row["vulnerable_pct"], 3)) == (3, 1, 33.333)
    event = flags.withColumn("return_period", F.lit("event"))
    assert summary.vulnerable_share(event, ["m"]).first()["return_period"] == "event"


def test_rank_of_text_ids_and_wide_numbers(spark):
    df = spark.createDataFrame([("b", 2**53 + 1, "g"), ("a", 2**53, "g"), ("c", 2**53, "g"), ("d", 5, None), ("e", None, "g")], "id string, v long, k string")
    assert {r["id"]: (r["rank"], r["group_rows"]) for r in O.ranked(df, "v", "id").collect()} == {"d": (1, 4), "a": (2, 4), "c": (3, 4), "b": (4, 4)}
    assert {r["id"]: r["rank"] for r in O.ranked(df, "v", "id", ["k"], descending=True).collect() if r["k"]} == {"b": 1, "a": 2, "c": 3}


def test_nearest_crossing_takes_the_gauges_place(spark):
    crossings = spark.createDataFrame([(1, 10.0, 0.0, "own"), (2, 100.0, 0.0, "own"), (3, 500.0, 0.0, None)], "point_id long, x double, y double, name string")
    gauges = spark.createDataFrame([(7, 12.0, 0.0, "g7"), (8, 9.5, 0.0, "g8"), (9, 300.0, 0.0, "far")], "gauge_id long, x double, y double, name string")
    got = {r["point_id"]: (r["gauge_id"], r["x"], r["name"]) for r in S.replace_from_nearest(crossings, gauges, 30.0, ["name"]).collect()}
    assert got == {1: (8, 9.5, "g8"), 2: (None, 100.0, "own"), 3: (None, 500.0, None)}


def test_nearest_at_any_distance_keeps_every_point(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 1e6, 0.0)], "point_id long, x double, y double")
    targets = spark.createDataFrame([(5, 1.0, 0.0)], "target_id long, x double, y double")
    assert {r["point_id"]: r["target_id"] for r in S.nearest_any(points, targets, 10.0).collect()} == {1: 5, 2: None, 3: 5}
    assert [r["target_id"] for r in S.nearest_any(points, targets.limit(0), 10.0).collect()] == [None, None, None]
    with pytest.raises(RuntimeError):
        S.nearest_any(points, targets, 1e-3, max_rounds=2)


def test_every_event_unless_told_otherwise(spark):
    onsets = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "site string, at long, flow double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    rows = spark.createDataFrame([("s", 10)], "site string, n_rows long")
    assert G.top_events(onsets, rows).count() == 10
    assert G.top_events(onsets, rows, top_n=4).count() == 4
    assert G.top_events(onsets, rows, top_share=0.5).count() == 5
    assert G.top_events(onsets, rows, top_n=100, ref_compat=True).count() == 3
