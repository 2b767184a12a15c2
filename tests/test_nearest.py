"""Nearest association over equi-depth buckets: bursts, equal positions, sizes of buckets."""

import random

from pyspark.sql import functions as F

from fieldmark.operators.assembly import nearest_by_position, ranged_buckets

SCHEMA = "grp int, oid int, kind string, pos double"


def brute(rows):
    want = {}
    for g, o, k, p in rows:
        if k == "L":
            want[o] = tuple(min(((abs(q - p), i) for h, i, t, q in rows if h == g and t == kind), default=(0, None))[1]
                            for kind in ("V", "U"))
    return want


def check(spark, rows, **how):
    got = nearest_by_position(spark.createDataFrame(rows, SCHEMA), ["grp"], "pos", "oid", "kind", "L", ["V", "U"], "oid", **how)
    assert {r.oid: (r.near_V, r.near_U) for r in got.collect()} == brute(rows), how


def test_bursts_and_equal_positions(spark):
    rng = random.Random(3)
    # one group holds most rows, most of them at a handful of positions
    rows = [(0 if rng.random() < 0.8 else rng.randint(1, 5), i, rng.choice("LVU"),
             float(rng.choice([7, 7, 7, 8, rng.randint(0, 300)]))) for i in range(700)]
    rows += [(9, 9000, "L", 1.0), (10, 9001, "V", 1.0)]
    for how in ({}, {"buckets": 40}, {"buckets": 1}, {"bucket_width": 10.0}):
        check(spark, rows, **how)
    rng.shuffle(rows)
    check(spark, rows, buckets=13)


def test_a_burst_is_split(spark):
    """Nine tenths of the rows of one group in one second: no bucket holds more than twice its share."""
    df = spark.range(40_000).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("o"),
                                    F.when(F.col("id") % 10 == 0, F.col("id") * 1e6).otherwise(F.rand(5) * 1e6).alias("c"))
    sizes = [r["count"] for r in ranged_buckets(df, ["g", "c", "o"], 20).groupBy("_bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 40_000 / 20
    same = df.withColumn("c", F.lit(5.0))
    sizes = [r["count"] for r in ranged_buckets(same, ["g", "c", "o"], 20).groupBy("_bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 40_000 / 20


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert nearest_by_position(df, ["grp"], "pos", "oid", "kind", "L", ["V"], "oid").collect() == []
