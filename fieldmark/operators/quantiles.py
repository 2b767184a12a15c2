"""Exact percentiles (linear interpolation, numpy's default) per group, one way at every size.

1. values are pre-aggregated to ``(group, value, count)`` (map-side combine);
2. that table is range-partitioned by (group, value) and written with its partition
   numbers, so a group of any size is spread over as many partitions as it needs;
3. counts per (group, partition), a table of groups x partitions, are prefix-summed: they
   say which partition holds a wanted rank;
4. only those partitions' rows are ranked, each within its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.session import scratch_path


def _suffix(p: float) -> str:
    return ("p" + f"{p:g}").replace(".", "_")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                      names: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One row per group that has a non-NULL value, one column per probability.

    Groups without any value are absent (callers left-join, as ``summarize`` does).  With ``weight`` a row stands for
    that many equal values, so that counts of values merge before the percentiles are taken.
    """
    names = names or [_suffix(p) for p in probs]
    spark = df.sparkSession
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*keys, F.col(value).cast("double").alias("_v"))
               .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_c")))
    path = scratch_path(spark, "ranges")
    counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)

    group, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part")
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s")).select(
        *keys, "_part", "_s", F.sum("_s").over(group).alias("_n"),
        (F.sum("_s").over(before) - F.col("_s")).alias("_before"))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.lit(step).alias("step"))
        for p, name in zip(probs, names) for step in (0, 1)])).alias("_w")
    place = F.col("_w.p") * (F.col("_n") - 1)
    ranks = parts.select("*", wanted).select(
        *keys, "_part", "_s", "_before", F.col("_w.name").alias("_name"), F.col("_w.step").alias("_step"),
        (place - F.floor(place)).alias("_frac"),
        F.least(F.floor(place) + F.col("_w.step"), F.col("_n") - 1).alias("_rank"))
    ranks = ranks.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_s")))
    upto = Window.partitionBy(*keys, "_name", "_step").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (ranged.join(ranks, [*keys, "_part"])
             .withColumn("_upto", F.sum("_c").over(upto) + F.col("_before"))
             .where(F.col("_upto") > F.col("_rank"))
             .groupBy(*keys, "_name", "_step").agg(F.min("_v").alias("_v"), F.first("_frac").alias("_frac")))

    def at(name, step):
        return F.max(F.when((F.col("_name") == name) & (F.col("_step") == step), F.col("_v")))

    def frac(name):
        return F.max(F.when(F.col("_name") == name, F.col("_frac")))

    return found.groupBy(*keys).agg(*[
        (at(n, 0) + (at(n, 1) - at(n, 0)) * frac(n)).alias(n) for n in names])
