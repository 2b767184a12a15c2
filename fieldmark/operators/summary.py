"""Per-run aggregation, leaderboards and gates.

``summarize`` is one ``groupBy(run)`` with partial aggregation (means, counts,
conditional counts) plus the exact latency percentiles of
``fieldmark.operators.quantiles``.  Everything after it works on the summary,
which has one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.metrics import METRIC_FIELDS, model_type
from fieldmark.operators.quantiles import exact_percentiles
from fieldmark.session import scratch_path

GOLD_TYPES = ["forward", "inverse", "other"]


def mean_of(c: Column) -> Column:
    """A1: NULL-skipping mean, booleans as 0/1, all-NULL -> NULL."""
    return F.avg(c.cast("double"))


def run_means(scored: DataFrame, run_col: str = "run") -> DataFrame:
    """A1 + A2 + A5 + A6 in one aggregation."""
    aggs = [mean_of(F.col(f)).alias(f) for f in METRIC_FIELDS]
    aggs += [
        mean_of(F.col("exact_match")).alias("exact_match_rate"),
        mean_of(F.col("schema_valid")).alias("schema_valid_rate"),
        F.count(F.lit(1)).alias("n"),
    ]
    for t in GOLD_TYPES:
        aggs.append(F.count_if((F.col("type") == t) & F.col("exact_match")).alias(f"hits_{t}"))
        aggs.append(F.count_if(F.col("type") == t).alias(f"total_{t}"))
    return scored.groupBy(F.col(run_col).alias("model")).agg(*aggs)


def type_hits(scored: DataFrame, run_col: str = "run") -> DataFrame:
    """A5 + A6 in long form by one aggregate over GROUPING SETS ((run), (run, type)).

    ``(model, type, is_total, hits, total)``: a row per run and gold type (a type may be NULL), and per run the row of
    all its examples.
    """
    rows = scored.select(F.col(run_col).alias("model"), "type", "exact_match")
    return rows.groupingSets([["model"], ["model", "type"]], "model", "type").agg(
        (F.grouping("type") == 1).alias("is_total"), F.count_if("exact_match").alias("hits"), F.count(F.lit(1)).alias("total"))


def hits_by_type(scored: DataFrame, run_col: str = "run") -> DataFrame:
    """A5 + A6: one row per run from ``type_hits``: ``n``, and hits and totals of each gold type, 0 where there are none."""
    long = type_hits(scored, run_col)
    aggs = [F.max(F.when(F.col("is_total"), F.col("total"))).alias("n")]
    for t in GOLD_TYPES:
        of = (F.col("type") == t) & ~F.col("is_total")
        aggs += [F.coalesce(F.max(F.when(of, F.col(c))), F.lit(0)).alias(f"{c}_{t}") for c in ("hits", "total")]
    return long.groupBy("model").agg(*aggs)


def latency_stats(scored: DataFrame, run_col: str = "run", latency_col: str = "latency_s") -> DataFrame:
    """A3 + A4: exact median and p95 (linear interpolation) per run."""
    df = scored.select(F.col(run_col).alias("model"), F.col(latency_col).alias("_lat"))
    return exact_percentiles(df, ["model"], "_lat", [0.5, 0.95], ["latency_median_s", "latency_p95_s"])


# Partial summaries: what is gathered of a part of the examples, and adds up over parts.

MEANS = [*METRIC_FIELDS, "exact_match", "schema_valid"]


def partial_means(scored: DataFrame, run_col: str = "run") -> DataFrame:
    """Per run: sum and number of each metric's values, examples, hits and totals by type."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in MEANS:
        value = F.col(c).cast("double")
        aggs += [F.coalesce(F.sum(value), F.lit(0.0)).alias(f"sum_{c}"), F.count(value).alias(f"num_{c}")]
    for t in GOLD_TYPES:
        aggs += [F.count_if((F.col("type") == t) & F.col("exact_match")).alias(f"hits_{t}"),
                 F.count_if(F.col("type") == t).alias(f"total_{t}")]
    return scored.groupBy(F.col(run_col).alias("model")).agg(*aggs)


def partial_latencies(scored: DataFrame, run_col: str = "run", latency_col: str = "latency_s") -> DataFrame:
    """Per run: each latency and how often it stands there."""
    return scored.where(F.col(latency_col).isNotNull()).groupBy(
        F.col(run_col).alias("model"), F.col(latency_col).alias("latency_s")).agg(F.count(F.lit(1)).alias("times"))


def merged_means(partials: DataFrame) -> DataFrame:
    """The sum of partial means, again a partial."""
    return partials.groupBy("model").agg(*[F.sum(c).alias(c) for c in partials.columns if c not in ("model", "part")])


def merged_latencies(partials: DataFrame) -> DataFrame:
    return partials.groupBy("model", "latency_s").agg(F.sum("times").alias("times"))


def summary_of_partials(means: DataFrame, latencies: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """A7 from any number of partials: the same columns as ``summarize``."""
    names = {"exact_match": "exact_match_rate", "schema_valid": "schema_valid_rate"}
    added = merged_means(means)
    out = added.select(
        "model", *[F.when(F.col(f"num_{c}") > 0, F.col(f"sum_{c}") / F.col(f"num_{c}")).alias(names.get(c, c)) for c in MEANS],
        "n", *[f"{k}_{t}" for t in GOLD_TYPES for k in ("hits", "total")])
    stats = exact_percentiles(latencies, ["model"], "latency_s", [0.5, 0.95], ["latency_median_s", "latency_p95_s"], "times")
    return _attributed(out.join(stats, "model", "left"), runs)


def narrow_scores(scored: DataFrame, *columns: str) -> DataFrame:
    """The columns of scored examples that summaries read, and ``columns``, as a written table of the same schema."""
    path = scratch_path(scored.sparkSession, "scores")
    rows = scored.select(*dict.fromkeys([*columns, "type", *MEANS]))
    rows.write.parquet(path)
    return scored.sparkSession.read.schema(rows.schema).parquet(path)


def summarize(scored: DataFrame, runs: DataFrame | None = None, run_col: str = "run",
              latency_col: str = "latency_s") -> DataFrame:
    """One row per run with attributes, means, rates, latency and hits by type.

    ``runs`` (optional, the run dimension) adds precision/backend, '?' when unknown.  What the means and the percentiles
    read of the examples is written once, so that these are scored once.
    """
    scored = narrow_scores(scored, run_col, latency_col)
    return _attributed(run_means(scored, run_col).join(latency_stats(scored, run_col, latency_col), "model", "left"), runs)


def _attributed(out: DataFrame, runs: DataFrame | None) -> DataFrame:
    out = out.withColumn("model_type", model_type(F.col("model")))
    for t in GOLD_TYPES:
        out = out.withColumn(f"em_{t}", F.concat_ws("/", F.col(f"hits_{t}").cast("string"),
                                                   F.col(f"total_{t}").cast("string")))
    if runs is not None:
        dim = runs.select(F.col("name").alias("model"), "precision", "backend")
        out = out.join(dim, "model", "left").select(
            "*", F.coalesce("precision", F.lit("?")).alias("_p"), F.coalesce("backend", F.lit("?")).alias("_b")
        ).drop("precision", "backend").withColumnRenamed("_p", "precision").withColumnRenamed("_b", "backend")
    return out


def leaderboard(summary: DataFrame) -> DataFrame:
    """exact_match_rate descending, NULLs last; the run name breaks ties."""
    return summary.orderBy(F.col("exact_match_rate").desc_nulls_last(), F.col("model").asc())


def ranked(summary: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Position 1..n (no shared rank).  The summary has one row per run."""
    w = Window.orderBy(F.col("exact_match_rate").desc_nulls_last(), F.col("model").asc())
    if partition:
        w = w.partitionBy(*partition)
    return summary.withColumn("rank", F.row_number().over(w))


def fmt3(c: Column) -> Column:
    """Float with 3 decimals (half-even on the exact value), NULL -> '-'."""
    return F.coalesce(F.regexp_replace(F.format_number(c, 3), ",", ""), F.lit("-"))


LEADERBOARD_COLUMNS = ["exact_match_rate", "schema_valid_rate", "intent_correct", "mode_correct",
                       "product_id_correct", "drivers_recall", "targets_recall",
                       "latency_median_s", "latency_p95_s"]


def sectioned_leaderboard(summary: DataFrame) -> DataFrame:
    """llm_generalist section first, then the other model types, ranked within section."""
    section = F.when(F.col("model_type") == "llm_generalist", F.lit(1)).otherwise(F.lit(2))
    s = summary.withColumn("section", section)
    s = ranked(s, ["section"])
    return s.select("section", "rank", "model", "model_type",
                    *[fmt3(F.col(c)).alias(c) for c in LEADERBOARD_COLUMNS])


def class_means(summary: DataFrame) -> DataFrame:
    """Mean of the per-run rates by model class (generalist vs baselines)."""
    return summary.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("exact_match_rate").alias("exact_match_rate"),
        F.avg("schema_valid_rate").alias("schema_valid_rate"),
    )


def quality_gate(pairs: DataFrame, run_col: str = "run") -> DataFrame:
    """Per run PASS when every row is usable; a final ``ALL`` row ANDs the runs.

    Generalist runs need ``valid_json`` and a prediction; baseline runs need a
    prediction with a drivers list.
    """
    kind = model_type(F.col(run_col))
    ok = F.when(kind == "llm_generalist",
                F.coalesce(F.col("valid_json"), F.lit(False)) & F.col("prediction").isNotNull()) \
        .otherwise(F.col("prediction").isNotNull() & F.col("prediction")["drivers"].isNotNull())
    per_run = pairs.groupBy(F.col(run_col).alias("pipeline")).agg(F.bool_and(ok).alias("passed"))
    overall = per_run.agg(F.bool_and("passed").alias("passed")).select(F.lit("ALL").alias("pipeline"), "passed")
    return per_run.unionByName(overall)
