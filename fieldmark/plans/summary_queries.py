"""Queries A1-A8, W1-W3, W8, W9, S5, J2: per-run summaries and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.functions.metrics import METRIC_FIELDS
from fieldmark.operators.summary import (
    class_means, fmt3, hits_by_type, latency_stats, leaderboard, narrow_scores, quality_gate, ranked, run_means,
    sectioned_leaderboard, summarize, type_hits, GOLD_TYPES, LEADERBOARD_COLUMNS,
)
from fieldmark.plans.catalog import register
from fieldmark.plans.oracle_sql import scored_sql, with_ctes, GOLD_CTES, PRED_CTES, SCORE_CTES
from fieldmark.plans.scoring_queries import scored
from fieldmark.sources.dimensions import RUNS, runs_df
from fieldmark.sources.fixtures import eval_pairs

_MEANS_SQL = ",\n  ".join(f"avg(CAST({f} AS DOUBLE)) AS {f}" for f in METRIC_FIELDS)

_RUNDIM_VALUES = ", ".join(f"('{r[0]}', '{r[2]}', '{r[1]}')" for r in RUNS)

SUMMARY_CTE = f"""
summary AS (
  SELECT run AS model,
    CASE WHEN lower(run) LIKE '%nuextract%' THEN 'nuextract' WHEN lower(run) LIKE '%gliner%' THEN 'gliner'
         ELSE 'llm_generalist' END AS model_type,
    {_MEANS_SQL},
    avg(CAST(exact_match AS DOUBLE)) AS exact_match_rate,
    avg(CAST(schema_valid AS DOUBLE)) AS schema_valid_rate,
    quantile_cont(latency_s, 0.5) AS latency_median_s,
    quantile_cont(latency_s, 0.95) AS latency_p95_s,
    count(*) AS n,
    count(*) FILTER (WHERE gtype = 'forward' AND exact_match) AS hits_forward,
    count(*) FILTER (WHERE gtype = 'forward') AS total_forward,
    count(*) FILTER (WHERE gtype = 'inverse' AND exact_match) AS hits_inverse,
    count(*) FILTER (WHERE gtype = 'inverse') AS total_inverse,
    count(*) FILTER (WHERE gtype = 'other' AND exact_match) AS hits_other,
    count(*) FILTER (WHERE gtype = 'other') AS total_other
  FROM scored GROUP BY run
),
rundim AS (SELECT * FROM (VALUES {_RUNDIM_VALUES}) t(name, precision, backend))"""


def summary_sql(select: str) -> str:
    return with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, SUMMARY_CTE, select=select)


def _summary(spark, sf_dir):
    return summarize(scored(spark, sf_dir), runs_df(spark))


@register("a01_metric_means", summary_sql(
    "SELECT model, " + ", ".join(METRIC_FIELDS) + " FROM summary"))
def a01_metric_means(spark, sf_dir):
    """A1: NULL-skipping means of the 14 metric fields per run."""
    return run_means(scored(spark, sf_dir)).select("model", *METRIC_FIELDS)


@register("a02_rates", summary_sql("SELECT model, exact_match_rate, schema_valid_rate FROM summary"))
def a02_rates(spark, sf_dir):
    """A2: exact_match_rate and schema_valid_rate per run."""
    return run_means(scored(spark, sf_dir)).select("model", "exact_match_rate", "schema_valid_rate")


@register("a03_latency_median", summary_sql("SELECT model, latency_median_s FROM summary"), headline=True)
def a03_latency_median(spark, sf_dir):
    """A3: exact median latency per run."""
    return latency_stats(eval_pairs(spark, sf_dir)).select("model", "latency_median_s")


@register("a04_latency_p95", summary_sql("SELECT model, latency_p95_s FROM summary"))
def a04_latency_p95(spark, sf_dir):
    """A4: exact p95 latency (linear interpolation) per run."""
    return latency_stats(eval_pairs(spark, sf_dir)).select("model", "latency_p95_s")


@register("a05_hits_by_type", summary_sql("""
SELECT model, CAST(hits_forward AS VARCHAR) || '/' || CAST(total_forward AS VARCHAR) AS em_forward,
       CAST(hits_inverse AS VARCHAR) || '/' || CAST(total_inverse AS VARCHAR) AS em_inverse,
       CAST(hits_other AS VARCHAR) || '/' || CAST(total_other AS VARCHAR) AS em_other,
       hits_forward, total_forward, hits_inverse, total_inverse, hits_other, total_other
FROM summary"""))
def a05_hits_by_type(spark, sf_dir):
    """A5: exact-match hits/total per gold type, from the grouping sets."""
    s = hits_by_type(scored(spark, sf_dir))
    for t in GOLD_TYPES:
        s = s.withColumn(f"em_{t}", F.concat_ws("/", F.col(f"hits_{t}").cast("string"), F.col(f"total_{t}").cast("string")))
    return s.select("model", "em_forward", "em_inverse", "em_other", "hits_forward", "total_forward",
                    "hits_inverse", "total_inverse", "hits_other", "total_other")


@register("a05_grouping_sets", scored_sql("""
SELECT run AS model, gtype AS type, grouping(gtype) = 1 AS is_total, count(*) FILTER (WHERE exact_match) AS hits, count(*) AS total
FROM scored GROUP BY GROUPING SETS ((run), (run, gtype))"""))
def a05_grouping_sets(spark, sf_dir):
    """A5 + A6: hits and totals per run and type and per run, by one aggregate over grouping sets."""
    return type_hits(scored(spark, sf_dir))


@register("a06_example_count", summary_sql("SELECT model, n FROM summary"))
def a06_example_count(spark, sf_dir):
    """Number of examples per run, the totals of the same grouping sets."""
    return hits_by_type(scored(spark, sf_dir)).select("model", "n")


_A07_COLS = (["model", "model_type", "precision", "backend"] + METRIC_FIELDS +
             ["exact_match_rate", "schema_valid_rate", "latency_median_s", "latency_p95_s", "n",
              "em_forward", "em_inverse", "em_other"])


_A07_SQL = summary_sql("""
SELECT s.model, s.model_type, coalesce(d.precision, '?') AS precision, coalesce(d.backend, '?') AS backend,
  """ + ", ".join("s." + f for f in METRIC_FIELDS) + """,
  s.exact_match_rate, s.schema_valid_rate, s.latency_median_s, s.latency_p95_s, s.n,
  CAST(hits_forward AS VARCHAR) || '/' || CAST(total_forward AS VARCHAR) AS em_forward,
  CAST(hits_inverse AS VARCHAR) || '/' || CAST(total_inverse AS VARCHAR) AS em_inverse,
  CAST(hits_other AS VARCHAR) || '/' || CAST(total_other AS VARCHAR) AS em_other
FROM summary s LEFT JOIN rundim d ON d.name = s.model""")


@register("a07_run_summary", _A07_SQL, headline=True)
def a07_run_summary(spark, sf_dir):
    """A7 + J2: the full per-run summary with run attributes ('?' when unknown)."""
    return _summary(spark, sf_dir).select(*_A07_COLS)


@register("a07_merged_partials", _A07_SQL)
def a07_merged_partials(spark, sf_dir):
    """A7 from partial summaries, one per part of the examples, folded: what the stream keeps."""
    from fieldmark.session import scratch_path
    from fieldmark.streaming.summary_stream import current_summary, fold, write_partial

    state, rows = scratch_path(spark, "partials"), narrow_scores(scored(spark, sf_dir), "run", "row_id", "latency_s")
    for batch in range(2):
        write_partial(rows.where(F.col("row_id") % 2 == batch), state, batch)
    fold(spark, state)
    return current_summary(spark, state, runs_df(spark)).select(*_A07_COLS)


@register("a08_class_means", summary_sql("""
SELECT model_type, count(*) AS runs, avg(exact_match_rate) AS exact_match_rate,
       avg(schema_valid_rate) AS schema_valid_rate FROM summary GROUP BY model_type"""))
def a08_class_means(spark, sf_dir):
    """Generalists vs baselines, mean of the run rates."""
    return class_means(summarize(scored(spark, sf_dir)))


@register("w01_leaderboard", summary_sql("SELECT model, exact_match_rate, model_type FROM summary"),
          headline=True)
def w01_leaderboard(spark, sf_dir):
    """Runs by exact_match_rate descending (NULLs last, name breaks ties)."""
    from fieldmark.functions.metrics import model_type

    means = run_means(scored(spark, sf_dir)).withColumn("model_type", model_type(F.col("model")))
    return leaderboard(means).select("model", "exact_match_rate", "model_type")


@register("w02_rank", summary_sql("""
SELECT model, row_number() OVER (ORDER BY exact_match_rate DESC NULLS LAST, model) AS rank FROM summary"""))
def w02_rank(spark, sf_dir):
    """Position 1..n of each run."""
    return ranked(run_means(scored(spark, sf_dir))).select("model", "rank")


def _fmt_sql(c: str) -> str:
    return f"coalesce(printf('%.3f', {c}), '-') AS {c}"


@register("w03_sectioned_leaderboard", summary_sql("""
SELECT section, row_number() OVER (PARTITION BY section ORDER BY exact_match_rate DESC NULLS LAST, model) AS rank,
       model, model_type, """ + ", ".join(_fmt_sql(c) for c in LEADERBOARD_COLUMNS) + """
FROM (SELECT *, CASE WHEN model_type = 'llm_generalist' THEN 1 ELSE 2 END AS section FROM summary)"""))
def w03_sectioned_leaderboard(spark, sf_dir):
    """Generalist section then baselines, ranked within section, 3-decimal text."""
    return sectioned_leaderboard(summarize(scored(spark, sf_dir)))


@register("w08_number_format", summary_sql("""
SELECT model, """ + ", ".join(_fmt_sql(c) for c in METRIC_FIELDS) + " FROM summary"))
def w08_number_format(spark, sf_dir):
    """Every mean as 3-decimal text, NULL as '-'."""
    s = run_means(scored(spark, sf_dir))
    return s.select("model", *[fmt3(F.col(c)).alias(c) for c in METRIC_FIELDS])


@register("w09_quality_gate", with_ctes(GOLD_CTES, PRED_CTES, select="""
SELECT pipeline, passed FROM (
  SELECT run AS pipeline, bool_and(CASE WHEN lower(run) LIKE '%nuextract%' OR lower(run) LIKE '%gliner%'
                                        THEN NOT p_null ELSE valid_json AND NOT p_null END) AS passed
  FROM pred GROUP BY run)
UNION ALL
SELECT 'ALL', bool_and(passed) FROM (
  SELECT bool_and(CASE WHEN lower(run) LIKE '%nuextract%' OR lower(run) LIKE '%gliner%'
                       THEN NOT p_null ELSE valid_json AND NOT p_null END) AS passed
  FROM pred GROUP BY run)"""))
def w09_quality_gate(spark, sf_dir):
    """PASS/FAIL per pipeline and overall."""
    return quality_gate(eval_pairs(spark, sf_dir))


@register("s05_summary_csv_order", summary_sql("""
SELECT model, exact_match_rate, row_number() OVER (ORDER BY exact_match_rate DESC NULLS LAST, model) AS line
FROM summary"""))
def s05_summary_csv_order(spark, sf_dir):
    """Summary lines sorted by exact_match_rate (line number = CSV position)."""
    return ranked(summarize(scored(spark, sf_dir))).select(
        "model", "exact_match_rate", F.col("rank").alias("line"))
