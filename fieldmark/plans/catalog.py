"""Registry of the queries the driver runs, each with its DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables.  Outputs
are flat (no arrays or structs) and doubles are rounded to 9 digits, so the
Spark result and the oracle can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

# Double-typed output columns of the queries that have an oracle: both sides round them to
# 9 digits (and turn -0.0 into 0.0).  tests/test_operators.py checks this list against the
# Spark schemas.
ROUND9 = {
    'a01_metric_means': ['intent_correct', 'other_recall', 'mode_correct', 'product_id_correct', 'drivers_precision', 'drivers_recall', 'drivers_change_accuracy', 'targets_precision', 'targets_recall', 'lever_correct', 'goal_correct', 'target_correct', 'unknown_terms_precision', 'unknown_terms_recall'],
    'a02_rates': ['exact_match_rate', 'schema_valid_rate'],
    'a03_latency_median': ['latency_median_s'],
    'a04_latency_p95': ['latency_p95_s'],
    'a07_merged_partials': ['intent_correct', 'other_recall', 'mode_correct', 'product_id_correct', 'drivers_precision', 'drivers_recall', 'drivers_change_accuracy', 'targets_precision', 'targets_recall', 'lever_correct', 'goal_correct', 'target_correct', 'unknown_terms_precision', 'unknown_terms_recall', 'exact_match_rate', 'schema_valid_rate', 'latency_median_s', 'latency_p95_s'],
    'a07_run_summary': ['intent_correct', 'other_recall', 'mode_correct', 'product_id_correct', 'drivers_precision', 'drivers_recall', 'drivers_change_accuracy', 'targets_precision', 'targets_recall', 'lever_correct', 'goal_correct', 'target_correct', 'unknown_terms_precision', 'unknown_terms_recall', 'exact_match_rate', 'schema_valid_rate', 'latency_median_s', 'latency_p95_s'],
    'a08_class_means': ['exact_match_rate', 'schema_valid_rate'],
    'c01_set_prf': ['set_precision', 'set_recall'],
    'c02_drivers_by_key': ['value'],
    'c08_drivers_prf': ['drivers_precision', 'drivers_recall'],
    'c09_change_accuracy': ['drivers_change_accuracy'],
    'c10_targets_prf': ['targets_precision', 'targets_recall'],
    'c14_unknown_terms_prf': ['unknown_terms_precision', 'unknown_terms_recall'],
    'c16_score_example': ['drivers_precision', 'drivers_recall', 'drivers_change_accuracy', 'targets_precision', 'targets_recall', 'unknown_terms_precision', 'unknown_terms_recall'],
    'p03_canon_change': ['value'],
    'p12_latency_censoring': ['latency_s'],
    'p17_to_float': ['value'],
    's02_read_predictions': ['latency_total'],
    's03_prediction_files': ['latency_total'],
    's04_details_files': ['drivers_recall', 'unknown_terms_precision'],
    's05_summary_csv': ['intent_correct', 'other_recall', 'mode_correct', 'product_id_correct', 'drivers_precision', 'drivers_recall', 'drivers_change_accuracy', 'targets_precision', 'targets_recall', 'lever_correct', 'goal_correct', 'target_correct', 'unknown_terms_precision', 'unknown_terms_recall', 'exact_match_rate', 'schema_valid_rate', 'latency_median_s', 'latency_p95_s'],
    's05_summary_csv_order': ['exact_match_rate'],
    'w01_leaderboard': ['exact_match_rate'],
    'w06_precision_rows': ['exact_match_rate', 'latency_median_s', 'previous_em', 'step_points'],
    'w06_precision_impact': ['first_em', 'last_em', 'delta_points'],
}


QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def register(key: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat_output(fn(spark, sf_dir))

        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        QUERIES[key] = wrapped
        if sql is not None:
            ORACLES[key] = rounded_sql(sql, ROUND9.get(key, []))
        if headline:
            HEADLINE.append(key)
        return wrapped

    return deco


def rounded_sql(sql: str, cols: list[str]) -> str:
    """Wrap an oracle so its double columns are rounded exactly like ``flat_output``."""
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, 9) + CAST(0.0 AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _oracle"


def flat_output(df: DataFrame) -> DataFrame:
    """Round doubles to 9 digits, -0.0 -> 0.0 (both sides of the oracle check do the same)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), 9) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from fieldmark.plans import (  # noqa: F401
        scoring_queries, summary_queries, cleaning_queries, linking_queries,
        assembly_queries, assembly_spans_queries, prompt_queries, report_queries, source_queries,
    )
