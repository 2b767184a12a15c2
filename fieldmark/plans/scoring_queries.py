"""Queries C1-C16: per-example metrics over the evaluation pairs (F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.functions.metrics import (
    METRIC_FIELDS, lower_terms, prf,
)
from fieldmark.functions.records import drivers_last_wins
from fieldmark.operators.scoring import score_pairs
from fieldmark.plans.catalog import register
from fieldmark.plans.oracle_sql import scored_sql, with_ctes, GOLD_CTES, PRED_CTES, SCORE_CTES
from fieldmark.sources.fixtures import eval_pairs


def scored(spark, sf_dir):
    return score_pairs(eval_pairs(spark, sf_dir))


def _metric_query(key: str, cols: list[str]):
    sql = scored_sql(f"SELECT run, row_id, {', '.join(cols)} FROM scored")

    @register(key, sql)
    def q(spark, sf_dir):
        return scored(spark, sf_dir).select("run", "row_id", *cols)

    q.__doc__ = f"{key}: per-example {', '.join(cols)}"
    return q


@register("c01_set_prf", with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, select="""
SELECT p.run, p.row_id,
  CASE WHEN coalesce(tn.np, 0) = 0 THEN 1.0 ELSE coalesce(tt.tp, 0) / CAST(tn.np AS DOUBLE) END AS set_precision,
  CASE WHEN coalesce(tg.ng, 0) = 0 THEN 1.0 ELSE coalesce(tt.tp, 0) / CAST(tg.ng AS DOUBLE) END AS set_recall
FROM pred p
LEFT JOIN tgt_tp tt ON tt.r = p.r AND tt.row_id = p.row_id
LEFT JOIN tgt_np tn ON tn.r = p.r AND tn.row_id = p.row_id
LEFT JOIN tgt_ng tg ON tg.row_id = p.row_id"""))
def c01_set_prf(spark, sf_dir):
    """C1 on the target sets of every pair, whatever the gold branch."""
    ep = eval_pairs(spark, sf_dir)
    p, r = prf(F.col("prediction.targets"), F.col("gold.targets"))
    return ep.select("run", "row_id", p.alias("set_precision"), r.alias("set_recall"))


@register("c02_drivers_by_key", with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, select="""
SELECT p.run, d.row_id, d.k AS entity_key, d.ctype AS type, d.cvalue AS value, d.cunit AS unit,
       d.cdir AS direction
FROM pd_last d JOIN runs p ON p.r = d.r"""))
def c02_drivers_by_key(spark, sf_dir):
    """Last duplicate wins, one row per (run, example, key)."""
    ep = eval_pairs(spark, sf_dir)
    d = ep.select("run", "row_id", F.explode(drivers_last_wins(F.col("prediction.drivers"))).alias("d"))
    return d.select("run", "row_id", F.col("d.entity_key").alias("entity_key"),
                    F.col("d.change.type").alias("type"), F.col("d.change.value").alias("value"),
                    F.col("d.change.unit").alias("unit"), F.col("d.change.direction").alias("direction"))


@register("c03_norm_terms", with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, select="""
SELECT p.run, p.row_id, coalesce(x.terms, '') AS terms, coalesce(x.n, 0) AS n_terms
FROM pred p LEFT JOIN (SELECT r, row_id, string_agg(u, '|' ORDER BY u) AS terms, count(*) AS n
                       FROM pu GROUP BY r, row_id) x ON x.r = p.r AND x.row_id = p.row_id"""))
def c03_norm_terms(spark, sf_dir):
    """Lowercase set of the predicted unknown terms."""
    ep = eval_pairs(spark, sf_dir)
    t = F.array_sort(lower_terms(F.col("prediction.unknown_terms")))
    return ep.select("run", "row_id", F.array_join(t, "|").alias("terms"), F.size(t).cast("long").alias("n_terms"))


_metric_query("c04_intent_correct", ["intent_correct"])
_metric_query("c05_other_recall", ["other_recall"])
_metric_query("c06_mode_correct", ["mode_correct"])
_metric_query("c07_product_id_correct", ["product_id_correct"])
_metric_query("c08_drivers_prf", ["drivers_precision", "drivers_recall"])
_metric_query("c09_change_accuracy", ["drivers_change_accuracy"])
_metric_query("c10_targets_prf", ["targets_precision", "targets_recall"])
_metric_query("c11_lever_correct", ["lever_correct"])
_metric_query("c12_goal_correct", ["goal_correct"])
_metric_query("c13_target_correct", ["target_correct"])
_metric_query("c14_unknown_terms_prf", ["unknown_terms_precision", "unknown_terms_recall"])
_metric_query("c15_exact_match", ["exact_match"])
_metric_query("c16_score_example", METRIC_FIELDS + ["exact_match"])
_metric_query("p11_schema_valid", ["schema_valid"])


@register("p09_gold_type", scored_sql("SELECT run, row_id, gtype AS type FROM scored"))
def p09_gold_type(spark, sf_dir):
    """Other -> 'other', else the gold mode."""
    return scored(spark, sf_dir).select("run", "row_id", "type")


@register("p12_latency_censoring", scored_sql("SELECT run, row_id, latency_s FROM scored"))
def p12_latency_censoring(spark, sf_dir):
    """Latency forced to 0.0 when the prediction is NULL."""
    return eval_pairs(spark, sf_dir).select("run", "row_id", "latency_s")


@register("j01_examples_results_by_id", with_ctes(GOLD_CTES, PRED_CTES, select="""
SELECT p.run, count(g.row_id) AS matched,
       (SELECT count(*) FROM gold) - count(g.row_id) AS missing,
       count(*) - count(g.row_id) AS orphans
FROM pred p LEFT JOIN gold g ON g.row_id = p.row_id GROUP BY p.run"""))
def j01_examples_results_by_id(spark, sf_dir):
    """Results joined to examples on row_id (never by position).

    ``missing`` = examples without a result in the run, ``orphans`` = results
    whose row_id is not an example.
    """
    from fieldmark.sources.fixtures import gold_records

    ex = gold_records(spark, sf_dir).select("row_id")
    res = eval_pairs(spark, sf_dir).select("run", "row_id")
    hit = res.join(ex.select("row_id", F.lit(True).alias("_hit")), "row_id", "left")
    total = ex.select(F.count(F.lit(1))).scalar()
    matched = F.count_if(F.col("_hit").isNotNull())
    return hit.groupBy("run").agg(
        matched.alias("matched"),
        (total - matched).alias("missing"),
        F.count_if(F.col("_hit").isNull()).alias("orphans"))
