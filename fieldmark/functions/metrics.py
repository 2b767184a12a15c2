"""Field-level metrics of one prediction against its gold record.

Each function maps Columns of type ``Rec`` to a Column, so ``score_columns``
evaluates every metric of a row in one narrow projection (no shuffle).
A NULL prediction behaves like an empty record: scalars NULL, lists empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.functions.records import (
    DRIVER_DDL, change_eq_count, canonical, driver_keys, drivers_last_wins, empty_array, has_nan_value,
    lower_terms,
)


def set_size(arr: Column) -> Column:
    return F.size(F.array_distinct(arr))


def prf(pred_arr: Column, gold_arr: Column):
    """(precision, recall) of two sets; empty prediction -> P=1, empty gold -> R=1."""
    p = F.coalesce(pred_arr, empty_array("string"))
    g = F.coalesce(gold_arr, empty_array("string"))
    tp = F.size(F.array_intersect(p, g)).cast("double")
    np_, ng = set_size(p), set_size(g)
    precision = F.when(np_ == 0, F.lit(1.0)).otherwise(tp / np_)
    recall = F.when(ng == 0, F.lit(1.0)).otherwise(tp / ng)
    return precision, recall


def intent_correct(pred: Column, gold: Column) -> Column:
    return pred["intent"].eqNullSafe(gold["intent"])


def other_recall(pred: Column, gold: Column) -> Column:
    return F.when(gold["intent"] == "other", pred["intent"].eqNullSafe(F.lit("other")))


def mode_correct(pred: Column, gold: Column) -> Column:
    return F.when(gold["intent"] == "simulation", pred["mode"].eqNullSafe(gold["mode"]))


def product_id_correct(pred: Column, gold: Column) -> Column:
    return pred["product_id"].eqNullSafe(gold["product_id"])


def _is_forward(gold: Column) -> Column:
    return F.coalesce(gold["mode"] == "forward", F.lit(False))


def _is_inverse(gold: Column) -> Column:
    return F.coalesce(gold["mode"] == "inverse", F.lit(False))


def drivers_prf(pred: Column, gold: Column, dedup: bool = True):
    """precision/recall of driver keys (forward gold only)."""
    p, r = prf(driver_keys(pred["drivers"], dedup), driver_keys(gold["drivers"], dedup))
    fwd = _is_forward(gold)
    return F.when(fwd, p), F.when(fwd, r)


def _drivers(r: Column, dedup: bool) -> Column:
    return drivers_last_wins(r["drivers"]) if dedup else F.coalesce(r["drivers"], empty_array(DRIVER_DDL))


def drivers_change_accuracy(pred: Column, gold: Column, dedup: bool = True) -> Column:
    """Mean share of equal change sub-fields over matched keys; NULL if none matched."""
    pd, gd = _drivers(pred, dedup), _drivers(gold, dedup)
    pairs = F.transform(pd, lambda d: F.struct(
        d["change"].alias("pc"), F.filter(gd, lambda g: g["entity_key"].eqNullSafe(d["entity_key"])).alias("g")))
    shares = F.transform(pairs, lambda x: F.when(
        F.size(x["g"]) > 0, change_eq_count(x["pc"], F.get(x["g"], 0)["change"]) / 4.0))
    mean = F.aggregate(
        shares, F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")),
        lambda acc, v: F.when(v.isNull(), acc).otherwise(
            F.struct((acc["total"] + v).alias("total"), (acc["n"] + 1).alias("n"))),
        lambda acc: F.when(acc["n"] > 0, acc["total"] / acc["n"]))
    # equal drivers need no pairs, unless a value is NaN, which equals nothing
    nan = F.exists(pd, lambda d: F.coalesce(F.isnan(d["change"]["value"]), F.lit(False)))
    same = (F.size(pd) > 0) & pd.eqNullSafe(gd) & ~nan
    return F.when(_is_forward(gold), F.when(same, F.lit(1.0)).otherwise(mean))


def targets_prf(pred: Column, gold: Column):
    """precision/recall of target KPIs (forward gold only)."""
    p, r = prf(pred["targets"], gold["targets"])
    fwd = _is_forward(gold)
    return F.when(fwd, p), F.when(fwd, r)


def lever_correct(pred: Column, gold: Column) -> Column:
    return F.when(_is_inverse(gold), pred["lever"]["entity_key"].eqNullSafe(gold["lever"]["entity_key"]))


def goal_correct(pred: Column, gold: Column) -> Column:
    """Whole-struct equality; NULL goal equals NULL goal; NaN never equal."""
    nan = F.coalesce(F.isnan(pred["goal"]["value"]), F.lit(False))
    return F.when(_is_inverse(gold), pred["goal"].eqNullSafe(gold["goal"]) & ~nan)


def target_correct(pred: Column, gold: Column) -> Column:
    return F.when(_is_inverse(gold), pred["target"].eqNullSafe(gold["target"]))


def unknown_terms_prf(pred: Column, gold: Column):
    """C14: precision/recall of lowercased unknown terms (always computed)."""
    return prf(lower_terms(pred["unknown_terms"]), lower_terms(gold["unknown_terms"]))


def exact_match(pred: Column, gold: Column, dedup: bool = True) -> Column:
    """Deep equality of the branch-dependent canonical forms, which equal records share."""
    same = F.when(pred.eqNullSafe(gold), F.lit(True)).otherwise(canonical(pred, dedup).eqNullSafe(canonical(gold, dedup)))
    return same & ~has_nan_value(pred)


METRIC_FIELDS = [
    "intent_correct", "other_recall", "mode_correct", "product_id_correct",
    "drivers_precision", "drivers_recall", "drivers_change_accuracy",
    "targets_precision", "targets_recall",
    "lever_correct", "goal_correct", "target_correct",
    "unknown_terms_precision", "unknown_terms_recall",
]


def score_columns(pred: Column, gold: Column, dedup: bool = True) -> list[Column]:
    """Every per-example metric, aliased, in a stable order.

    ``dedup=False`` when both drivers arrays already hold one entry per key
    (last duplicate kept), as ``score_pairs`` arranges once per row.
    """
    dp, dr = drivers_prf(pred, gold, dedup)
    tp, tr = targets_prf(pred, gold)
    up, ur = unknown_terms_prf(pred, gold)
    return [
        intent_correct(pred, gold).alias("intent_correct"),
        other_recall(pred, gold).alias("other_recall"),
        mode_correct(pred, gold).alias("mode_correct"),
        product_id_correct(pred, gold).alias("product_id_correct"),
        dp.alias("drivers_precision"),
        dr.alias("drivers_recall"),
        drivers_change_accuracy(pred, gold, dedup).alias("drivers_change_accuracy"),
        tp.alias("targets_precision"),
        tr.alias("targets_recall"),
        lever_correct(pred, gold).alias("lever_correct"),
        goal_correct(pred, gold).alias("goal_correct"),
        target_correct(pred, gold).alias("target_correct"),
        up.alias("unknown_terms_precision"),
        ur.alias("unknown_terms_recall"),
        exact_match(pred, gold, dedup).alias("exact_match"),
    ]


def schema_valid(valid_json: Column, prediction: Column) -> Column:
    """Valid flag AND a prediction is present."""
    return F.coalesce(valid_json, F.lit(False)) & prediction.isNotNull()


def gold_type(gold: Column) -> Column:
    """Other -> 'other', else the gold mode (may be NULL)."""
    return F.when(gold["intent"] == "other", F.lit("other")).otherwise(gold["mode"])


def model_type(run: Column) -> Column:
    """P10: case-insensitive name test: nuextract, then gliner, else llm_generalist."""
    low = F.lower(run)
    return (F.when(low.contains("nuextract"), F.lit("nuextract"))
            .when(low.contains("gliner"), F.lit("gliner"))
            .otherwise(F.lit("llm_generalist")))
