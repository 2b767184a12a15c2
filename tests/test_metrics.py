"""Field-level metrics: hand goldens, NULL prediction, order/duplicate invariance."""

import itertools

from pyspark.sql import functions as F

from fieldmark.functions.metrics import score_columns
from fieldmark.functions.records import REC_DDL

FWD = {"intent": "simulation", "mode": "forward", "product_id": "CRED_IMMO",
       "drivers": [{"entity_key": "DAT", "change": {"type": "absolute", "value": 30.0, "unit": "bps",
                                                    "direction": "increase"}}],
       "targets": ["pnb"], "lever": None, "goal": None, "target": None, "unknown_terms": []}
OTHER = {"intent": "other", "mode": None, "product_id": None, "drivers": None, "targets": None,
         "lever": None, "goal": None, "target": None, "unknown_terms": []}


def score(spark, pairs):
    df = spark.createDataFrame(pairs, f"pred {REC_DDL}, gold {REC_DDL}")
    return [r.asDict() for r in df.select(*score_columns(F.col("pred"), F.col("gold"))).collect()]


def test_null_prediction_vs_forward(spark):
    s = score(spark, [(None, FWD)])[0]
    assert s["intent_correct"] is False and s["mode_correct"] is False and s["product_id_correct"] is False
    assert s["drivers_precision"] == 1.0 and s["drivers_recall"] == 0.0
    assert s["drivers_change_accuracy"] is None
    assert s["targets_precision"] == 1.0 and s["targets_recall"] == 0.0
    assert s["unknown_terms_precision"] == 1.0 and s["unknown_terms_recall"] == 1.0
    assert s["exact_match"] is False


def test_null_prediction_vs_other(spark):
    s = score(spark, [(None, OTHER)])[0]
    assert s["intent_correct"] is False and s["other_recall"] is False
    assert s["mode_correct"] is None and s["product_id_correct"] is True
    assert s["exact_match"] is False


def test_other_ignores_leftover_fields(spark):
    pred = dict(OTHER, mode="forward", product_id="CRED_PME", unknown_terms=["X"])
    gold = dict(OTHER, unknown_terms=["x"])
    assert score(spark, [(pred, gold)])[0]["exact_match"] is True


def test_last_duplicate_wins_and_order_free(spark):
    d1 = {"entity_key": "DAT", "change": {"type": "absolute", "value": 1.0, "unit": "bps", "direction": "increase"}}
    d2 = {"entity_key": "FP", "change": {"type": "relative", "value": 2.0, "unit": "%", "direction": "decrease"}}
    stale = {"entity_key": "DAT", "change": {"type": "absolute", "value": 9.0, "unit": "bps", "direction": "increase"}}
    gold = dict(FWD, drivers=[d1, d2], targets=["pnb", "raroc"])
    pairs = []
    for perm in itertools.permutations([d1, d2]):
        pairs.append((dict(gold, drivers=[stale] + list(perm), targets=["raroc", "pnb", "pnb"]), gold))
    pairs.append((dict(gold, drivers=[d1, d2, stale]), gold))  # stale last: wins
    res = score(spark, pairs)
    assert all(r["exact_match"] for r in res[:-1])
    assert res[-1]["exact_match"] is False
    assert res[-1]["drivers_change_accuracy"] == (0.75 + 1.0) / 2
    for r in res:
        for k, v in r.items():
            if k.endswith(("precision", "recall")) and v is not None:
                assert 0.0 <= v <= 1.0


def test_goal_missing_vs_null_and_nan(spark):
    inv = {"intent": "simulation", "mode": "inverse", "product_id": None, "drivers": None, "targets": None,
           "lever": {"entity_key": "FP"}, "target": "pnb", "unknown_terms": [],
           "goal": {"type": "absolute", "value": float("nan"), "unit": "%", "direction": "increase"}}
    res = score(spark, [(inv, inv), (dict(inv, goal=None), dict(inv, goal=None))])
    assert res[0]["goal_correct"] is False and res[0]["exact_match"] is False  # NaN != NaN
    assert res[1]["goal_correct"] is True and res[1]["exact_match"] is True
