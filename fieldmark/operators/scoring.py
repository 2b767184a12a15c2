"""Per-example scoring (C16) as one narrow projection over evaluation pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.metrics import gold_type, schema_valid, score_columns


def score_pairs(pairs: DataFrame, pred_col: str = "prediction", gold_col: str = "gold") -> DataFrame:
    """Add every metric, ``schema_valid`` and the gold ``type`` to each pair.

    Input: ``run, row_id, text, gold, prediction, valid_json, latency_s`` (extra
    columns are kept).  No shuffle: the plan stays one codegen stage.
    """
    from fieldmark.functions.records import drivers_last_wins

    pred, gold = F.col(pred_col), F.col(gold_col)
    keep = pairs.columns
    # stage 1: one entry per driver key (last duplicate wins), computed once per row
    staged = pairs.select(*keep, drivers_last_wins(pred["drivers"]).alias("_pd"),
                          drivers_last_wins(gold["drivers"]).alias("_gd"))
    p2 = F.col(pred_col).withField("drivers", F.col("_pd"))
    g2 = F.col(gold_col).withField("drivers", F.col("_gd"))
    return staged.select(
        *keep,
        *score_columns(p2, g2, dedup=False),
        schema_valid(F.col("valid_json"), pred).alias("schema_valid"),
        gold_type(gold).alias("type"),
    )


def details_quant(scored: DataFrame) -> DataFrame:
    """S4 (precision bench): row_id, text, type, gold, prediction, exact_match, schema_valid."""
    return scored.select("run", "row_id", "text", "type", "gold", "prediction", "exact_match", "schema_valid")
