"""Queries P1-P8, P10, P13-P18: raw model output cleaning and record helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.functions.cleaning import (
    empty_prediction, entity_type_of, needs_clarification, normalize_direction,
    normalize_unit, parse_object, strip_reasoning, to_float, type_from_unit, validate_rec,
)
from fieldmark.functions.metrics import model_type
from fieldmark.functions.text import fold_distinct
from fieldmark.operators.clean import clean_outputs
from fieldmark.plans.catalog import register
from fieldmark.plans.oracle_sql import GOLD_CTES, PRED_CTES, cleaned_sql, with_ctes
from fieldmark.sources.fixtures import eval_pairs, gold_records, raw_outputs, surface_samples


def _flat_rec(r: Column) -> list[Column]:
    def chg(c):
        return F.concat_ws(":", F.coalesce(c["type"], F.lit("")),
                           F.coalesce(c["value"].cast("string"), F.lit("")),
                           F.coalesce(c["unit"], F.lit("")), F.coalesce(c["direction"], F.lit("")))

    # sort_array, not array_sort with its comparator: the two differ in where nulls stand, which array_join leaves out
    drivers = F.array_join(F.sort_array(F.transform(r["drivers"], lambda d: F.concat_ws(
        ":", F.coalesce(d["entity_key"], F.lit("")), chg(d["change"])))), "|")
    return [
        r["intent"].alias("intent"), r["mode"].alias("mode"), r["product_id"].alias("product_id"),
        drivers.alias("drivers"),
        F.when(r["drivers"].isNotNull(), F.size(r["drivers"]).cast("long")).alias("n_drivers"),
        F.array_join(F.sort_array(r["targets"]), "|").alias("targets"),
        F.array_join(F.sort_array(r["unknown_terms"]), "|").alias("terms"),
        r["lever"]["entity_key"].alias("lever"),
        F.when(r["goal"].isNotNull(), chg(r["goal"])).alias("goal"),
        r["target"].alias("target"),
    ]


_FLAT_SQL = "intent, mode, product_id, drivers, n_drivers, targets, terms, lever, goal, target"


def _finalized(spark, sf_dir):
    c = clean_outputs(raw_outputs(spark, sf_dir).select("run", "row_id", "raw"), "raw")
    return c.select("run", "row_id", F.struct("pred", "valid", "reject").alias("f"))


@register("p01_strip_reasoning", cleaned_sql("SELECT run, row_id, txt FROM stripped"))
def p01_strip_reasoning(spark, sf_dir):
    """Reasoning blocks removed, Unicode whitespace stripped."""
    return raw_outputs(spark, sf_dir).select("run", "row_id", strip_reasoning(F.col("raw")).alias("txt"))


@register("p02_parse_json", cleaned_sql("SELECT run, row_id, j IS NOT NULL AS parsed FROM parsed"))
def p02_parse_json(spark, sf_dir):
    """Strict parse to a JSON object (arrays, trailing text, broken JSON -> not parsed)."""
    r = raw_outputs(spark, sf_dir)
    return r.select("run", "row_id", parse_object(strip_reasoning(F.col("raw"))).isNotNull().alias("parsed"))


@register("p03_canon_change", cleaned_sql("""
SELECT p.run, d.row_id, d.k AS entity_key, d.cvalue AS value
FROM drv_c d JOIN runs p ON p.r = d.r"""))
def p03_canon_change(spark, sf_dir):
    """Driver change values after canonicalisation (numeric -> magnitude)."""
    f = _finalized(spark, sf_dir)
    d = f.select("run", "row_id", F.explode("f.pred.drivers").alias("d"))
    return d.select("run", "row_id", F.col("d.entity_key").alias("entity_key"),
                    F.col("d.change.value").alias("value"))


@register("p04_flat_to_canonical", cleaned_sql(f"SELECT run, row_id, {_FLAT_SQL} FROM finalized WHERE has_pred"))
def p04_flat_to_canonical(spark, sf_dir):
    """The canonical record of every parsable answer (valid or not)."""
    f = _finalized(spark, sf_dir).where(F.col("f.pred").isNotNull())
    return f.select("run", "row_id", *_flat_rec(F.col("f.pred")))


@register("p05_validate", cleaned_sql("SELECT run, row_id, valid FROM finalized"))
def p05_validate(spark, sf_dir):
    """P5: union validation of the canonical record."""
    return _finalized(spark, sf_dir).select("run", "row_id", F.col("f.valid").alias("valid"))


@register("p06_finalize", cleaned_sql(f"""
SELECT run, row_id, has_pred, valid,
       {', '.join(f'CASE WHEN has_pred THEN {c} END AS {c}' for c in _FLAT_SQL.split(', '))}
FROM finalized"""), headline=True)
def p06_finalize(spark, sf_dir):
    """Raw text -> (prediction or NULL, valid) in one projection."""
    f = _finalized(spark, sf_dir)
    return f.select("run", "row_id", F.col("f.pred").isNotNull().alias("has_pred"),
                    F.col("f.valid").alias("valid"), *_flat_rec(F.col("f.pred")))


@register("p07_needs_clarification", with_ctes(GOLD_CTES, PRED_CTES, select="""
SELECT row_id, CASE WHEN g_intent <> 'simulation' THEN FALSE
                    WHEN g_mode = 'forward' THEN g_product IS NULL OR nd = 0
                    WHEN g_mode = 'inverse' THEN g_product IS NULL OR g_lever IS NULL OR NOT g_has_goal
                                                 OR g_target IS NULL
                    ELSE TRUE END AS needs_clarification
FROM rg WHERE r = 0"""))
def p07_needs_clarification(spark, sf_dir):
    """Gold records that would need a clarification question."""
    g = gold_records(spark, sf_dir)
    return g.select("row_id", needs_clarification(F.col("gold")).alias("needs_clarification"))


@register("p08_entity_type", with_ctes(GOLD_CTES, select="""
SELECT row_id, k AS entity_key,
       CASE WHEN k IN ('DAV', 'DAT', 'MARCHE', 'FP') THEN 'source_financement' ELSE 'driver' END AS entity_type
FROM gold_drivers"""))
def p08_entity_type(spark, sf_dir):
    """Entity type derived from the key of every gold driver."""
    g = gold_records(spark, sf_dir)
    d = g.select("row_id", F.explode("gold.drivers").alias("d"))
    return d.select("row_id", F.col("d.entity_key").alias("entity_key"),
                    entity_type_of(F.col("d.entity_key")).alias("entity_type"))


@register("p10_model_type", with_ctes(GOLD_CTES, PRED_CTES, select="""
SELECT run AS model, CASE WHEN lower(run) LIKE '%nuextract%' THEN 'nuextract'
                          WHEN lower(run) LIKE '%gliner%' THEN 'gliner' ELSE 'llm_generalist' END AS model_type
FROM runs"""))
def p10_model_type(spark, sf_dir):
    """P10: model class from the run name (case-insensitive substring)."""
    runs = eval_pairs(spark, sf_dir).select(F.col("run").alias("model")).distinct()
    return runs.select("model", model_type(F.col("model")).alias("model_type"))


@register("p18_gold_audit", with_ctes(GOLD_CTES, PRED_CTES, select="""
SELECT row_id, 'lever|goal|target' AS reasons FROM rg
WHERE r = 0 AND g_mode = 'inverse' AND g_lever IS NULL"""))
def p18_gold_audit(spark, sf_dir):
    """Gold records that fail the union validation, with the failed checks."""
    g = gold_records(spark, sf_dir).select("row_id", validate_rec(F.col("gold")).alias("r"))
    return g.where(F.size("r") > 0).select("row_id", F.array_join("r", "|").alias("reasons"))


# --- baseline helpers over derived surface strings ------------------------

_SURF_SQL = None  # filled by fieldmark.plans.oracle_sql.surface_sql


def _surface_sql(select: str) -> str:
    from fieldmark.plans.oracle_sql import surface_sql

    return surface_sql(select)


@register("p13_empty_prediction", _surface_sql("""
SELECT count(*) AS n, NULL::VARCHAR AS intent, '' AS drivers, '' AS targets, '' AS terms FROM surfaces"""))
def p13_empty_prediction(spark, sf_dir):
    """The baseline skeleton attached to every sampled line (scalars NULL, lists empty)."""
    s = surface_samples(spark, sf_dir).select(empty_prediction().alias("p"))
    return s.groupBy(F.col("p.intent").alias("intent"),
                     F.array_join("p.drivers.entity_key", "|").alias("drivers"),
                     F.array_join("p.targets", "|").alias("targets"),
                     F.array_join("p.unknown_terms", "|").alias("terms")).agg(F.count(F.lit(1)).alias("n"))


def _folded_counts(samples, col):
    """(col, n, folded): each distinct text with its count, folded once."""
    counted = samples.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return fold_distinct(counted, col, "folded")


@register("p14_type_from_unit", _surface_sql("""
SELECT unit_text, unit, CASE WHEN unit = 'bps' THEN 'absolute' WHEN unit = '%' THEN 'relative' END AS type,
       count(*) AS n FROM surfaces GROUP BY ALL"""))
def p14_type_from_unit(spark, sf_dir):
    """Change type implied by the normalised unit."""
    counted = _folded_counts(surface_samples(spark, sf_dir), "unit_text")
    unit = normalize_unit(F.col("unit_text"), F.col("folded"))
    return counted.select("unit_text", unit.alias("unit"), type_from_unit(unit).alias("type"), "n")


@register("p15_normalize_unit", _surface_sql("SELECT unit_text, unit, count(*) AS n FROM surfaces GROUP BY ALL"))
def p15_normalize_unit(spark, sf_dir):
    """Unit surface -> bps / % / NULL."""
    counted = _folded_counts(surface_samples(spark, sf_dir), "unit_text")
    return counted.select("unit_text", normalize_unit(F.col("unit_text"), F.col("folded")).alias("unit"), "n")


@register("p16_normalize_direction", _surface_sql(
    "SELECT direction_text, direction, count(*) AS n FROM surfaces GROUP BY ALL"))
def p16_normalize_direction(spark, sf_dir):
    """Direction surface -> increase / decrease / NULL."""
    counted = _folded_counts(surface_samples(spark, sf_dir), "direction_text")
    return counted.select("direction_text", normalize_direction(F.col("folded")).alias("direction"), "n")


@register("p17_to_float", _surface_sql("SELECT row_id, line, value_text, value FROM surfaces"))
def p17_to_float(spark, sf_dir):
    """Python float() semantics on value strings (',' -> '.')."""
    s = surface_samples(spark, sf_dir)
    return s.select("row_id", "line", "value_text", to_float(F.col("value_text")).alias("value"))
