"""Queries E1, E6, E8, E11: records assembled from labelled spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators.assembly import UNKNOWN_SPAN_THRESHOLD, assemble_from_spans, spans_of
from fieldmark.plans.catalog import register
from fieldmark.plans.oracle_sql import _fold_sql
from fieldmark.sources.dimensions import (
    DICTIONARY, DIRECTION_DOWN, DIRECTION_UP, KPIS, LEVER_KEYS, SOURCES, UNIT_BPS, UNIT_PCT, dictionary_df,
)
from fieldmark.sources.fixtures import DIRECTION_SAMPLES, UNIT_SAMPLES, order_spans


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SURFACES, _KEYS = [s for s, _ in DICTIONARY], [c for _, c in DICTIONARY]
_LINES = f"""
WITH li AS (
  SELECT l_orderkey AS row_id, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_discount,
    ({_list(_SURFACES)})[CAST(l_partkey % {len(_SURFACES)} AS INTEGER) + 1] AS lever,
    list_contains({_list(SOURCES)}, ({_list(_KEYS)})[CAST(l_partkey % {len(_SURFACES)} AS INTEGER) + 1]) AS is_source,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value,
    ({_list(UNIT_SAMPLES)})[CAST(l_suppkey % {len(UNIT_SAMPLES)} AS INTEGER) + 1] AS unit,
    ({_list(DIRECTION_SAMPLES)})[CAST(l_suppkey % {len(DIRECTION_SAMPLES)} AS INTEGER) + 1] AS direction,
    ({_list(_SURFACES)})[CAST(l_suppkey % {len(_SURFACES)} AS INTEGER) + 1] AS kpi
  FROM lineitem)"""


@register("e01_pivot_by_label", _LINES + """,
p AS (SELECT row_id,
    string_agg(lever, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (is_source) AS sources,
    string_agg(lever, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (NOT is_source) AS drivers,
    string_agg(value, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS vals,
    string_agg(unit, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS units,
    string_agg(direction, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS directions,
    string_agg(kpi, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS kpis FROM li GROUP BY row_id)
SELECT o_orderkey AS row_id, coalesce(sources, '') AS sources, coalesce(drivers, '') AS drivers, coalesce(vals, '') AS vals,
  coalesce(units, '') AS units, coalesce(directions, '') AS directions, coalesce(kpis, '') AS kpis
FROM orders LEFT JOIN p ON p.row_id = o_orderkey""")
def e01_pivot_by_label(spark, sf_dir):
    """Spans split by label, original order kept."""
    labels = {"sources": "source_financement", "drivers": "driver_levier", "vals": "valeur_numerique",
              "units": "unite_variation", "directions": "direction_variation", "kpis": "kpi_cible"}
    return order_spans(spark, sf_dir).select("row_id", *[
        F.array_join(F.transform(spans_of(F.col("spans"), label), lambda s: s["text"]), "|").alias(name)
        for name, label in labels.items()])


@register("e06_unknown_spans", _LINES + """
SELECT row_id, lower('Terme ' || l_returnflag) AS term, count(*) AS n FROM li WHERE l_discount * 8 > 0.4 GROUP BY ALL""")
def e06_unknown_spans(spark, sf_dir):
    """Unknown-term spans above the score threshold, lower-cased."""
    unknown = F.filter(spans_of(F.col("spans"), "terme_inconnu"), lambda s: s["score"] > UNKNOWN_SPAN_THRESHOLD)
    terms = order_spans(spark, sf_dir).select("row_id", F.explode(F.transform(unknown, lambda s: F.lower(s["text"]))).alias("term"))
    return terms.groupBy("row_id", "term").agg(F.count(F.lit(1)).alias("n"))


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _nearest(name: str, value: str, center: str) -> str:
    """CTE: for each lever the candidate with the nearest centre, ties to the earliest."""
    return f"""
{name} AS (SELECT row_id, ord, v FROM (
  SELECT lv.row_id, lv.ord, {value} AS v, row_number() OVER (PARTITION BY lv.row_id, lv.ord
    ORDER BY abs({center} - lv.center), li.l_linenumber, li.l_partkey, li.l_suppkey) AS rn
  FROM lv JOIN li ON li.row_id = lv.row_id) WHERE rn = 1)"""


_BASE = "li.l_linenumber * 100"
_SPAN_RECORD = _LINES + f""",
lv AS (
  SELECT row_id, ({_list(_KEYS)})[CAST(l_partkey % {len(_SURFACES)} AS INTEGER) + 1] AS key,
    l_linenumber * 100 + length(lever) / 2.0 AS center,
    row_number() OVER (PARTITION BY row_id ORDER BY is_source DESC, l_linenumber, l_partkey, l_suppkey) AS ord FROM li),
{_nearest("nv", "li.value", f"({_BASE} + 40 + length(li.value) / 2.0)")},
{_nearest("nu", "li.unit", f"({_BASE} + 46.5)")},
{_nearest("nd", "li.direction", f"({_BASE} + 23.0)")},
drivers AS (
  SELECT lv.row_id, lv.ord, lv.key, nv.v AS value,
    CASE WHEN {_fold_sql("nu.v")} IN {_in(UNIT_BPS)} THEN 'bps'
         WHEN {_fold_sql("nu.v")} IN {_in(UNIT_PCT)} OR contains(nu.v, '%') THEN '%' END AS unit,
    CASE WHEN {_fold_sql("nd.v")} IN {_in(DIRECTION_UP)} THEN 'increase'
         WHEN {_fold_sql("nd.v")} IN {_in(DIRECTION_DOWN)} THEN 'decrease' END AS direction
  FROM lv JOIN nv USING (row_id, ord) JOIN nu USING (row_id, ord) JOIN nd USING (row_id, ord)
  WHERE lv.key IN {_in(LEVER_KEYS)}),
d AS (SELECT row_id, count(*) AS n, string_agg(key || ':' || CASE unit WHEN 'bps' THEN 'absolute' WHEN '%' THEN 'relative' ELSE '' END
    || ':' || value || ':' || coalesce(unit, '') || ':' || coalesce(direction, ''), '|' ORDER BY ord) AS drivers
  FROM drivers GROUP BY row_id),
k AS (SELECT row_id, string_agg(DISTINCT key, '|' ORDER BY key) AS targets FROM (
    SELECT row_id, ({_list(_KEYS)})[CAST(l_suppkey % {len(_SURFACES)} AS INTEGER) + 1] AS key FROM li)
  WHERE key IN {_in(KPIS)} GROUP BY row_id),
u AS (SELECT row_id, string_agg(DISTINCT t, '|' ORDER BY t) AS terms FROM (
    SELECT row_id, lower('Terme ' || l_returnflag) AS t FROM li WHERE l_discount * 8 > 0.4) GROUP BY row_id)
SELECT o_orderkey AS row_id, CASE WHEN x.row_id IS NULL THEN 'other' ELSE 'simulation' END AS intent,
  CASE WHEN x.row_id IS NOT NULL THEN 'forward' END AS mode, CASE WHEN x.row_id IS NOT NULL THEN 'CRED_IMMO' END AS product_id,
  coalesce(d.n, 0) AS n_drivers, coalesce(d.drivers, '') AS drivers, coalesce(k.targets, '') AS targets,
  coalesce(u.terms, '') AS unknown_terms
FROM orders LEFT JOIN (SELECT DISTINCT row_id FROM li) x ON x.row_id = o_orderkey LEFT JOIN d ON d.row_id = o_orderkey
LEFT JOIN k ON k.row_id = o_orderkey LEFT JOIN u ON u.row_id = o_orderkey"""


@register("e08_span_record", _SPAN_RECORD)
def e08_span_record(spark, sf_dir):
    """E8 + E11 (with E2-E7): baseline records from labelled spans."""
    p = assemble_from_spans(order_spans(spark, sf_dir), "row_id", "spans", dictionary_df(spark), fuzzy=True)
    text = lambda x: F.coalesce(x, F.lit(""))
    drivers = F.transform("prediction.drivers", lambda d: F.concat_ws(
        ":", d["entity_key"], text(d["change"]["type"]), text(d["change"]["value"].cast("bigint").cast("string")),
        text(d["change"]["unit"]), text(d["change"]["direction"])))
    return p.select("row_id", F.col("prediction.intent").alias("intent"), F.col("prediction.mode").alias("mode"),
                    F.coalesce(F.array_join(drivers, "|"), F.lit("")).alias("drivers"),
                    F.col("prediction.product_id").alias("product_id"),
                    F.when(F.col("prediction.drivers").isNotNull(), F.size("prediction.drivers")).cast("long").alias("n_drivers"),
                    F.array_join("prediction.targets", "|").alias("targets"),
                    F.array_join("prediction.unknown_terms", "|").alias("unknown_terms"))


@register("e09_loose_record")
def e09_loose_record(spark, sf_dir):
    """E9 + E10 + E11: baseline records from loose extraction JSON (rows-only check;
    tested against a plain-Python post-processing on the small fixture)."""
    from fieldmark.operators.assembly import assemble_from_loose
    from fieldmark.sources.fixtures import loose_outputs

    p = assemble_from_loose(loose_outputs(spark, sf_dir), "row_id", "raw", dictionary_df(spark))
    return p.select("row_id", "valid", "valid_kind", F.col("prediction.intent").alias("intent"),
                    F.col("prediction.product_id").alias("product_id"),
                    F.when(F.col("prediction.drivers").isNotNull(), F.size("prediction.drivers")).cast("long").alias("n_drivers"),
                    F.array_join("prediction.targets", "|").alias("targets"),
                    F.array_join("prediction.unknown_terms", "|").alias("unknown_terms"))
