"""Inputs derived deterministically from the driver tables.

The evaluated dataset itself is not shipped, so gold records, runs and
predictions are derived from ``orders``/``lineitem``/``part`` with integer
arithmetic and CASE only.  The same derivation is written independently as SQL
in ``fieldmark.plans.oracle_sql`` for the DuckDB check.

Scale notes
-----------
* Driver lines are reduced per order with nine conditional ``max``
  aggregates (one per lever key), so the aggregation buffer per order is
  bounded by the closed world and partial aggregation happens map-side even
  when one order holds a large share of the lines.  Buffers hold the columns
  of a line only; records are built from them after the shuffle.
* Targets are a bit set over six KPI keys: bounded the same way.
* Unknown terms need part names; only lines passing the discount filter are
  joined to ``part`` and the join strategy is left to AQE (``part`` grows with
  the data, so it is never force-broadcast).
* The three per-order results are all hash-partitioned on the order key, so
  joining them with ``orders`` shuffles ``orders`` only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.json_text import apart
from fieldmark.functions.records import (
    DRIVER_DDL, change, empty_array, null_of, rec,
)
from fieldmark.sources.dimensions import KPIS, LEVER_KEYS

# Runs of the evaluation fixture, in ordinal order.
EVAL_RUNS = [
    "Qwen3-8B",
    "gemma-3-12b-it",
    "gemma-3-12b-it-Q8",
    "Mistral-Small-24B-Q8",
    "Mistral-Small-24B-Q4",
    "NuExtract-2.0",
    "GLiNER-large",
]

TERM_DISCOUNT = 0.085


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _pick_of_line(values: list, key: Column) -> Column:
    """The value a line's key picks; a line without the key has the last one, before a shuffle and after it."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.coalesce((key % len(values) + 1).cast("int"), F.lit(-1)))


def _line_of(o: Column) -> dict[str, Column]:
    """Lever key, KPI and change of a line, from the columns of ``lineitem``, which ``o`` names."""
    ctype = F.when(o["l_returnflag"] == "N", "relative").otherwise("absolute")
    unit = F.when(o["l_returnflag"] == "A", "bps").otherwise("%")
    direction = F.when(o["l_linestatus"] == "O", "increase").otherwise("decrease")
    return {"lever_key": _pick_of_line(LEVER_KEYS, o["l_partkey"]), "kpi": _pick_of_line(KPIS, o["l_suppkey"]),
            "chg": change(ctype, o["l_quantity"], unit, direction)}


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: last change per lever key, target KPI set, first line.

    A line's change, lever key and KPI follow from the columns that order it, so each buffer holds one line's columns
    and what follows from them is made after the shuffle; the KPIs seen are a bit set.
    """
    o = F.struct(*[F.col(c) for c in (
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")])
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), o.alias("o"),
        _pick_of_line(list(range(len(LEVER_KEYS))), F.col("l_partkey")).alias("lever"),
        _pick_of_line([1 << i for i in range(len(KPIS))], F.col("l_suppkey")).alias("kpi"))
    aggs = [F.max(F.when(F.col("lever") == i, F.col("o"))).alias(f"k{i}") for i in range(len(LEVER_KEYS))]
    per_order = lines.groupBy("row_id").agg(*aggs, F.bit_or("kpi").alias("kpis"), F.min("o").alias("first"))
    drivers = F.filter(
        F.array(*[
            F.when(F.col(f"k{i}").isNotNull(), F.struct(
                F.lit(k).alias("entity_key"), _line_of(F.col(f"k{i}"))["chg"].alias("change")))
            for i, k in sorted(enumerate(LEVER_KEYS), key=lambda x: x[1])
        ]),
        lambda d: d.isNotNull(),
    )
    targets = F.filter(
        F.array(*[F.when(F.col("kpis").bitwiseAND(1 << i) != 0, F.lit(k))
                  for i, k in sorted(enumerate(KPIS), key=lambda x: x[1])]),
        lambda k: k.isNotNull(),
    )
    first = _line_of(F.col("first"))
    return per_order.select(
        "row_id",
        drivers.alias("drivers"),
        targets.alias("targets"),
        F.struct(*[first[c].alias(c) for c in ("lever_key", "chg", "kpi")]).alias("first_line"),
    )


def order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), "l_partkey", "l_discount")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (lines.filter(F.col("l_discount") > TERM_DISCOUNT).join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("row_id").agg(F.array_sort(F.collect_set("p_name")).alias("terms")))


PRIORITY_PRODUCT = {
    "1-URGENT": "CRED_IMMO", "2-HIGH": "CRED_CONSO", "3-MEDIUM": "CRED_PME",
    "5-LOW": "CRED_PME",
}


def gold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 gold side: ``(row_id, text, gold Rec)``; one row per order."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_orderstatus", "o_orderpriority")
    parts = order_parts(spark, sf_dir)
    terms = order_terms(spark, sf_dir)
    j = o.join(parts, "row_id", "left").join(terms, "row_id", "left")
    status = F.col("o_orderstatus")
    product = F.lit(None).cast("string")
    for k, v in PRIORITY_PRODUCT.items():
        product = F.when(F.col("o_orderpriority") == k, F.lit(v)).otherwise(product)
    terms_c = F.coalesce(F.col("terms"), empty_array("string"))
    first = F.col("first_line")
    forward = rec(
        intent=F.lit("simulation"), mode=F.lit("forward"), product_id=product,
        drivers=F.coalesce(F.col("drivers"), empty_array(DRIVER_DDL)),
        targets=F.coalesce(F.col("targets"), empty_array("string")),
        unknown_terms=terms_c,
    )
    inverse = rec(
        intent=F.lit("simulation"), mode=F.lit("inverse"), product_id=product,
        lever=F.when(first.isNotNull(), F.struct(first["lever_key"].alias("entity_key"))),
        goal=first["chg"], target=first["kpi"], unknown_terms=terms_c,
    )
    other = rec(intent=F.lit("other"), unknown_terms=empty_array("string"))
    gold = F.when(status == "O", forward).when(status == "F", inverse).otherwise(other)
    text = F.concat(F.lit("commande "), F.col("row_id").cast("string"), F.lit(" "),
                    F.col("o_orderpriority"), F.lit(" "), status)
    return j.select("row_id", text.alias("text"), gold.alias("gold"))


# ---------------------------------------------------------------------------
# Per-run predictions
# ---------------------------------------------------------------------------

_PRODUCT_SWAP = {"CRED_IMMO": "CRED_CONSO", "CRED_CONSO": "CRED_PME", "CRED_PME": None}


def _swap_product(p: Column) -> Column:
    out = F.lit("CRED_IMMO")  # NULL -> CRED_IMMO
    for k, v in _PRODUCT_SWAP.items():
        out = F.when(p == k, F.lit(v).cast("string")).otherwise(out)
    return out


def _with(r: Column, **fields: Column) -> Column:
    out = r
    for k, v in fields.items():
        out = out.withField(k, v)
    return out


def _flip_direction(c: Column) -> Column:
    return c.withField("direction", F.when(c["direction"] == "increase", "decrease").otherwise("increase"))


def _prediction(g: Column, h: Column, r: int) -> tuple[Column, Column]:
    """Perturbed prediction and raw validity flag of run ordinal ``r`` for row ``h``."""
    fwd = g["mode"] == "forward"
    inv = g["mode"] == "inverse"
    oth = g["intent"] == "other"
    drv = g["drivers"]
    n = F.size(drv)
    valid = F.lit(True)
    null_rec = null_of(g_ddl())
    if r == 0:
        pred = F.when(h % 50 == 7, null_rec).otherwise(g)
    elif r == 1:
        p = _with(g, product_id=F.when(fwd | inv, F.when(h % 4 == 1, _swap_product(g["product_id"]))
                                       .otherwise(g["product_id"])))
        p = _with(p, unknown_terms=F.when(h % 3 == 0, F.transform(g["unknown_terms"], lambda t: F.upper(t)))
                  .otherwise(g["unknown_terms"]))
        pred = p
        valid = ~(h % 30 == 11)
    elif r == 2:
        d1 = F.when(fwd & (h % 5 == 2) & (n > 0), F.slice(drv, 1, F.greatest(n - 1, F.lit(0)))).otherwise(drv)
        d2 = F.when(fwd & (h % 7 == 4),
                    F.transform(d1, lambda d: d.withField("change", d["change"].withField(
                        "value", d["change"]["value"] + 1.0)))).otherwise(d1)
        t = F.when(fwd & (h % 6 == 3),
                   F.array_union(g["targets"], F.array(F.lit("pnb")))).otherwise(g["targets"])
        pred = F.when(h % 40 == 0, null_rec).otherwise(_with(g, drivers=d2, targets=t))
    elif r == 3:
        as_fwd = rec(intent=F.lit("simulation"), mode=F.lit("forward"),
                     drivers=empty_array(DRIVER_DDL), targets=empty_array("string"),
                     unknown_terms=empty_array("string"))
        # a field at a time: a record in a CASE is written out once for each of its fields
        p = _with(g, mode=F.when(fwd & (h % 9 == 1), F.lit("inverse")).otherwise(g["mode"]),
                  goal=F.when(inv & (h % 4 == 0) & g["goal"].isNotNull(), _flip_direction(g["goal"])).otherwise(g["goal"]),
                  lever=F.when(inv & (h % 6 == 5), F.struct(F.lit("FP").alias("entity_key"))).otherwise(g["lever"]))
        pred = F.when(oth & (h % 5 == 0), as_fwd).otherwise(p)
    elif r == 4:
        first = F.get(drv, 0)
        stale = F.struct(first["entity_key"].alias("entity_key"),
                         _flip_direction(first["change"]).alias("change"))
        d = F.when(fwd & (n > 0) & (h % 3 == 1), F.concat(drv, F.array(stale))) \
             .when(fwd & (n > 0) & (h % 3 == 2), F.concat(F.array(stale), drv)).otherwise(drv)
        tg = F.when(inv & (h % 5 == 3), F.lit("pnb")).otherwise(g["target"])
        pred = _with(g, drivers=d, target=tg)
    elif r == 5:
        empty_other = rec(intent=F.lit("other"), drivers=empty_array(DRIVER_DDL),
                          targets=empty_array("string"), unknown_terms=empty_array("string"))
        p = F.when(inv | oth, empty_other).otherwise(
            _with(g, unknown_terms=F.when(h % 2 == 0, empty_array("string")).otherwise(g["unknown_terms"])))
        pred = p
    else:
        empty_other = rec(intent=F.lit("other"), drivers=empty_array(DRIVER_DDL),
                          targets=empty_array("string"), unknown_terms=empty_array("string"))
        t = F.when(h % 3 == 0, empty_array("string")).otherwise(g["targets"])
        u = F.when(h % 4 == 0, F.array_union(g["unknown_terms"], F.array(F.lit("livret a")))) \
             .otherwise(g["unknown_terms"])
        pred = F.when(inv | oth, empty_other).otherwise(_with(g, targets=t, unknown_terms=u))
    return pred, valid


def g_ddl() -> str:
    from fieldmark.functions.records import REC_DDL
    return REC_DDL


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, row_id, text, gold, prediction, valid_json, latency_s)``.

    Runs are generated with ``explode`` over a fixed 7-element array (a bounded
    fan-out, not a join); the perturbation is a per-row projection.
    """
    g = gold_records(spark, sf_dir)
    x = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(EVAL_RUNS) - 1))).alias("r"))
    h = F.col("row_id")
    pred, valid = F.lit(None).cast(g_ddl()), F.lit(False)
    for r in range(len(EVAL_RUNS)):
        p_r, v_r = _prediction(F.col("gold"), h, r)
        pred = F.when(F.col("r") == r, p_r).otherwise(pred)
        valid = F.when(F.col("r") == r, v_r).otherwise(valid)
    x = x.select("r", "row_id", "text", "gold", pred.alias("prediction"), valid.alias("v"))
    lat = (((h * 31 + F.col("r") * 17) % 997).cast("double") / 100.0 + F.col("r").cast("double") * 0.25)
    out = x.select(
        _pick(EVAL_RUNS, F.col("r")).alias("run"),
        "row_id", "text", "gold", "prediction",
        (F.col("v") & F.col("prediction").isNotNull()).alias("valid_json"),
        F.when(F.col("prediction").isNull(), F.lit(0.0)).otherwise(lat).alias("latency_s"),
    )
    # Metrics node: also stops Catalyst from inlining the per-run CASE into
    # every field access of downstream operators.
    return out.observe(f"eval_pairs_{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("pairs"))


# ---------------------------------------------------------------------------
# raw model outputs (JSON text with realistic defects)
# ---------------------------------------------------------------------------

RAW_CASES = 12
THINK_PREFIX = "<think>Je réfléchis.\nLe levier est clair.</think>\n"
UNCLOSED_PREFIX = "<think>hmm "
TRAILING_TEXT = " Voilà."


def _q(s: Column) -> Column:
    return F.concat(F.lit('"'), s, F.lit('"'))


def _jstr(s: Column) -> Column:
    return F.when(s.isNull(), F.lit("null")).otherwise(_q(s))


def _num(v: Column, neg: Column, as_str: Column) -> Column:
    t = v.cast("bigint").cast("string")
    t = F.when(neg, F.concat(F.lit("-"), t)).otherwise(t)
    return F.when(as_str, _q(t)).otherwise(t)


def _change_json(c: Column, neg: Column, as_str: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(
        F.lit('{"type": '), _jstr(c["type"]), F.lit(', "value": '), _num(c["value"], neg, as_str),
        F.lit(', "unit": '), _jstr(c["unit"]), F.lit(', "direction": '), _jstr(c["direction"]), F.lit("}")))


def _str_list(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda t: _q(t)), ", "), F.lit("]"))


def raw_parts(g: Column) -> Column:
    """The texts of a gold record that its answers are put together from, whatever the run."""
    def changes(neg: bool, as_str: bool) -> tuple[Column, Column]:
        neg, as_str = F.lit(neg), F.lit(as_str)
        drivers = F.array_join(F.transform(g["drivers"], lambda d: F.concat(
            F.lit('{"entity_key": '), _q(d["entity_key"]), F.lit(', "change": '),
            _change_json(d["change"], neg, as_str), F.lit("}"))), ", ")
        return drivers, _change_json(g["goal"], neg, as_str)

    lever = F.when(g["lever"].isNull(), F.lit("null")).otherwise(
        F.concat(F.lit('{"entity_key": '), _jstr(g["lever"]["entity_key"]), F.lit("}")))
    texts = {}
    for kind, flags in {"": (False, False), "_neg": (True, False), "_str": (False, True)}.items():
        texts[f"drivers{kind}"], texts[f"goal{kind}"] = changes(*flags)
    return F.struct(
        (g["mode"] == "forward").alias("fwd"), (g["mode"] == "inverse").alias("inv"), (g["intent"] == "other").alias("oth"),
        _jstr(g["intent"]).alias("intent"), _jstr(g["mode"]).alias("mode"), _jstr(g["product_id"]).alias("product_id"),
        (F.size(g["drivers"]) > 0).alias("any_drivers"), *[c.alias(k) for k, c in texts.items()],
        _str_list(g["targets"]).alias("targets"), lever.alias("lever"), _jstr(g["target"]).alias("target"),
        _str_list(g["unknown_terms"]).alias("terms"),
        _str_list(F.transform(g["unknown_terms"], lambda t: F.upper(t))).alias("terms_upper"))


def render_raw(p: Column, case: Column) -> Column:
    """Render a gold record's ``raw_parts`` as the flat JSON a model would emit, with defect ``case``."""
    fwd, inv, oth = p["fwd"], p["inv"], p["oth"]
    of_case = lambda k: F.when(case == 4, p[f"{k}_neg"]).when(case == 5, p[f"{k}_str"]).otherwise(p[k])
    drivers = F.when(case == 9, F.concat(F.lit('42, "x"'), F.when(p["any_drivers"], F.lit(", "))
                                         .otherwise(F.lit("")), p["drivers"])).otherwise(of_case("drivers"))
    terms = F.when(case == 8, p["terms_upper"]).otherwise(p["terms"])
    intent = F.when(case == 7, F.lit("")).otherwise(F.concat(F.lit('"intent": '), p["intent"], F.lit(", ")))
    mode = F.when(case == 6, F.lit('"sideways"')).otherwise(p["mode"])
    sim_body = F.concat(
        F.lit("{"), intent, F.lit('"mode": '), mode,
        F.lit(', "product_id": '), p["product_id"],
        F.lit(', "drivers": '), F.when(fwd, F.concat(F.lit("["), drivers, F.lit("]"))).otherwise(F.lit("null")),
        F.lit(', "targets": '), F.when(fwd, p["targets"]).otherwise(F.lit("null")),
        F.lit(', "lever": '), F.when(inv, p["lever"]).otherwise(F.lit("null")),
        F.lit(', "goal": '), F.when(inv, of_case("goal")).otherwise(F.lit("null")),
        F.lit(', "target": '), F.when(inv, p["target"]).otherwise(F.lit("null")),
        F.lit(', "unknown_terms": '), terms, F.lit("}"))
    other_body = F.when(case == 8, F.lit(
        '{"intent": "other", "mode": "forward", "product_id": "CRED_IMMO", "drivers": [], '
        '"unknown_terms": ["reste"]}')).otherwise(F.concat(
            F.lit("{"), intent, F.lit('"mode": '), mode, F.lit(', "product_id": null, "drivers": null, '
                                                               '"targets": null, "lever": null, "goal": null, '
                                                               '"target": null, "unknown_terms": []}')))
    body = F.when(oth, other_body).otherwise(sim_body)
    return (F.when(case == 1, F.concat(F.lit(THINK_PREFIX), body))
            .when(case == 2, body.substr(F.lit(1), F.length(body) - 1))
            .when(case == 3, F.concat(F.lit("["), body, F.lit("]")))
            .when(case == 10, F.concat(body, F.lit(TRAILING_TEXT)))
            .when(case == 11, F.concat(F.lit(UNCLOSED_PREFIX), body))
            .otherwise(body))


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, row_id, text, gold, raw)`` — one raw model answer per run and example."""
    g = gold_records(spark, sf_dir).select("*", raw_parts(F.col("gold")).alias("parts"))
    x = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(EVAL_RUNS) - 1))).alias("r"))
    case = ((F.col("row_id") * 7 + F.col("r")) % RAW_CASES).cast("int")
    # the lambda keeps this projection out of the stage's one generated method, which the answers make too long to be compiled
    run = apart(F.col("r"), lambda r: _pick(EVAL_RUNS, r))
    return x.select(run.alias("run"), "row_id", "text", "gold", render_raw(F.col("parts"), case).alias("raw"))


# ---------------------------------------------------------------------------
# Surface strings for the baseline helpers (units, directions, values)
# ---------------------------------------------------------------------------

# Test vocabulary (our own): spellings a span extractor may return.
UNIT_SAMPLES = ["bps", " BPS ", "Points de base", "point de base", "pdb", "bp", "%", "10 %", "pct",
                "Pourcentage", "pourcent", "percent", "basis points", "", "pourcentâge", "Bps."]
DIRECTION_SAMPLES = ["hausse", "Hausse", " baisse ", "augmentation", "diminue", "réduire", "+", "-",
                     "en hausse", "monte", "increase", "DECREASE", "baisser", "stable", "Diminution", "hausser"]


def surface_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit, direction and value string per lineitem, chosen from its keys."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("bigint").cast("string")
    k = F.col("l_partkey") % 8
    value = (F.when(k == 0, F.col("l_quantity").cast("string"))
             .when(k == 1, F.regexp_replace(F.col("l_discount").cast("string"), "\\.", ","))
             .when(k == 2, F.concat(F.lit(" "), q, F.lit(" ")))
             .when(k == 3, F.concat(q, F.lit(" bps")))
             .when(k == 4, F.concat(q, F.lit("d")))
             .when(k == 5, F.concat(F.lit("1_"), q))
             .when(k == 6, F.concat(F.lit("-"), F.col("l_tax").cast("string")))
             .otherwise(F.lit("abc")))
    return li.select(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").cast("long").alias("line"),
        _pick(UNIT_SAMPLES, F.col("l_partkey") % len(UNIT_SAMPLES)).alias("unit_text"),
        _pick(DIRECTION_SAMPLES, F.col("l_suppkey") % len(DIRECTION_SAMPLES)).alias("direction_text"),
        value.alias("value_text"))


# ---------------------------------------------------------------------------
# spans to link against the dictionary
# ---------------------------------------------------------------------------

SPAN_VARIANTS = 10


def _surfaces() -> list[str]:
    from fieldmark.sources.dimensions import DICTIONARY

    return [s for s, _ in DICTIONARY]


def link_spans(spans_src: DataFrame) -> DataFrame:
    """Derive a span per row from ``(row_id, line, a, b, c)`` integer keys."""
    surf = _surfaces()
    base = _pick(surf, F.col("a") % len(surf))
    other = _pick(surf, F.col("c") % len(surf))
    L = F.length(base)
    half = (L / 2).cast("int")
    v = F.col("b") % SPAN_VARIANTS
    span = (F.when(v == 0, base)
            .when(v == 1, F.upper(base))
            .when(v == 2, F.concat(F.lit("le "), base, F.lit(" total")))
            .when(v == 3, F.substring(base, 1, F.greatest(F.lit(4), L - 3)))
            .when(v == 4, F.concat(F.substring(base, 1, half), F.lit("x"), F.substring(base, half + 2, 1000)))
            .when(v == 5, F.regexp_replace(base, "e", "é"))
            .when(v == 6, F.concat(base, F.lit("s")))
            .when(v == 7, F.concat(F.lit("la "), base))
            .when(v == 8, F.concat(base, F.lit(" et "), other))
            .otherwise(F.substring(base, 2, 3)))
    return spans_src.select("row_id", "line", span.alias("span"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one span per lineitem ``(row_id, line, span)``."""
    li = table(spark, sf_dir, "lineitem")
    src = li.select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").cast("long").alias("line"),
                    F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("c"))
    return link_spans(src)


# ---------------------------------------------------------------------------
# F8: a model-file manifest derived from ``part`` (for the file choice rule)
# ---------------------------------------------------------------------------

QUANT_TAGS = ["Q8_0", "Q4_K_M", "Q5_K_M", "BF16"]
WANTED_TAGS = ["Q8_0", "Q4_K_M"]


def model_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(repo, file)``: one or two (sharded) files per part, some auxiliary or not GGUF."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    stem = F.concat(F.when(k % 11 == 0, F.lit("mmproj-")).otherwise(F.lit("")),
                    F.regexp_replace(F.col("p_name"), " ", "-"), F.lit("-"), F.col("p_type"), F.lit("-"),
                    _pick(QUANT_TAGS, k % len(QUANT_TAGS)),
                    F.when(k % 13 == 0, F.lit("-MTP")).otherwise(F.lit("")))
    shards = F.when(F.col("p_size") % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    x = p.select(F.concat(F.lit("org/"), F.col("p_brand")).alias("repo"), stem.alias("stem"), k.alias("k"),
                 F.explode(shards).alias("shard"))
    ext = F.when(F.col("k") % 17 == 0, F.lit(".bin")).otherwise(F.lit(".gguf"))
    name = F.concat(F.col("stem"), F.when(F.col("shard") > 0, F.format_string("-%05d-of-00002", F.col("shard")))
                    .otherwise(F.lit("")), ext)
    return x.select("repo", F.concat(F.lit("weights/"), name).alias("file"))


# ---------------------------------------------------------------------------
# labelled spans per order (a span extractor's output)
# ---------------------------------------------------------------------------

def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, spans array<struct<text,label,start,end,score>>)`` per order (an order without lines has none).

    Each line contributes a lever span (dictionary surface of its lever key's
    family), a value, a unit, a direction, a KPI span and a low- or
    high-score unknown-term span; positions follow the line number.
    """
    from fieldmark.sources.dimensions import DICTIONARY, SOURCES

    surf = [s for s, _ in DICTIONARY]
    def span(text, lab, start, ln, score):
        return F.struct(text.alias("text"), lab.alias("label"), start.cast("int").alias("start"),
                        (start + ln).cast("int").alias("end"), score.alias("score"))

    def line_spans(line: Column) -> Column:
        base, k, sk, q = line["l_linenumber"] * 100, line["l_partkey"], line["l_suppkey"], line["q"]
        lever_text = _pick_of_line(surf, k)
        lever_key_guess = _pick_of_line([c for _, c in DICTIONARY], k)
        label = F.when(lever_key_guess.isin(*SOURCES), F.lit("source_financement")).otherwise(F.lit("driver_levier"))
        return F.array(
            span(lever_text, label, base, F.length(lever_text), F.lit(0.9)),
            span(q, F.lit("valeur_numerique"), base + 40, F.length(q), F.lit(0.8)),
            span(_pick_of_line(UNIT_SAMPLES, sk), F.lit("unite_variation"), base + 45, F.lit(3), F.lit(0.7)),
            span(_pick_of_line(DIRECTION_SAMPLES, sk), F.lit("direction_variation"),
                 base + 20, F.lit(6), F.lit(0.7)),
            span(_pick_of_line(surf, sk), F.lit("kpi_cible"), base + 60, F.lit(10), F.lit(0.6)),
            span(F.concat(F.lit("Terme "), line["l_returnflag"]), F.lit("terme_inconnu"), base + 80, F.lit(7),
                 line["l_discount"] * 8),
        )

    # lines are gathered by the columns that their spans come from, and the spans made after the shuffle
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").cast("string").alias("q"),
        "l_returnflag", "l_discount").alias("line"))
    prod = F.array(F.struct(F.lit("crédit immobilier").alias("text"), F.lit("produit_credit").alias("label"),
                            F.lit(0).alias("start"), F.lit(17).alias("end"), F.lit(0.9).alias("score")))
    g = lines.groupBy("row_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    g = g.select("row_id", F.concat(prod, F.flatten(F.transform("lines", line_spans))).alias("spans"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    none = F.array().cast(g.schema["spans"].dataType)
    return orders.join(g, "row_id", "left").select("row_id", F.coalesce("spans", none).alias("spans"))


# ---------------------------------------------------------------------------
# loose extraction JSON (an extractor's product / drivers / targets output)
# ---------------------------------------------------------------------------

# Test vocabulary (our own): product mentions.
PRODUCT_MENTIONS = {"CRED_IMMO": "Crédit immobilier", "CRED_CONSO": "prêt perso", "CRED_PME": "crédit pro"}


def _first_surface() -> dict:
    from fieldmark.sources.dimensions import DICTIONARY

    out = {}
    for s, c in DICTIONARY:
        if " " in s:
            out.setdefault(c, s)
    for s, c in DICTIONARY:
        out.setdefault(c, s)
    return out


def loose_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, raw)``: loose JSON per order rendered from its gold record, with defects."""
    g = gold_records(spark, sf_dir)
    fs = _first_surface()
    h = F.col("row_id")

    def mention(key: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, v in fs.items():
            out = F.when(key == k, F.lit(v)).otherwise(out)
        return out

    prod = F.lit("")
    for k, v in PRODUCT_MENTIONS.items():
        prod = F.when(F.col("gold.product_id") == k, F.lit(v)).otherwise(prod)
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    drivers = F.transform(F.coalesce(F.col("gold.drivers"), F.array().cast(f"array<{DRIVER_DDL}>")), lambda d: F.concat(
        F.lit('{"entity": '), q(mention(d["entity_key"])),
        F.lit(', "value": '),
        F.when(h % 3 == 0, d["change"]["value"].cast("bigint").cast("string"))
         .when(h % 3 == 1, q(F.concat(d["change"]["value"].cast("bigint").cast("string"), F.lit(",5"))))
         .otherwise(F.lit('"10 bps"')),
        F.lit(', "unit": '), q(F.when(d["change"]["unit"] == "bps", F.lit("points de base")).otherwise("pourcent")),
        F.lit(', "direction": '), q(F.when(d["change"]["direction"] == "increase", "hausse").otherwise("baisse")),
        F.lit("}")))
    drivers = F.when(h % 5 == 0, F.concat(drivers, F.array(F.lit(
        '{"entity": "livret A", "value": 1, "unit": "%", "direction": "+"}')))).otherwise(drivers)
    drivers = F.when(h % 17 == 0, F.concat(F.array(F.lit("42")), drivers)).otherwise(drivers)
    targets = F.transform(F.coalesce(F.col("gold.targets"), F.array().cast("array<string>")),
                          lambda t: F.when(h % 2 == 0, q(mention(t)))
                          .otherwise(F.concat(F.lit('{"entity": '), q(mention(t)), F.lit("}"))))
    body = F.concat(F.lit('{"product": '), q(prod), F.lit(', "drivers": ['), F.array_join(drivers, ", "),
                    F.lit('], "targets": ['), F.array_join(targets, ", "), F.lit("]}"))
    raw = F.when(h % 13 == 0, body.substr(F.lit(1), F.length(body) - 2)).otherwise(body)
    return g.select("row_id", raw.alias("raw"))
