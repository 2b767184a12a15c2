"""P6 as a DataFrame operator: raw model text -> (prediction, valid, reject reasons).

The work is staged in successive projections so that an answer is parsed and
cast to its fields once per row (Catalyst keeps projections apart when an
expensive expression would otherwise be evaluated several times).  No shuffle, no
Python: the whole operator is a chain of narrow JVM projections.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.cleaning import in_array, is_numeric_type, is_one_value, strip_reasoning, to_float_strict
from fieldmark.functions.json_text import apart
from fieldmark.functions.records import DRIVER_DDL, empty_array, rec
from fieldmark.sources.dimensions import (
    CHANGE_DIRECTIONS, CHANGE_TYPES, CHANGE_UNITS, KPIS, LEVER_KEYS, PRODUCTS,
)

# One cast reads a whole answer: ``string`` is the text of any value, ``binary`` that of a JSON string only (no other value
# casts to it).  So no value is carried on as a VARIANT, which would hold the names of the whole answer.
_CHANGE_DDL = "struct<type:binary,value:double,unit:binary,direction:binary>"
_ANSWER_DDL = ("struct<intent:binary,mode:string,product_id:string,"
               f"drivers:array<struct<entity_key:binary,change:{_CHANGE_DDL}>>,targets:array<string>,"
               f"lever:struct<entity_key:binary>,goal:{_CHANGE_DDL},target:string,unknown_terms:array<binary>>")
#: The change values that are strings.
_VALUES_DDL = "struct<drivers:array<struct<change:struct<value:binary>>>,goal:struct<value:binary>>"


def _text(c: Column) -> Column:
    return c.cast("string")


def _change_struct(c: Column, text: Column) -> Column:
    """Numeric value -> abs; numeric string (its ``text``) parsed, sign kept; NULL unless an object."""
    value = F.when(text.isNotNull(), to_float_strict(_text(text))).otherwise(F.abs(c["value"]))
    return F.when(c.isNotNull(), F.struct(_text(c["type"]).alias("type"), value.alias("value"),
                                          _text(c["unit"]).alias("unit"), _text(c["direction"]).alias("direction")))


def _change_ok(c: Column) -> Column:
    """On a canonical change: a value that is no number and no text of one is NULL there."""
    return F.coalesce(
        c["type"].isin(*CHANGE_TYPES) & c["value"].isNotNull() & c["unit"].isin(*CHANGE_UNITS)
        & c["direction"].isin(*CHANGE_DIRECTIONS), F.lit(False))


def not_iterable(v: Column) -> Column:
    """True for a non-zero number or ``true``: what a loop over the field cannot take (0 and ``false`` count as empty)."""
    number = F.schema_of_variant(v)
    return F.when(_list_kind(v) == "OTHER", F.coalesce(
        (is_numeric_type(number) | (number == "BOOLEAN")) & (F.try_variant_get(v, "$", "double") != 0), F.lit(False))
    ).otherwise(F.lit(False))


def _list_kind(v: Column) -> Column:
    """'VOID' for absent/null, 'ARRAY' for an array, else 'OTHER' (no nested type name built)."""
    return (F.when(v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False)), F.lit("VOID"))
            .when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.lit("ARRAY"))
            .otherwise(F.lit("OTHER")))


def clean_outputs(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Add ``pred`` (Rec or NULL), ``valid`` and ``reject`` (failed checks) to ``df``.

    Semantics: reasoning blocks removed; strict JSON object or NULL;
    ``intent == 'other'`` -> ``{other, []}`` (valid); anything else becomes a
    simulation with lowercased unknown terms (a non-string term fails the row);
    forward keeps object drivers with canonical changes, inverse keeps lever /
    goal / target, any other mode is invalid; validation checks every enum.
    """
    keep, c = df.columns, F.col
    s1 = df.select(*keep, in_array(strip_reasoning(F.col(raw_col))).alias("_w"))
    # in a lambda: the code generated to copy these structs is too long for a method that is compiled, with it all of the row's
    s2 = s1.select(*keep, "_w", apart(c("_w"), lambda w: F.struct(
        F.when(is_one_value(w), F.try_variant_get(w, "$[0]", _ANSWER_DDL)).alias("a"),
        F.try_variant_get(w, "$[0]", _VALUES_DDL).alias("v"))).alias("_r"))

    def given(name: str) -> Column:
        """The field is there and not null; asked only where it is not of its kind."""
        return F.try_variant_get("_w", f"$[0].{name}", "string").isNotNull()

    a, v = c("_r.a"), c("_r.v")
    number = F.try_variant_get("_w", "$[0].drivers", "binary").isNull() & F.coalesce(
        F.try_variant_get("_w", "$[0].drivers", "double") != 0, F.lit(False))
    s3 = s2.select(
        *keep, a.isNotNull().alias("_parsed"), F.coalesce(_text(a["intent"]) == "other", F.lit(False)).alias("_other"),
        F.coalesce(a["mode"] == "forward", F.lit(False)).alias("_fwd"),
        F.coalesce(a["mode"] == "inverse", F.lit(False)).alias("_inv"),
        *[a[k].alias(f"_{k}") for k in ("mode", "product_id", "target")],
        (a["targets"].isNotNull() | ~given("targets")).alias("_targets_list"),
        F.coalesce(a["targets"], empty_array("string")).alias("_targets"),
        (a["unknown_terms"].isNotNull() | ~given("unknown_terms")).alias("_terms_list"),
        F.coalesce(a["unknown_terms"], empty_array("binary")).alias("_terms"),
        # what a loop over the drivers cannot take: a non-zero number or true
        (a["drivers"].isNull() & number).alias("_drivers_bad"),
        F.coalesce(F.filter(F.transform(a["drivers"], lambda d, i: F.when(d.isNotNull(), F.struct(
            _text(d["entity_key"]).alias("entity_key"),
            _change_struct(d["change"], F.get(v["drivers"], i)["change"]["value"]).alias("change")))),
            lambda d: d.isNotNull()), empty_array(DRIVER_DDL)).alias("_drivers"),
        (a["lever"].isNotNull() | given("lever")).alias("_lever_given"), _text(a["lever"]["entity_key"]).alias("_lever"),
        _change_struct(a["goal"], v["goal"]["value"]).alias("_goal"),
    )
    # a text of an enum is no other value's text, so none of these needs the kind of the value
    among = lambda x, values: F.coalesce(x.isin(*values), F.lit(False))
    product_ok = c("_product_id").isNull() | c("_product_id").isin(*PRODUCTS)
    drivers_ok = F.forall(c("_drivers"), lambda d: among(d["entity_key"], LEVER_KEYS) & _change_ok(d["change"]))
    targets_ok = c("_targets_list") & F.forall(c("_targets"), lambda t: among(t, KPIS))
    s4 = s3.select(
        *[x for x in s3.columns if x not in ("_targets_list", "_terms_list", "_terms")],
        (c("_terms_list") & ~F.exists(c("_terms"), lambda t: t.isNull())).alias("_terms_ok"),
        (c("_fwd") & c("_drivers_bad")).alias("_drivers_fail"),
        product_ok.alias("_product_ok"), F.when(c("_fwd"), drivers_ok).alias("_drivers_ok"),
        F.when(c("_fwd"), targets_ok).alias("_targets_ok"), among(c("_lever"), LEVER_KEYS).alias("_lever_ok"),
        _change_ok(c("_goal")).alias("_goal_ok"), among(c("_target"), KPIS).alias("_target_ok"),
        F.transform(c("_terms"), lambda t: F.lower(_text(t))).alias("_unknown_terms"))

    def why(name: str, cond: Column, ok: Column) -> Column:
        return F.when(cond & ~ok, F.lit(name))

    reject = F.filter(F.array(
        why("product_id", F.lit(True), c("_product_ok")),
        why("drivers", c("_fwd"), c("_drivers_ok")), why("targets", c("_fwd"), c("_targets_ok")),
        why("lever", c("_inv"), c("_lever_ok")), why("goal", c("_inv"), c("_goal_ok")), why("target", c("_inv"), c("_target_ok")),
        F.when(~c("_fwd") & ~c("_inv"), F.lit("mode"))), lambda x: x.isNotNull())
    all_ok = c("_product_ok") & F.when(c("_fwd"), c("_drivers_ok") & c("_targets_ok")).when(
        c("_inv"), c("_lever_ok") & c("_goal_ok") & c("_target_ok")).otherwise(F.lit(False))
    other, sim = c("_other"), ~c("_other")
    none = empty_array("string")
    lost = ~c("_parsed") | (sim & (~c("_terms_ok") | c("_drivers_fail")))
    # a field at a time: a record in a CASE is copied whole
    pred = rec(
        intent=F.when(other, F.lit("other")).otherwise(F.lit("simulation")),
        mode=F.when(sim, c("_mode")), product_id=F.when(sim, c("_product_id")),
        drivers=F.when(sim & c("_fwd"), c("_drivers")), targets=F.when(sim & c("_fwd"), c("_targets")),
        lever=F.when(sim & c("_inv") & c("_lever_given"), F.struct(c("_lever").alias("entity_key"))),
        goal=F.when(sim & c("_inv"), c("_goal")), target=F.when(sim & c("_inv"), c("_target")),
        unknown_terms=F.when(other, none).otherwise(c("_unknown_terms")))
    out = s4.select(
        *keep, F.when(~lost, pred).alias("pred"), (~lost & (other | all_ok)).alias("valid"),
        F.when(~c("_parsed"), F.array(F.lit("unparsable"))).when(other, none)
         .when(~c("_terms_ok"), F.array(F.lit("unknown_terms")))
         .when(c("_drivers_fail"), F.array(F.lit("drivers"))).when(all_ok, none).otherwise(reject).alias("reject"),
    )
    # Row/valid counters.  The metrics node also keeps later filters (and the
    # filters Catalyst infers for explode) above it: pushed below, they would
    # inline the whole record expression and evaluate it a second time.
    return out.observe(f"clean_outputs_{uuid.uuid4().hex[:8]}",
                       F.count(F.lit(1)).alias("rows"), F.count_if(F.col("valid")).alias("valid_rows"))
