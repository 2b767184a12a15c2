"""Cleaning and validation of raw model output (P1-P8, P13-P17) as column expressions.

Raw text is parsed into Spark's VARIANT (``try_parse_json``), so a record
whose ``drivers`` array holds one malformed element keeps its other elements
(``from_json`` would null the whole array).  Everything is JVM-side.

Known differences with Python's ``json.loads`` (counted, not hidden): objects
with duplicate keys and non-finite numbers (``NaN``) do not parse in Spark;
such rows come out as unparsable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.functions.records import DRIVER_DDL, empty_array, null_of, rec
from fieldmark.sources.dimensions import (
    CHANGE_DIRECTIONS, CHANGE_TYPES, CHANGE_UNITS, DIRECTION_DOWN, DIRECTION_UP, KPIS,
    LEVER_KEYS, PRODUCTS, SOURCES, UNIT_BPS, UNIT_PCT,
)

# Python's str.strip() whitespace: Unicode White_Space plus the C0 separators 0x1c-0x1f.
_WS = "[\\s\\x1c-\\x1f]"
NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: Unicode-aware, unlike SQL ``trim``."""
    # most texts begin and end with a byte of no white space and need no search
    ends = [F.substring(c.cast("binary"), at, 1) for at in (1, -1)]
    plain = [(e > F.lit(b" ")) & (e < F.lit(b"\x80")) for e in ends]
    return F.when(plain[0] & plain[1], c).otherwise(F.regexp_replace(c, f"(?U)^{_WS}+|{_WS}+$", ""))


def strip_reasoning(raw: Column) -> Column:
    """Remove every ``<think>...</think>`` block (non-greedy, across lines), then strip."""
    return py_strip(F.when(raw.contains("<think>"), F.regexp_replace(raw, "(?s)<think>.*?</think>", "")).otherwise(raw))


def vtype(v: Column, path: str = "$") -> Column:
    """Variant type name at ``path`` (``OBJECT<..>``, ``STRING``, ``VOID`` ...); NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_numeric_type(t: Column) -> Column:
    return t.isin(*NUMERIC_TYPES) | t.startswith("DECIMAL")


def in_array(text: Column) -> Column:
    """``text`` parsed in an array before a mark, as VARIANT or NULL."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"@end"]')))


def is_one_value(wrapped: Column) -> Column:
    """Whether the text of ``in_array`` is one JSON value."""
    return (F.coalesce(F.try_variant_get(wrapped, "$[1]", "string") == "@end", F.lit(False))
            & F.try_variant_get(wrapped, "$[2]", "variant").isNull())


def parse_object(text: Column) -> Column:
    """The JSON object in ``text`` as VARIANT, or NULL.

    The text stands in an array before a mark: the parser reads that far only
    if the text is one value, so trailing values and junk, which a bare
    ``try_parse_json`` would accept, lose the mark.
    """
    wrapped = in_array(text)
    brace = F.ltrim(text, F.lit(" \t\r\n")).startswith("{")  # of a value that parses: an object
    return F.when(is_one_value(wrapped) & brace, F.try_variant_get(wrapped, "$[0]", "variant"))


def null_of_rec() -> Column:
    from fieldmark.functions.records import REC_DDL

    return null_of(REC_DDL)


def needs_clarification(r: Column) -> Column:
    """Not simulation -> false; forward: no product or no drivers; inverse: a field missing."""
    fwd = (F.coalesce(r["product_id"].isNull(), F.lit(True))
           | (F.coalesce(F.size(r["drivers"]), F.lit(0)) == 0))
    inv = (r["product_id"].isNull() | r["lever"].isNull() | r["goal"].isNull()
           | F.coalesce(r["target"] == "", r["target"].isNull()))
    return (F.when(F.coalesce(r["intent"], F.lit("")) != "simulation", F.lit(False))
            .when(r["mode"] == "forward", fwd)
            .when(r["mode"] == "inverse", inv)
            .otherwise(F.lit(True)))


def entity_type_of(key: Column) -> Column:
    """A funding source key -> 'source_financement', any other key -> 'driver'."""
    return F.when(F.coalesce(key.isin(*SOURCES), F.lit(False)), F.lit("source_financement")).otherwise(F.lit("driver"))


# --- baseline helpers (P13-P17) -------------------------------------------

def empty_prediction() -> Column:
    """Baseline skeleton, scalars NULL and lists empty."""
    return rec(drivers=empty_array(DRIVER_DDL), targets=empty_array("string"),
               unknown_terms=empty_array("string"))


def type_from_unit(unit: Column) -> Column:
    """Bps -> absolute, % -> relative, else NULL."""
    return F.when(unit == "bps", F.lit("absolute")).when(unit == "%", F.lit("relative"))


def normalize_unit(text: Column, folded: Column) -> Column:
    """Folded exact membership; the raw text containing '%' also means percent."""
    return (F.when(folded.isin(*UNIT_BPS), F.lit("bps"))
            .when(folded.isin(*UNIT_PCT) | F.coalesce(text.contains("%"), F.lit(False)), F.lit("%")))


def normalize_direction(folded: Column) -> Column:
    """Folded exact membership in the up / down word lists."""
    return (F.when(folded.isin(*DIRECTION_UP), F.lit("increase"))
            .when(folded.isin(*DIRECTION_DOWN), F.lit("decrease")))


# Python float() syntax after stripping: sign, digits with single '_' between
# digits, optional fraction and exponent, or inf / infinity / nan.
_DIGITS = "[0-9](?:_?[0-9])*"
_FLOAT_RE = (f"^[+-]?(?:(?:{_DIGITS}(?:\\.(?:{_DIGITS})?)?|\\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
             "|(?i:inf|infinity|nan))$")


def to_float_strict(s: Column) -> Column:
    """Python ``float(str)`` semantics: regex-validated, then ``try_cast``.

    Spark alone would accept ``'10d'`` / ``'5f'`` and reject ``'1_000'``.
    """
    t = py_strip(s)
    ok = F.coalesce(t.rlike(_FLOAT_RE), F.lit(False))
    return F.when(ok, F.regexp_replace(t, "_", "").try_cast("double"))


def to_float(value: Column) -> Column:
    """``str(v)``, ',' -> '.', strip, parse; anything else NULL."""
    return to_float_strict(F.regexp_replace(value.cast("string"), ",", "."))


def _change_struct_ok(c: Column) -> Column:
    return F.coalesce(
        c["type"].isin(*CHANGE_TYPES) & c["value"].isNotNull() & c["unit"].isin(*CHANGE_UNITS)
        & c["direction"].isin(*CHANGE_DIRECTIONS), F.lit(False))


def validate_rec(r: Column) -> Column:
    """P5 on an already typed record: array of failed checks (empty = valid)."""
    other = F.coalesce(r["intent"] == "other", F.lit(False))
    fwd = F.coalesce(r["mode"] == "forward", F.lit(False))
    inv = F.coalesce(r["mode"] == "inverse", F.lit(False))
    checks = [
        ("intent", F.coalesce(r["intent"] == "simulation", F.lit(False)), F.lit(True)),
        ("product_id", r["product_id"].isNull() | F.coalesce(r["product_id"].isin(*PRODUCTS), F.lit(False)),
         F.lit(True)),
        ("drivers", r["drivers"].isNotNull() & F.forall(F.coalesce(r["drivers"], empty_array(DRIVER_DDL)), lambda d: F.coalesce(
            d["entity_key"].isin(*LEVER_KEYS), F.lit(False)) & _change_struct_ok(d["change"])), fwd),
        ("targets", r["targets"].isNotNull() & F.forall(F.coalesce(r["targets"], empty_array("string")), lambda t: F.coalesce(
            t.isin(*KPIS), F.lit(False))), fwd),
        ("lever", F.coalesce(r["lever"]["entity_key"].isin(*LEVER_KEYS), F.lit(False)), inv),
        ("goal", _change_struct_ok(r["goal"]), inv),
        ("target", F.coalesce(r["target"].isin(*KPIS), F.lit(False)), inv),
        ("unknown_terms", r["unknown_terms"].isNotNull(), F.lit(True)),
        ("mode", fwd | inv, F.lit(True)),
    ]
    reasons = F.filter(F.array(*[F.when(cond & ~ok, F.lit(name)) for name, ok, cond in checks]),
                       lambda x: x.isNotNull())
    return F.when(other, F.array().cast("array<string>")).otherwise(reasons)
