"""JSON text as Python's ``json.dumps(.., ensure_ascii=False)`` writes it, built in the JVM.

``to_json`` uses another layout (no spaces, upper-case escapes, Java's floats); files and reports that are compared
byte by byte need this one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.functions.records import DRIVER_DDL, branch_of, empty_array

_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPES |= {chr(c): f"\\u{c:04x}" for c in range(32) if chr(c) not in _ESCAPES}


def apart(value: Column, f) -> Column:
    """``f`` of a value, as one lambda: evaluated once, and kept out of the code that is generated for the row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _escaped(s: Column) -> Column:
    for char, text in _ESCAPES.items():  # the backslash first
        s = F.replace(s, F.lit(char), F.lit(text))
    return s


def string_text(s: Column) -> Column:
    """json.dumps of a string or None, non-ASCII kept."""
    text = F.when(s.rlike('[\\x00-\\x1F"\\\\]'), apart(s, _escaped)).otherwise(s)
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def _shortest(text: Column) -> Column:
    """Java before 19 may give more digits than say the number: of these the fewest that do."""
    for places in (16, 15):
        short = F.regexp_replace(F.upper(F.format_string(f"%.{places}e", text.cast("double"))), r"E\+?(-?)0*(\d+)$", "E$1$2")
        short = F.regexp_replace(short, r"(\.\d+?)0*E", "$1E")
        many = F.length(F.regexp_replace(text, r"E.*|[^0-9]", "")) >= 17
        text = F.when(many & (short.try_cast("double") == text.cast("double")), short).otherwise(text)
    return text


def _without_e(text: Column) -> Column:
    """Python's form of a float that Java writes with an exponent: one below 1e-4 and from 1e16 on, else none."""
    size = F.abs(text.cast("double"))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E-(\d)$", "e-0$1"), "E-", "e-")
    digits = F.regexp_replace(F.regexp_replace(digits, r"E(\d)$", "e+0$1"), "E", "e+")
    whole = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0*$", "$1")
    return F.when((size >= 1e-4) & (size < 1e16), whole).otherwise(digits)


def number_text(v: Column) -> Column:
    """json.dumps of a float or None."""
    text = v.cast("string")
    return F.coalesce(F.when(text.contains("E"), apart(apart(text, _shortest), _without_e)).otherwise(text), F.lit("null"))


def change_text(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(
        F.lit('{"type": '), string_text(c["type"]), F.lit(', "value": '), number_text(c["value"]),
        F.lit(', "unit": '), string_text(c["unit"]), F.lit(', "direction": '), string_text(c["direction"]), F.lit("}")))


def list_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, string_text), ", "), F.lit("]"))


def dict_text(items: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(items, lambda x: F.concat(
        F.when(x["k"].isNull(), F.lit('"null"')).otherwise(string_text(x["k"])), F.lit(": "), change_text(x["c"]))), ", "), F.lit("}"))


def bool_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def object_text(fields: list[tuple[str, Column]]) -> Column:
    """An object of these keys and JSON texts; a null text leaves its key out."""
    parts = [F.concat(F.lit(f'"{k}": '), text) for k, text in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def record_text(r: Column) -> Column:
    """A record with the keys of its branch only; null for a null record."""
    branch, base = branch_of(r), [("intent", string_text(r["intent"])), ("mode", string_text(r["mode"])),
                                  ("product_id", string_text(r["product_id"]))]
    terms = ("unknown_terms", list_text(F.coalesce(r["unknown_terms"], empty_array("string"))))
    drivers = F.transform(F.coalesce(r["drivers"], empty_array(DRIVER_DDL)), lambda d: object_text([
        ("entity_key", string_text(d["entity_key"])), ("change", change_text(d["change"]))]))
    forward = base + [("drivers", F.concat(F.lit("["), F.array_join(drivers, ", "), F.lit("]"))),
                      ("targets", list_text(F.coalesce(r["targets"], empty_array("string")))), terms]
    lever = F.when(r["lever"].isNull(), F.lit("null")).otherwise(object_text([("entity_key", string_text(r["lever"]["entity_key"]))]))
    inverse = base + [("lever", lever), ("goal", change_text(r["goal"])), ("target", string_text(r["target"])), terms]
    return F.when(r.isNotNull(), F.when(branch == "other", object_text([base[0], terms]))
                  .when(branch == "forward", object_text(forward)).when(branch == "inverse", object_text(inverse))
                  .otherwise(object_text(base + [terms])))


def variant_number_text(v: Column) -> Column:
    """A number of a VARIANT: whole ones as they stand, others as floats."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "BIGINT", F.try_variant_get(v, "$", "string")).when(
        (kind == "DOUBLE") | kind.startswith("DECIMAL"), number_text(F.try_variant_get(v, "$", "double"))).otherwise(F.lit("null"))


def variant_record_text(v: Column) -> Column:
    """A record held as VARIANT with the keys of its branch only; unlike ``record_text`` it keeps whole numbers whole."""
    def text(of: Column, path: str) -> Column:
        return string_text(F.try_variant_get(of, path, "string"))

    def change(of: Column) -> Column:
        return F.when(of.isNull() | F.is_variant_null(of), F.lit("null")).otherwise(object_text([
            ("type", text(of, "$.type")), ("value", F.coalesce(variant_number_text(F.try_variant_get(of, "$.value", "variant")), F.lit("null"))),
            ("unit", text(of, "$.unit")), ("direction", text(of, "$.direction"))]))

    def listed(path: str, item) -> Column:
        items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
        return F.concat(F.lit("["), F.array_join(F.transform(items, item), ", "), F.lit("]"))

    def one(x: Column) -> Column:
        return text(x, "$")

    intent, mode = F.try_variant_get(v, "$.intent", "string"), F.try_variant_get(v, "$.mode", "string")
    base = [("intent", string_text(intent)), ("mode", string_text(mode)), ("product_id", text(v, "$.product_id"))]
    terms = ("unknown_terms", listed("$.unknown_terms", one))
    driver = lambda d: object_text([
        ("entity_key", text(d, "$.entity_key")), ("change", change(F.try_variant_get(d, "$.change", "variant")))])
    lever = F.try_variant_get(v, "$.lever.entity_key", "string")
    inverse = base + [("lever", F.when(lever.isNull(), F.lit("null")).otherwise(object_text([("entity_key", string_text(lever))]))),
                      ("goal", change(F.try_variant_get(v, "$.goal", "variant"))), ("target", text(v, "$.target")), terms]
    return (F.when(intent == "other", object_text([base[0], terms]))
            .when(mode == "forward", object_text(base + [("drivers", listed("$.drivers", driver)), ("targets", listed("$.targets", one)), terms]))
            .when(mode == "inverse", object_text(inverse)).otherwise(object_text(base + [terms])))
