"""The nested record type ``Rec`` and column helpers over it.

A record is one wide nullable struct holding the three branches (forward,
inverse, other).  Everything here is a pure Column -> Column builder, so it runs
inside whole-stage codegen and never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGE_DDL = "struct<type:string,value:double,unit:string,direction:string>"
DRIVER_DDL = f"struct<entity_key:string,change:{CHANGE_DDL}>"
REC_FIELDS = [
    ("intent", "string"),
    ("mode", "string"),
    ("product_id", "string"),
    ("drivers", f"array<{DRIVER_DDL}>"),
    ("targets", "array<string>"),
    ("lever", "struct<entity_key:string>"),
    ("goal", CHANGE_DDL),
    ("target", "string"),
    ("unknown_terms", "array<string>"),
]
REC_DDL = "struct<" + ",".join(f"{n}:{t}" for n, t in REC_FIELDS) + ">"


def null_of(ddl: str) -> Column:
    return F.lit(None).cast(ddl)


def empty_array(elem_ddl: str) -> Column:
    return F.array().cast(f"array<{elem_ddl}>")


def change(type_: Column, value: Column, unit: Column, direction: Column) -> Column:
    return F.struct(
        type_.cast("string").alias("type"),
        value.cast("double").alias("value"),
        unit.cast("string").alias("unit"),
        direction.cast("string").alias("direction"),
    )


def rec(**fields: Column) -> Column:
    """Build a ``Rec`` struct; fields not given are typed NULLs."""
    cols = []
    for name, ddl in REC_FIELDS:
        c = fields.get(name)
        cols.append((null_of(ddl) if c is None else c.cast(ddl)).alias(name))
    return F.struct(*cols)


def null_safe_eq(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def double_eq(a: Column, b: Column) -> Column:
    """Python float equality: NULL == NULL is true, NaN never equals anything."""
    return a.eqNullSafe(b) & ~(a.isNotNull() & F.isnan(a))


def change_eq_count(a: Column, b: Column) -> Column:
    """Number of equal sub-fields (0..4) of two ``Change`` structs; NULL struct = all-NULL."""
    parts = [
        null_safe_eq(a["type"], b["type"]),
        double_eq(a["value"], b["value"]),
        null_safe_eq(a["unit"], b["unit"]),
        null_safe_eq(a["direction"], b["direction"]),
    ]
    total = F.lit(0)
    for p in parts:
        total = total + p.cast("int")
    return total


def drivers_last_wins(drivers: Column) -> Column:
    """Keep, for each ``entity_key``, only the last driver of the array (dict semantics)."""
    arr = F.coalesce(drivers, empty_array(DRIVER_DDL))
    keys = F.transform(arr, lambda d: d["entity_key"])
    last = F.filter(
        arr,
        lambda d, i: ~F.exists(
            F.slice(arr, i + 2, F.greatest(F.size(arr), F.lit(1))),
            lambda e: e["entity_key"].eqNullSafe(d["entity_key"]),
        ),
    )
    return F.when(F.size(F.array_distinct(keys)) == F.size(arr), arr).otherwise(last)  # most have no key twice


def driver_keys(drivers: Column, dedup: bool = True) -> Column:
    arr = drivers_last_wins(drivers) if dedup else F.coalesce(drivers, empty_array(DRIVER_DDL))
    return F.transform(arr, lambda d: d["entity_key"])


def lower_terms(terms: Column) -> Column:
    """Set of lowercased terms (case folding only, no accent folding, no trim)."""
    return F.array_distinct(F.transform(F.coalesce(terms, empty_array("string")), lambda t: F.lower(t)))


def has_nan_value(r: Column) -> Column:
    """True when a value that the record's branch compares (a driver change, the goal) is NaN."""
    drv = F.exists(F.coalesce(r["drivers"], empty_array(DRIVER_DDL)),
                   lambda d: F.coalesce(F.isnan(d["change"]["value"]), F.lit(False)))
    goal = F.coalesce(F.isnan(r["goal"]["value"]), F.lit(False))
    branch = branch_of(r)
    return ((branch == "forward") & drv) | ((branch == "inverse") & goal)


def branch_of(r: Column) -> Column:
    """Branch tag: other / forward / inverse / base (simulation with another mode or none)."""
    return (F.when(r["intent"] == "other", F.lit("other"))
            .when(r["mode"] == "forward", F.lit("forward"))
            .when(r["mode"] == "inverse", F.lit("inverse"))
            .otherwise(F.lit("base")))


def canonical(r: Column, dedup: bool = True) -> Column:
    """Order- and duplicate-insensitive canonical form used for deep equality.

    other -> (other, terms); forward -> base + (driver set, target set);
    inverse -> base + (lever key, goal, target); any other mode -> base
    where base = (intent, mode, product, terms).
    """
    branch = branch_of(r)
    not_other = branch != "other"
    fwd = branch == "forward"
    inv = branch == "inverse"
    # one entry per key, so all are distinct; only compared, so any order that both sides share will do
    drv = F.sort_array(F.transform(
        drivers_last_wins(r["drivers"]) if dedup else F.coalesce(r["drivers"], empty_array(DRIVER_DDL)),
        lambda d: F.struct(d["entity_key"].alias("k"), d["change"].alias("c"))))
    tgt = F.sort_array(F.array_distinct(F.coalesce(r["targets"], empty_array("string"))))
    return F.struct(
        branch.alias("branch"),
        F.when(not_other, r["intent"]).alias("intent"),
        F.when(not_other, r["mode"]).alias("mode"),
        F.when(not_other, r["product_id"]).alias("product_id"),
        F.sort_array(lower_terms(r["unknown_terms"])).alias("terms"),
        F.when(fwd, drv).alias("drivers"),
        F.when(fwd, tgt).alias("targets"),
        F.when(inv, r["lever"]["entity_key"]).alias("lever"),
        F.when(inv, r["goal"]).alias("goal"),
        F.when(inv, r["target"]).alias("target"),
    )


def sorted_joined(arr: Column, sep: str = "|") -> Column:
    """Flatten a string array to a sorted, joined string (for SQL oracles)."""
    return F.array_join(F.array_sort(F.coalesce(arr, empty_array("string"))), sep)
