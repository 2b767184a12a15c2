"""Span-to-record assembly.

``nearest_by_position`` is the table form of the nearest-span association
(E2, J6): for every anchor (lever) span, the nearest span of each target kind
by distance between centres, ties to the earliest span in list order.  It
never builds anchor x candidate pairs and never puts one whole group in one
task:

* rows are range-partitioned by (group, centre, order) and written with their
  partition's number, which is their bucket: buckets hold about equally many
  rows however the positions lie, so neither a hot group nor a burst within it
  is one task (rows of one centre may lie in several buckets);
* rows are windowed per ``(group, bucket)``;
* for each target kind, the closest candidate before (running max over a
  range frame) and after (the same over the reversed order) is found inside
  the bucket - both frames are running aggregates, linear in the rows;
* the candidates of other buckets come from the bucket summary table (one row
  per group, bucket and kind: its first and last candidate), whose neighbour
  search is a window over buckets only; the nearer one counts.

``assemble_from_spans`` is the row-local form used by the span baseline
(E1-E8, E11): spans of one sentence are an array, handled with
higher-order functions in one projection.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.cleaning import normalize_direction, normalize_unit, to_float, type_from_unit
from fieldmark.functions.records import DRIVER_DDL, empty_array, rec
from fieldmark.session import scratch_path
from fieldmark.sources.dimensions import KPIS, LEVER_KEYS, UNKNOWN_SPAN_THRESHOLD


def ranged_buckets(rows: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    """``rows`` with ``_bucket``, the number of the range of ``by`` that each lies in; ranges hold about equally many rows."""
    path = scratch_path(rows.sparkSession, "buckets")
    ranged = rows.repartitionByRange(*([buckets] if buckets else []), *by)
    ranged.withColumn("_bucket", F.spark_partition_id().cast("long")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def nearest_by_position(df: DataFrame, group: list[str], center: str, order: str, kind: str,
                        anchor_kind: str, target_kinds: list[str], payload: str,
                        bucket_width: float | None = None, buckets: int | None = None) -> DataFrame:
    """Anchor rows with, per target kind ``t``, column ``near_<t>`` = payload of the nearest
    row of kind ``t`` in the same group (NULL when the group has none).

    ``buckets`` is the number of ranges (else the session's shuffle partitions); ``bucket_width``
    asks for slices of a fixed width instead, without a written table."""
    rows = df.select(*group, F.col(center).cast("double").alias("_c"), F.col(order).alias("_o"),
                     F.col(kind).alias("_k"), F.col(payload).alias("_p"))
    if bucket_width is not None:
        rows = rows.withColumn("_bucket", F.floor(F.col("_c") / F.lit(bucket_width)).cast("long"))
    else:
        rows = ranged_buckets(rows, [*group, "_c", "_o"], buckets)
    part = group + ["_bucket"]
    w_up = Window.partitionBy(*part).orderBy("_c").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w_down = Window.partitionBy(*part).orderBy(F.col("_c").desc()).rangeBetween(Window.unboundedPreceding,
                                                                               Window.currentRow)
    cols = []
    for t in target_kinds:
        is_t = F.col("_k") == t
        # before: greatest centre, then smallest order; after: smallest centre, then smallest order
        cols.append(F.max(F.when(is_t, F.struct(F.col("_c").alias("c"), (-F.col("_o")).alias("no"),
                                                F.col("_p").alias("p")))).over(w_up).alias(f"_prev_{t}"))
        cols.append(F.min(F.when(is_t, F.struct(F.col("_c").alias("c"), F.col("_o").alias("o"),
                                                F.col("_p").alias("p")))).over(w_down).alias(f"_next_{t}"))
    inb = rows.select("*", *cols).where(F.col("_k") == anchor_kind)

    # bucket summaries: last / first candidate of each kind per bucket, then neighbours across buckets
    summ = rows.where(F.col("_k").isin(*target_kinds)).groupBy(*group, "_bucket", "_k").agg(
        F.max(F.struct(F.col("_c").alias("c"), (-F.col("_o")).alias("no"), F.col("_p").alias("p"))).alias("_last"),
        F.min(F.struct(F.col("_c").alias("c"), F.col("_o").alias("o"), F.col("_p").alias("p"))).alias("_first"))
    wb_prev = Window.partitionBy(*group, "_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wb_next = Window.partitionBy(*group, "_k").orderBy(F.col("_bucket").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    # the anchors' buckets may hold no candidate at all: take the neighbours from the
    # bucket list of each kind, including the anchor bucket itself.
    anchors_b = inb.select(*group, "_bucket").distinct()
    kinds = F.array(*[F.lit(t) for t in target_kinds])
    ab = anchors_b.select(*group, "_bucket", F.explode(kinds).alias("_k"))
    allb = ab.select(*group, "_bucket", "_k", F.lit(None).cast(summ.schema["_last"].dataType).alias("_last"),
                     F.lit(None).cast(summ.schema["_first"].dataType).alias("_first"),
                     F.lit(1).alias("_anchor")).unionByName(
        summ.select(*group, "_bucket", "_k", "_last", "_first", F.lit(0).alias("_anchor")))
    allb = allb.groupBy(*group, "_bucket", "_k").agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"),
                                                     F.max("_anchor").alias("_anchor"))
    nb = allb.select(*group, "_bucket", "_k", "_anchor",
                     F.max("_last").over(wb_prev).alias("_xprev"),
                     F.min("_first").over(wb_next).alias("_xnext")).where(F.col("_anchor") == 1)
    piv = nb.groupBy(*group, "_bucket").agg(*[
        F.max(F.when(F.col("_k") == t, F.struct("_xprev", "_xnext"))).alias(f"_x_{t}") for t in target_kinds])
    j = inb.join(piv, group + ["_bucket"], "left")

    out = [F.col(g) for g in group] + [F.col("_c").alias(center), F.col("_o").alias(order)]
    if payload != order:
        out.append(F.col("_p").alias(payload))
    for t in target_kinds:
        # rows of one centre may lie in several buckets: compare, do not prefer one's own
        prev = F.greatest(F.col(f"_prev_{t}"), F.col(f"_x_{t}._xprev"))
        nxt = F.least(F.col(f"_next_{t}"), F.col(f"_x_{t}._xnext"))
        dp = F.col("_c") - prev["c"]
        dn = nxt["c"] - F.col("_c")
        take_prev = nxt.isNull() | (prev.isNotNull() & ((dp < dn) | ((dp == dn) & (-prev["no"] <= nxt["o"]))))
        out.append(F.when(take_prev, prev["p"]).otherwise(nxt["p"]).alias(f"near_{t}"))
    return j.select(*out)


# ---------------------------------------------------------------------------
# Row-local assembly from a span array
# ---------------------------------------------------------------------------

def spans_of(spans: Column, label: str) -> Column:
    """Spans with one label, original order kept."""
    return F.filter(spans, lambda s: s["label"] == label)


def nearest_in_array(anchor: Column, cands: Column) -> Column:
    """E2 row-local: nearest candidate by centre distance, ties to the earliest (NULL if none)."""
    center = (anchor["start"] + anchor["end"]) / 2.0
    scored = F.transform(cands, lambda s, i: F.struct(
        F.abs((s["start"] + s["end"]) / 2.0 - center).alias("d"), i.alias("i"), s.alias("s")))
    return F.array_min(scored)["s"]


def finalize_baseline(pred: Column) -> Column:
    """Keep lever drivers (value -> |value|), KPI targets sorted and distinct;
    content -> simulation/forward, else the empty ``other`` record (terms dropped)."""
    drivers = F.transform(
        F.filter(F.coalesce(pred["drivers"], empty_array(DRIVER_DDL)),
                 lambda d: F.coalesce(d["entity_key"].isin(*LEVER_KEYS), F.lit(False))),
        lambda d: F.struct(d["entity_key"].alias("entity_key"),
                           d["change"].withField("value", F.abs(d["change"]["value"])).alias("change")))
    targets = F.array_sort(F.array_distinct(F.filter(F.coalesce(pred["targets"], empty_array("string")),
                                                     lambda t: F.coalesce(t.isin(*KPIS), F.lit(False)))))
    has_sim = (F.coalesce(pred["product_id"] != "", F.lit(False)) | (F.size(drivers) > 0) | (F.size(targets) > 0))
    fwd = rec(intent=F.lit("simulation"), mode=F.lit("forward"), product_id=pred["product_id"],
              drivers=drivers, targets=targets, unknown_terms=pred["unknown_terms"])
    other = rec(intent=F.lit("other"), drivers=empty_array(DRIVER_DDL), targets=empty_array("string"),
                unknown_terms=empty_array("string"))
    return F.when(has_sim, fwd).otherwise(other)


SPAN_DDL = "struct<text:string,label:string,start:int,end:int,score:double>"


def assemble_from_spans(df: DataFrame, id_col: str, spans_col: str, dictionary: DataFrame,
                        fuzzy: bool = True) -> DataFrame:
    """E8 + E11: ``(id, prediction)`` from labelled spans per sentence.

    Spans are exploded, linked (T7) and their unit / direction / value texts
    normalised once per distinct text; spans are then regrouped per sentence
    (one sentence's spans, in original order) and assembled row-locally:
    first linked product (E4), lever spans sources-then-drivers (E3) with the
    nearest value / unit / direction (E2), linked KPI targets (E5), unknown
    terms over the 0.4 score threshold (E6), lowercased unlinked surfaces
    (E7), then ``finalize_baseline`` (E11).
    """
    from fieldmark.operators.linking import linked_texts

    ex = df.select(F.col(id_col).alias("_id"), F.posexplode(spans_col).alias("_i", "_s"))
    ex = ex.select("_id", "_i", "_s.*")
    texts = linked_texts(ex, "text", dictionary, containment=True, fuzzy=fuzzy)
    norm = texts.select("text", "key", normalize_unit(F.col("text"), F.col("n")).alias("unit_n"),
                        normalize_direction(F.col("n")).alias("dir_n"))
    linked = ex.join(norm, "text", "left").select(
        "_id", "_i", "text", "label", "start", "end", "score", "key", "unit_n", "dir_n",
        to_float(F.col("text")).alias("num"))
    per = linked.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct(
        "_i", "text", "label", "start", "end", "score", "key", "unit_n", "dir_n", "num"))).alias("sp"))
    sp = F.col("sp")
    products = spans_of(sp, "produit_credit")
    levers = F.concat(spans_of(sp, "source_financement"), spans_of(sp, "driver_levier"))
    values, units, dirs = spans_of(sp, "valeur_numerique"), spans_of(sp, "unite_variation"), spans_of(
        sp, "direction_variation")
    kpis, unk = spans_of(sp, "kpi_cible"), spans_of(sp, "terme_inconnu")
    staged = per.select(
        "_id", products.alias("_prod"), levers.alias("_lev"), values.alias("_val"), units.alias("_unit"),
        dirs.alias("_dir"), kpis.alias("_kpi"), unk.alias("_unk"))

    def drivers(lev, val, unit, dr):
        return F.transform(F.filter(lev, lambda s: s["key"].isNotNull()), lambda s: F.struct(
            s["key"].alias("entity_key"),
            F.struct(type_from_unit(nearest_in_array(s, unit)["unit_n"]).alias("type"),
                     nearest_in_array(s, val)["num"].alias("value"),
                     nearest_in_array(s, unit)["unit_n"].alias("unit"),
                     nearest_in_array(s, dr)["dir_n"].alias("direction")).alias("change")))

    c = F.col
    low = lambda arr: F.transform(arr, lambda s: F.lower(s["text"]))
    unknown = F.array_sort(F.array_distinct(F.concat(
        low(F.filter(c("_prod"), lambda s: s["key"].isNull())),
        low(F.filter(c("_lev"), lambda s: s["key"].isNull())),
        low(F.filter(c("_kpi"), lambda s: s["key"].isNull())),
        low(F.filter(c("_unk"), lambda s: (s["score"] > UNKNOWN_SPAN_THRESHOLD) & s["key"].isNull())))))
    pred = rec(
        product_id=F.get(F.filter(c("_prod"), lambda s: s["key"].isNotNull()), 0)["key"],
        drivers=drivers(c("_lev"), c("_val"), c("_unit"), c("_dir")),
        targets=F.array_sort(F.array_distinct(F.transform(F.filter(c("_kpi"), lambda s: s["key"].isNotNull()),
                                                          lambda s: s["key"]))),
        unknown_terms=unknown,
    )
    done = staged.select("_id", finalize_baseline(pred).alias("prediction"))
    # a sentence without spans has the empty record
    none = finalize_baseline(rec(drivers=empty_array(DRIVER_DDL), targets=empty_array("string"),
                                 unknown_terms=empty_array("string")))
    return df.select(F.col(id_col).alias("_id")).distinct().join(done, "_id", "left").select(
        c("_id").alias(id_col), F.coalesce("prediction", none).alias("prediction"))


def assemble_from_loose(df: DataFrame, id_col: str, raw_col: str, dictionary: DataFrame,
                        fuzzy: bool = True) -> DataFrame:
    """E9 + E10 + E11: ``(id, prediction, valid, valid_kind)`` from loose extraction JSON
    ``{product, drivers: [{entity, value, unit, direction}], targets: [str | {entity}]}``.

    A row whose text is not a JSON object, or whose structure would make the
    per-row post-processing fail (non-object driver, non-string entity, unit or
    direction of a linked driver that is no string, target neither string nor object
    with a string entity, drivers or targets that cannot be looped over), gets a NULL prediction
    and ``valid = false``; any other row is ``valid = true`` without schema
    validation (``valid_kind = 'no_crash'``, never mixed with model validity).
    Entity mentions are exploded, linked (T7) once per distinct text and
    regrouped per row, so no row is processed twice.
    """
    from fieldmark.functions.cleaning import parse_object, py_strip
    from fieldmark.functions.text import fold_distinct
    from fieldmark.operators.clean import not_iterable
    from fieldmark.operators.linking import as_written, link

    vt = lambda v: F.schema_of_variant(v)
    falsy = lambda v: F.coalesce(
        vt(v).isin("VOID", "OBJECT<>", "ARRAY<VOID>") | ((vt(v) == "STRING") & (F.try_variant_get(v, "$", "string") == ""))
        | ((vt(v) != "STRING") & F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False))), F.lit(True))
    named = lambda xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.struct(
        F.lit("STRING").alias("t"), x.alias("s"), F.lit(None).cast("variant").alias("ent")))
    s1 = df.select(F.col(id_col).alias("_id"), parse_object(py_strip(F.col(raw_col))).alias("_o"))
    top = "struct<product:variant,drivers:variant,targets:variant>"
    s2 = s1.select("_id", F.col("_o").isNotNull().alias("_parsed"), F.try_variant_get("_o", "$", top).alias("_f"))
    arr = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))  # noqa
    drv_t = "struct<entity:variant,value:variant,unit:variant,direction:variant>"
    s3 = s2.select(
        "_id", "_parsed",
        F.when(vt(F.col("_f.product")) == "STRING", py_strip(F.try_variant_get("_f.product", "$", "string")))
         .otherwise(F.lit("")).alias("_prod"),
        F.transform(arr(F.col("_f.drivers")), lambda e: F.struct(
            vt(e).alias("t"), F.try_variant_get(e, "$", drv_t).alias("d"))).alias("_drv"),
        # a string is looped over by character, an object by key
        F.when(vt(F.col("_f.targets")) == "STRING", named(F.split(F.try_variant_get("_f.targets", "$", "string"), "")))
         .when(vt(F.col("_f.targets")).startswith("OBJECT"), named(F.json_object_keys(F.to_json("_f.targets"))))
         .otherwise(F.transform(arr(F.col("_f.targets")), lambda e: F.struct(
             vt(e).alias("t"), F.try_variant_get(e, "$", "string").alias("s"),
             F.try_variant_get(e, "$.entity", "variant").alias("ent")))).alias("_tgt"),
        (not_iterable(F.col("_f.drivers")) | not_iterable(F.col("_f.targets"))
         | (F.coalesce(vt(F.col("_f.drivers")), F.lit("VOID")).rlike("^(STRING|OBJECT)")
            & ~falsy(F.col("_f.drivers")))).alias("_no_loop"))
    ok_str = lambda v: F.coalesce(vt(v).isin("STRING", "VOID"), F.lit(True))  # noqa: E731  NULL/absent/str
    crash = (F.col("_no_loop")
             | F.exists("_drv", lambda d: ~F.coalesce(d["t"].startswith("OBJECT"), F.lit(False))
                        | ~(ok_str(d["d"]["entity"]) | falsy(d["d"]["entity"])))
             | F.exists("_tgt", lambda t: ~(F.coalesce(t["t"] == "STRING", F.lit(False))
                                           | (F.coalesce(t["t"].startswith("OBJECT"), F.lit(False)) & ok_str(t["ent"])))))
    s4 = s3.select("_id", (F.col("_parsed") & ~crash).alias("_ok"), "_prod", "_drv", "_tgt")
    rows = s4.observe(f"loose_{uuid.uuid4().hex[:8]}", F.count_if("_ok").alias("ok_rows"))

    def vs(v):  # string value of a variant, '' for null / absent
        return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))

    found = rows.select("_id", "_ok", F.when(F.col("_ok"), F.concat(
        F.array(F.struct(F.lit("p").alias("role"), F.lit(0).alias("pos"), F.col("_prod").alias("text"),
                         F.lit(None).cast("string").alias("vtxt"), F.lit(None).cast("string").alias("unit"),
                         F.lit(None).cast("string").alias("dir"), F.lit(False).alias("bad"))),
        F.transform("_drv", lambda d, i: F.struct(
            F.lit("d").alias("role"), i.alias("pos"),
            F.when(vt(d["d"]["entity"]) == "STRING", py_strip(vs(d["d"]["entity"]))).otherwise(F.lit("")).alias("text"),
            # Python str(v): numbers keep their text, null -> 'None' (not a float)
            F.when(vt(d["d"]["value"]).isin("VOID") | d["d"]["value"].isNull(), F.lit("None"))
             .when(vt(d["d"]["value"]) == "BOOLEAN", F.lit("True"))
             .otherwise(F.try_variant_get(d["d"]["value"], "$", "string")).alias("vtxt"),
            F.try_variant_get(d["d"]["unit"], "$", "string").alias("unit"),
            F.try_variant_get(d["d"]["direction"], "$", "string").alias("dir"),
            (~ok_str(d["d"]["unit"]) | ~ok_str(d["d"]["direction"])).alias("bad"))),
        F.transform("_tgt", lambda t, i: F.struct(
            F.lit("t").alias("role"), i.alias("pos"),
            F.when(t["t"] == "STRING", t["s"]).otherwise(vs(t["ent"])).alias("text"),
            F.lit(None).cast("string").alias("vtxt"), F.lit(None).cast("string").alias("unit"),
            F.lit(None).cast("string").alias("dir"), F.lit(False).alias("bad"))))).alias("_ments"))
    # read for its texts, its units and directions, its mentions and its rows: parsed once
    path = scratch_path(df.sparkSession, "mentions")
    found.write.parquet(path)
    rows = df.sparkSession.read.schema(found.schema).parquet(path)
    ments = rows.where("_ok").select("_id", F.inline("_ments")).where(F.col("text") != "")
    linked = link(ments, "text", dictionary, containment=True, fuzzy=fuzzy, out_col="key")
    vocab = ments.select(F.explode(F.array("unit", "dir")).alias("w")).where(F.col("w").isNotNull()).distinct()
    folded = as_written(fold_distinct(vocab, "w", "_fw"), "vocabulary")
    nu = folded.select(F.col("w").alias("unit"), normalize_unit(F.col("w"), F.col("_fw")).alias("unit_n"))
    nd = folded.select(F.col("w").alias("dir"), normalize_direction(F.col("_fw")).alias("dir_n"))
    # the vocabulary comes from the data: no broadcast hint, the planner sizes the joins
    linked = linked.join(nu, "unit", "left").join(nd, "dir", "left")
    per = linked.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct(
        "role", "pos", "text", "key", "vtxt", "unit_n", "dir_n"))).alias("m"),
        F.bool_or(F.col("bad") & F.col("key").isNotNull()).alias("_bad"))  # unit and direction count once linked
    m = F.col("m")
    prod = F.filter(m, lambda x: x["role"] == "p")
    drv = F.filter(m, lambda x: x["role"] == "d")
    tgt = F.filter(m, lambda x: x["role"] == "t")
    low = lambda a: F.transform(a, lambda x: F.lower(x["text"]))
    pred = rec(
        product_id=F.get(prod, 0)["key"],
        drivers=F.transform(F.filter(drv, lambda x: x["key"].isNotNull()), lambda x: F.struct(
            x["key"].alias("entity_key"),
            F.struct(type_from_unit(x["unit_n"]).alias("type"), to_float(x["vtxt"]).alias("value"),
                     x["unit_n"].alias("unit"), x["dir_n"].alias("direction")).alias("change"))),
        targets=F.array_sort(F.array_distinct(F.transform(F.filter(tgt, lambda x: x["key"].isNotNull()),
                                                          lambda x: x["key"]))),
        unknown_terms=F.array_sort(F.array_distinct(F.concat(
            low(F.filter(prod, lambda x: x["key"].isNull())), low(F.filter(drv, lambda x: x["key"].isNull())),
            low(F.filter(tgt, lambda x: x["key"].isNull()))))),
    )
    assembled = per.select("_id", "_bad", finalize_baseline(pred).alias("_pred"))
    empty = finalize_baseline(rec(drivers=empty_array(DRIVER_DDL), targets=empty_array("string"),
                                  unknown_terms=empty_array("string")))
    out = rows.select("_id", "_ok").join(assembled, "_id", "left").withColumn(
        "_ok", F.col("_ok") & ~F.coalesce("_bad", F.lit(False)))
    return out.select(F.col("_id").alias(id_col),
                      F.when(F.col("_ok"), F.coalesce("_pred", empty)).alias("prediction"),
                      F.col("_ok").alias("valid"), F.lit("no_crash").alias("valid_kind"))
