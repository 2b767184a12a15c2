"""Error report operators.

* ``diff_fields``: high-level differences between gold and prediction as an
  array of ``(field, expected, got)`` with JSON-rendered values (Python
  ``json.dumps`` layout: ``", "`` and ``": "`` separators, non-ASCII kept).
* ``error_samples``: first k failing examples per run.  ``row_number() <= k``
  lets Spark insert a partial window group limit before the shuffle, so each
  map task ships at most k rows per run, however large a run is.
* ``precision_rows`` / ``precision_impact``: the variants of one base model, row by row and from first to last.
* ``report_lines``: the Markdown report as a DataFrame ``(section, rank, ord, line)``, built from line templates;
  the lines in this order, each with a line break at its end, are the report.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.json_text import change_text as _jchange, dict_text as _jdict, list_text as _jlist, string_text as _js
from fieldmark.functions.records import DRIVER_DDL, empty_array
from fieldmark.operators.summary import fmt3, ranked


def driver_dict(drivers: Column) -> Column:
    """Python ``{key: change}``: keys in first-occurrence order, the last value wins."""
    arr = F.coalesce(drivers, empty_array(DRIVER_DDL))
    firsts = F.filter(arr, lambda d, i: ~F.exists(F.slice(arr, 1, i),
                                                   lambda e: e["entity_key"].eqNullSafe(d["entity_key"])))
    return F.transform(firsts, lambda d: F.struct(
        d["entity_key"].alias("k"),
        F.element_at(F.filter(arr, lambda e: e["entity_key"].eqNullSafe(d["entity_key"])), -1)["change"].alias("c")))


def _diff_parts(g: Column, p: Column):
    fwd = F.coalesce(g["mode"] == "forward", F.lit(False))
    inv = F.coalesce(g["mode"] == "inverse", F.lit(False))
    gt = F.array_sort(F.coalesce(g["targets"], empty_array("string")))
    pt = F.array_sort(F.coalesce(p["targets"], empty_array("string")))
    gu = F.array_sort(F.coalesce(g["unknown_terms"], empty_array("string")))
    pu = F.array_sort(F.coalesce(p["unknown_terms"], empty_array("string")))
    return [
        ("mode", ~g["mode"].eqNullSafe(p["mode"]), lambda: _js(g["mode"]), lambda: _js(p["mode"])),
        ("product_id", ~g["product_id"].eqNullSafe(p["product_id"]),
         lambda: _js(g["product_id"]), lambda: _js(p["product_id"])),
        ("drivers", fwd & ~_dict_canon(g["drivers"]).eqNullSafe(_dict_canon(p["drivers"])),
         lambda: _jdict(driver_dict(g["drivers"])), lambda: _jdict(driver_dict(p["drivers"]))),
        ("targets", fwd & ~gt.eqNullSafe(pt), lambda: _jlist(gt), lambda: _jlist(pt)),
        ("lever", inv & ~g["lever"]["entity_key"].eqNullSafe(p["lever"]["entity_key"]),
         lambda: _js(g["lever"]["entity_key"]), lambda: _js(p["lever"]["entity_key"])),
        ("goal", inv & ~g["goal"].eqNullSafe(p["goal"]), lambda: _jchange(g["goal"]), lambda: _jchange(p["goal"])),
        ("target", inv & ~g["target"].eqNullSafe(p["target"]), lambda: _js(g["target"]), lambda: _js(p["target"])),
        ("unknown_terms", ~gu.eqNullSafe(pu), lambda: _jlist(gu), lambda: _jlist(pu)),
    ]


def _dict_canon(drivers: Column) -> Column:
    """Order-free form of the ``{key: change}`` dict (last duplicate wins)."""
    from fieldmark.functions.records import drivers_last_wins

    return F.array_sort(drivers_last_wins(drivers))


def with_diffs(df: DataFrame, gold_col: str = "gold", pred_col: str = "prediction",
               out: str = "diff_fields") -> DataFrame:
    """Add ``out`` = names of the differing high-level fields (empty when none).

    intent differs -> ``intent`` only; gold ``other`` -> none; else mode,
    product, (forward) driver dict and sorted targets, (inverse) lever, goal,
    target, then sorted unknown terms (case-sensitive, duplicates kept).
    """
    g, p = F.col(gold_col), F.col(pred_col)
    names = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond, _, _ in _diff_parts(g, p)]),
                     lambda x: x.isNotNull())
    diffs = (F.when(~g["intent"].eqNullSafe(p["intent"]), F.array(F.lit("intent")))
             .when(F.coalesce(g["intent"] == "other", F.lit(False)), F.array().cast("array<string>"))
             .otherwise(names))
    res = df.select("*", diffs.alias(out))
    return res.observe(f"diffs_{uuid.uuid4().hex[:8]}", F.count_if(F.size(out) > 0).alias("with_diffs"))


def render_diffs(df: DataFrame, gold_col: str = "gold", pred_col: str = "prediction",
                 fields_col: str = "diff_fields", out: str = "diffs") -> DataFrame:
    """W4 text: ``(field, expected, got)`` with JSON values, for rows already reduced to samples."""
    g, p = F.col(gold_col), F.col(pred_col)
    parts = {name: (exp, got) for name, _, exp, got in _diff_parts(g, p)}
    items = [F.when(F.array_contains(F.col(fields_col), name), F.struct(
        F.lit(name).alias("field"), exp().alias("expected"), got().alias("got"))) for name, (exp, got) in parts.items()]
    intent = F.struct(F.lit("intent").alias("field"), F.coalesce(g["intent"], F.lit("None")).alias("expected"),
                      F.coalesce(p["intent"], F.lit("None")).alias("got"))
    all_items = F.filter(F.array(F.when(F.array_contains(F.col(fields_col), "intent"), intent), *items),
                         lambda x: x.isNotNull())
    return df.select("*", all_items.alias(out))


def diff_text(diffs: Column) -> Column:
    """One line per difference: ``field: attendu=.. / obtenu=..``."""
    return F.transform(diffs, lambda d: F.concat(d["field"], F.lit(": attendu="), d["expected"],
                                                 F.lit(" / obtenu="), d["got"]))


def error_samples(scored: DataFrame, k: int = 4) -> DataFrame:
    """First ``k`` examples per run (row order) with exact_match false and a visible diff."""
    d = with_diffs(scored.where(~F.col("exact_match")).select("run", "row_id", "text", "gold", "prediction"))
    d = d.where(F.size("diff_fields") > 0)
    w = Window.partitionBy("run").orderBy("row_id")
    top = d.withColumn("sample", F.row_number().over(w)).where(F.col("sample") <= k)
    return render_diffs(top).select("run", "row_id", "text", "sample", "diff_fields", "diffs")


def precision_rows(summary: DataFrame, variants: DataFrame) -> DataFrame:
    """W6 in long form: one row per present variant of each base model, in order.

    ``step`` counts the present variants, ``previous_variant`` and ``previous_em`` are the one before that has a
    rate, ``step_points`` the change from it in points.  ``sufficient`` is false for a base with one variant only.
    """
    s = summary.select(F.col("model").alias("variant"), "precision", "exact_match_rate", "latency_median_s")
    j = variants.select("base", "variant", "ord").join(s, "variant")
    by_ord = Window.partitionBy("base").orderBy("ord")
    before = by_ord.rowsBetween(Window.unboundedPreceding, -1)
    rated = F.when(F.col("exact_match_rate").isNotNull(), F.struct("variant", "exact_match_rate"))
    last = F.last(rated, ignorenulls=True).over(before)
    return j.select(
        "base", F.row_number().over(by_ord).alias("step"), "variant", "precision", "exact_match_rate", "latency_median_s",
        last["variant"].alias("previous_variant"), last["exact_match_rate"].alias("previous_em"),
        ((F.col("exact_match_rate") - last["exact_match_rate"]) * 100).alias("step_points"),
        (F.count(F.lit(1)).over(Window.partitionBy("base")) >= 2).alias("sufficient"))


def precision_impact(summary: DataFrame, variants: DataFrame) -> DataFrame:
    """Per base model with >= 2 present variants, first and last variant by order
    (rates NULL excluded) and the exact-match delta in points."""
    s = summary.select(F.col("model").alias("variant"), "precision", "exact_match_rate", "latency_median_s")
    j = variants.join(s, "variant")
    present = j.groupBy("base").agg(F.count(F.lit(1)).alias("present"))
    nn = j.where(F.col("exact_match_rate").isNotNull())
    agg = nn.groupBy("base").agg(
        F.min_by("variant", "ord").alias("first_variant"), F.max_by("variant", "ord").alias("last_variant"),
        F.min_by("precision", "ord").alias("first_precision"), F.max_by("precision", "ord").alias("last_precision"),
        F.min_by("exact_match_rate", "ord").alias("first_em"), F.max_by("exact_match_rate", "ord").alias("last_em"),
        F.count(F.lit(1)).alias("rated"))
    out = present.where(F.col("present") >= 2).join(agg, "base", "left")
    delta = F.when(F.col("rated") >= 2, (F.col("last_em") - F.col("first_em")) * 100)
    return out.select("base", "present", "first_variant", "last_variant", "first_precision", "last_precision",
                      "first_em", "last_em", delta.alias("delta_points"))


# The lines of the report, in its order.  A name in braces stands for a column of the section's row.
HEADER = (
    "# Rapport — Benchmark de quantification (BF16 vs Q8 vs Q4)",
    "",
    "Évaluation de {runs} runs (modèle x précision) sur la tâche de semantic parsing bancaire "
    "(phrase FR -> JSON, monde fermé), sur le dataset augmenté.",
    "",
    "- **Exemples** : {n} (data partagée avec le benchmark principal, augmentée).",
    "- **Métrique** : exact_match (égalité profonde ; listes comparées comme ensembles).",
    "- **Moteurs** : BF16 -> vLLM ; Q8/Q4 (GGUF) -> llama.cpp. Décodage JSON contraint, "
    "température 0, prompt identique partout.",
    "- **Latence** : médiane par requête. Note : vLLM (BF16) et llama.cpp (GGUF) sont des "
    "moteurs différents ; la latence reflète le couple modèle+moteur de déploiement réel, "
    "pas seulement la précision.",
    "",
)
BOARD_HEAD = (
    "## 1. Classement général",
    "",
    "| Rang | Run | Précision | Exact match | Forward | Inverse | Other | Schéma valide | Latence méd. |",
    "|:---:|---|:---:|:---:|:---:|:---:|:---:|:---:|:---:|",
)
BOARD_ROW = ("| {rank} | {model} | {precision} | {exact_match_rate} | {em_forward} | {em_inverse} | {em_other} | "
             "{schema_valid_rate} | {latency_median_s} s |")
IMPACT_HEAD = ("", "## 2. Impact de la quantification (par modèle de base)", "")
IMPACT_NONE = ("Données insuffisantes pour comparer les précisions (runs manquants).", "")
IMPACT_BASE = ("### {base}", "", "| Variante | Précision | Exact match | Latence méd. |", "|---|:---:|:---:|:---:|")
IMPACT_ROW = "| {variant} | {precision} | {exact_match_rate} | {latency_median_s} s |"
IMPACT_DELTA = ("", "Variation exact match {first_precision} -> {last_precision} : {delta} points.")
SHEET_HEAD = ("## 3. Fiche par run", "")
SHEET = (
    "### {model} — {precision} ({backend}) — exact_match {exact_match_rate}",
    "",
    "- Par type : forward {em_forward}, inverse {em_inverse}, other {em_other}.",
    "- Schéma valide {schema_valid_rate} ; latence médiane {latency_median_s} s (p95 {latency_p95_s} s).",
    "- product_id {product_id_correct} ; drivers P/R {drivers_precision}/{drivers_recall} ; "
    "change_acc {drivers_change_accuracy} ; targets P/R {targets_precision}/{targets_recall}.",
    "- Inverse : lever {lever_correct}, goal {goal_correct}, target {target_correct}. "
    "unknown_terms P/R {unknown_terms_precision}/{unknown_terms_recall}.",
)
SAMPLES_HEAD, SAMPLES_NONE = "- Échantillon d'erreurs :", "- Aucune erreur (exact_match parfait)."
SAMPLE, SAMPLE_DIFF = "  - « {text} »", "    - {diff}"
#: Ranks and places of lines that stand behind all others of their section or row.
LAST = 2 ** 31 - 1


def filled(template: str, **columns: Column) -> Column:
    """The template with each ``{name}`` replaced by the column of that name."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [columns[name]] if name else []
    return F.concat(*parts) if parts else F.lit("")


def _stacked(rows: DataFrame, section: int, rank: Column, templates, columns: dict, first: int = 0) -> DataFrame:
    """Lines of a block of templates for every row."""
    lines = F.array(*[filled(t, **columns) for t in templates])
    return rows.select(F.lit(section).alias("section"), rank.cast("int").alias("rank"),
                       F.posexplode(lines).alias("_at", "line")).select(
        "section", "rank", (F.col("_at") + first).cast("int").alias("ord"), "line")


def signed1(c: Column) -> Column:
    """A float with its sign and one decimal."""
    text = F.regexp_replace(F.format_number(c, 1), ",", "")
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def report_lines(summary: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """The Markdown report as lines ``(section, rank, ord, line)``; order by the first three to print.

    ``summary`` has a row per run and is read several times: pass a written table when it is costly.  ``variants``
    are ``(base, variant, ord)``, and ``base_ord`` for the order of the bases (else their names).  Sections: 0 the
    header, 1 the leaderboard, 2 the precisions of each base model or one line if none has two, 3 a sheet per run
    with its error samples or the line that it has none.
    """
    spark = summary.sparkSession
    board = ranked(summary).withColumn("_last", F.max("rank").over(Window.partitionBy(F.lit(0))))  # a row per run
    numbers = [f.name for f in summary.schema.fields if f.dataType.typeName() == "double"]
    texts = {c: F.col(c) for c in board.columns if c not in numbers} | {"rank": F.col("rank").cast("string")}
    columns = texts | {c: fmt3(F.col(c)) for c in numbers}
    one = spark.range(1)
    head = board.agg(F.count(F.lit(1)).cast("string").alias("runs"),
                     F.coalesce(F.min_by("n", "rank").cast("string"), F.lit("?")).alias("n"))
    out = [_stacked(head, 0, F.lit(0), HEADER, {"runs": F.col("runs"), "n": F.col("n")}),
           _stacked(one, 1, F.lit(0), BOARD_HEAD, {}), _stacked(board, 1, F.col("rank"), [BOARD_ROW], columns),
           _stacked(one, 2, F.lit(0), IMPACT_HEAD, {})]

    base_ord = F.col("base_ord") if "base_ord" in variants.columns else F.lit(0)
    bases = variants.groupBy("base").agg(F.min(base_ord).alias("_o"))
    places = bases.select("base", F.row_number().over(Window.orderBy("_o", "base")).alias("place"))
    impact = precision_rows(summary, variants).where("sufficient").join(places, "base")
    rated = F.col("exact_match_rate").isNotNull()
    per_base = impact.groupBy("base", "place").agg(
        F.max("step").alias("steps"), F.count_if(rated).alias("rated"), F.min_by("precision", "step").alias("first_precision"),
        F.max_by("precision", "step").alias("last_precision"),
        F.min_by("exact_match_rate", F.when(rated, F.col("step"))).alias("first_em"),
        F.max_by("exact_match_rate", F.when(rated, F.col("step"))).alias("last_em"))
    delta = {"first_precision": F.col("first_precision"), "last_precision": F.col("last_precision"),
             "delta": signed1((F.col("last_em") - F.col("first_em")) * 100)}
    row = filled(IMPACT_ROW, variant=F.col("variant"), precision=F.col("precision"),
                 exact_match_rate=fmt3(F.col("exact_match_rate")), latency_median_s=fmt3(F.col("latency_median_s")))
    out += [_stacked(per_base, 2, F.col("place"), IMPACT_BASE, {"base": F.col("base")}),
            impact.select(F.lit(2).alias("section"), F.col("place").alias("rank"),
                          (F.col("step") + len(IMPACT_BASE)).cast("int").alias("ord"), row.alias("line")),
            _stacked(per_base.where("rated >= 2"), 2, F.col("place"), IMPACT_DELTA, delta, LAST - 5),
            _stacked(per_base, 2, F.col("place"), [""], {}, LAST),
            _stacked(per_base.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), 2, F.lit(1), IMPACT_NONE, {}),
            _stacked(one, 3, F.lit(0), SHEET_HEAD, {}), _stacked(board, 3, F.col("rank"), SHEET, columns)]

    of_run = board.select(F.col("model").alias("run"), "rank")
    shown = samples.join(of_run, "run")
    counts = board.join(samples.select(F.col("run").alias("model")).distinct().withColumn("_any", F.lit(True)), "model", "left")
    note = F.when(F.col("_any"), F.lit(SAMPLES_HEAD)).otherwise(F.lit(SAMPLES_NONE))
    # a sample holds a line for its text and some for its differences, of which there are fewer than 16
    lines = F.concat(F.array(filled(SAMPLE, text=F.coalesce("text", F.lit("None")))),
                     F.transform(diff_text(F.col("diffs")), lambda d: filled(SAMPLE_DIFF, diff=d)))
    out += [_stacked(counts, 3, F.col("rank"), ["{note}"], {"note": note}, len(SHEET)),
            shown.select("rank", "sample", F.posexplode(lines).alias("_at", "line")).select(
                F.lit(3).alias("section"), "rank", (F.col("sample") * 16 + F.col("_at")).cast("int").alias("ord"), "line"),
            _stacked(board.where("rank < _last"), 3, F.col("rank"), [""], {}, LAST)]
    lines = out[0]
    for part in out[1:]:
        lines = lines.unionByName(part)
    return lines
