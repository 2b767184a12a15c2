"""Queries W4-W7: field diffs, error samples, precision impact, report lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import report
from fieldmark.operators.report import (
    error_samples, precision_impact, precision_rows, render_diffs, report_lines, with_diffs,
)
from fieldmark.operators.summary import summarize
from fieldmark.functions.metrics import METRIC_FIELDS
from fieldmark.plans.catalog import register
from fieldmark.plans.oracle_sql import diff_sql, with_ctes, DIFF_CTES, DIFF_TEXT_CTES, GOLD_CTES, PRED_CTES, SCORE_CTES
from fieldmark.plans.scoring_queries import scored
from fieldmark.plans.summary_queries import SUMMARY_CTE
from fieldmark.session import scratch_path
from fieldmark.sources.io import with_file_position
from fieldmark.sources.sinks import SUMMARY_QUANT, write_report_file, write_summary_file
from fieldmark.sources.dimensions import ERROR_SAMPLES_PER_RUN, runs_df, variant_rows, variants_df


@register("w04_diff_fields", diff_sql("SELECT run, row_id, fields FROM diffs WHERE fields <> ''"))
def w04_diff_fields(spark, sf_dir):
    """Names of the differing high-level fields, per (run, example) with a difference."""
    d = with_diffs(scored(spark, sf_dir).select("run", "row_id", "gold", "prediction"))
    return d.where(F.size("diff_fields") > 0).select("run", "row_id", F.array_join("diff_fields", "|").alias("fields"))


@register("w05_error_samples", diff_sql(f"""
SELECT run, sample, row_id, fields FROM (
  SELECT run, row_id, fields, row_number() OVER (PARTITION BY run ORDER BY row_id) AS sample
  FROM diffs WHERE NOT exact_match AND fields <> '')
WHERE sample <= {ERROR_SAMPLES_PER_RUN}"""), headline=True)
def w05_error_samples(spark, sf_dir):
    """First 4 failing examples per run (row order) with at least one visible diff."""
    s = error_samples(scored(spark, sf_dir), ERROR_SAMPLES_PER_RUN)
    return s.select("run", "sample", "row_id", F.array_join("diff_fields", "|").alias("fields"))


_VARIANT_VALUES = ", ".join(f"('{b}', '{v}', {o})" for b, v, o in variant_rows())


@register("w06_precision_impact", with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, SUMMARY_CTE, f"""
variants AS (SELECT * FROM (VALUES {_VARIANT_VALUES}) t(base, variant, ord)),
vj AS (SELECT v.base, v.variant, v.ord, coalesce(d.precision, '?') AS precision, s.exact_match_rate
       FROM variants v JOIN summary s ON s.model = v.variant LEFT JOIN rundim d ON d.name = v.variant)""",
    select="""
SELECT p.base, p.present, a.first_variant, a.last_variant, a.first_precision, a.last_precision,
       a.first_em, a.last_em, CASE WHEN a.rated >= 2 THEN (a.last_em - a.first_em) * 100 END AS delta_points
FROM (SELECT base, count(*) AS present FROM vj GROUP BY base HAVING count(*) >= 2) p
LEFT JOIN (SELECT base, arg_min(variant, ord) AS first_variant, arg_max(variant, ord) AS last_variant,
                  arg_min(precision, ord) AS first_precision, arg_max(precision, ord) AS last_precision,
                  arg_min(exact_match_rate, ord) AS first_em, arg_max(exact_match_rate, ord) AS last_em,
                  count(*) AS rated
           FROM vj WHERE exact_match_rate IS NOT NULL GROUP BY base) a ON a.base = p.base"""))
def w06_precision_impact(spark, sf_dir):
    """Exact-match change from the first to the last precision variant of each base model."""
    summary = summarize(scored(spark, sf_dir), runs_df(spark))
    return precision_impact(summary, variants_df(spark))


_VARIANT_JOIN = f"""
variants AS (SELECT * FROM (VALUES {_VARIANT_VALUES}) t(base, variant, ord)),
vj AS (SELECT v.base, v.variant, v.ord, coalesce(d.precision, '?') AS precision, s.exact_match_rate, s.latency_median_s
       FROM variants v JOIN summary s ON s.model = v.variant LEFT JOIN rundim d ON d.name = v.variant)"""


@register("w06_precision_rows", with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, SUMMARY_CTE, _VARIANT_JOIN, select="""
SELECT a.base, (SELECT count(*) FROM vj b WHERE b.base = a.base AND b.ord <= a.ord) AS step, a.variant, a.precision,
  a.exact_match_rate, a.latency_median_s, p.variant AS previous_variant, p.exact_match_rate AS previous_em,
  (a.exact_match_rate - p.exact_match_rate) * 100 AS step_points,
  (SELECT count(*) FROM vj b WHERE b.base = a.base) >= 2 AS sufficient
FROM vj a LEFT JOIN vj p ON p.base = a.base AND p.ord = (
  SELECT max(b.ord) FROM vj b WHERE b.base = a.base AND b.ord < a.ord AND b.exact_match_rate IS NOT NULL)"""))
def w06_precision_rows(spark, sf_dir):
    """W6, row by row: every present variant with its rate, latency and step from the one before."""
    return precision_rows(summarize(scored(spark, sf_dir), runs_df(spark)), variants_df(spark))


@register("w04_diff_text", with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, DIFF_CTES, DIFF_TEXT_CTES, select="""
SELECT run, row_id, pos, field, expected, got FROM difflines"""))
def w04_diff_text(spark, sf_dir):
    """Every difference of every (run, example) with the JSON text of both sides."""
    d = with_diffs(scored(spark, sf_dir).select("run", "row_id", "gold", "prediction")).where(F.size("diff_fields") > 0)
    lines = render_diffs(d).select("run", "row_id", F.posexplode("diffs").alias("pos", "d"))
    return lines.select("run", "row_id", F.col("pos").cast("long").alias("pos"), "d.field", "d.expected", "d.got")


def _filled(template: str, **cells: str) -> str:
    """SQL of a report line: the template's text, each name in braces by its SQL."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += ["'" + text.replace("'", "''") + "'"] if text else []
        parts += [cells[name]] if name else []
    return " || ".join(parts) or "''"


def _report_sql(select: str) -> str:
    num = lambda c: f"coalesce(printf('%.3f', {c}), '-')"
    cells = {c: num(f"b.{c}") for c in [*METRIC_FIELDS, "exact_match_rate", "schema_valid_rate", "latency_median_s", "latency_p95_s"]}
    cells |= {c: f"b.{c}" for c in ("model", "precision", "backend")} | {"rank": "CAST(b.rank AS VARCHAR)"}
    cells |= {f"em_{t}": f"CAST(b.hits_{t} AS VARCHAR) || '/' || CAST(b.total_{t} AS VARCHAR)" for t in ("forward", "inverse", "other")}
    parts = []

    def block(section, rank, templates, source, first=0, **own):
        for k, t in enumerate(templates):
            parts.append(f"SELECT {section} AS section, {rank} AS rank, {first + k} AS ord, {_filled(t, **(own or cells))} AS line FROM {source}")

    last, one = report.LAST, "(SELECT 1)"
    block(0, 0, report.HEADER, "(SELECT count(*) AS runs, arg_min(n, rank) AS n FROM board)",
          runs="CAST(runs AS VARCHAR)", n="coalesce(CAST(n AS VARCHAR), '?')")
    block(1, 0, report.BOARD_HEAD, one)
    block(1, "b.rank", [report.BOARD_ROW], "board b")
    block(2, 0, report.IMPACT_HEAD, one)
    block(2, "place", report.IMPACT_BASE, "bases", base="base")
    block(2, "place", [report.IMPACT_ROW], "steps", variant="variant", precision="precision",
          exact_match_rate=num("exact_match_rate"), latency_median_s=num("latency_median_s"))
    parts[-1] = parts[-1].replace(" AS rank, 0 AS ord", f" AS rank, step + {len(report.IMPACT_BASE)} AS ord")
    block(2, "place", report.IMPACT_DELTA, "bases WHERE rated >= 2", last - 5, first_precision="first_precision",
          last_precision="last_precision", delta="printf('%+.1f', (last_em - first_em) * 100)")
    block(2, "place", [""], "bases", last)
    block(2, 1, report.IMPACT_NONE, f"{one} WHERE NOT EXISTS (SELECT 1 FROM bases)")
    block(3, 0, report.SHEET_HEAD, one)
    block(3, "b.rank", report.SHEET, "board b")
    some = "EXISTS (SELECT 1 FROM samples s WHERE s.run = b.model)"
    block(3, "b.rank", [report.SAMPLES_HEAD], f"board b WHERE {some}", len(report.SHEET))
    block(3, "b.rank", [report.SAMPLES_NONE], f"board b WHERE NOT {some}", len(report.SHEET))
    block(3, "b.rank", [report.SAMPLE], "samples s JOIN board b ON b.model = s.run", text="s.text")
    parts[-1] = parts[-1].replace(" AS rank, 0 AS ord", " AS rank, s.sample * 16 AS ord")
    block(3, "b.rank", [report.SAMPLE_DIFF], "samples s JOIN board b ON b.model = s.run JOIN difflines d ON d.run = s.run AND d.row_id = s.row_id",
          diff="d.field || ': attendu=' || d.expected || ' / obtenu=' || d.got")
    parts[-1] = parts[-1].replace(" AS rank, 0 AS ord", " AS rank, s.sample * 16 + 1 + d.pos AS ord")
    block(3, "b.rank", [""], "board b WHERE b.rank < (SELECT max(rank) FROM board)", last)
    ctes = f"""
board AS (SELECT s.*, coalesce(d.precision, '?') AS precision, coalesce(d.backend, '?') AS backend,
    row_number() OVER (ORDER BY exact_match_rate DESC NULLS LAST, model) AS rank
  FROM summary s LEFT JOIN rundim d ON d.name = s.model),
places AS (SELECT base, row_number() OVER (ORDER BY min(o)) AS place FROM (
    SELECT base, row_number() OVER () AS o FROM variants) GROUP BY base),
steps AS (SELECT vj.*, place, (SELECT count(*) FROM vj b WHERE b.base = vj.base AND b.ord <= vj.ord) AS step
  FROM vj JOIN places USING (base) WHERE (SELECT count(*) FROM vj b WHERE b.base = vj.base) >= 2),
bases AS (SELECT base, place, arg_min(precision, step) AS first_precision, arg_max(precision, step) AS last_precision,
    arg_min(exact_match_rate, step) FILTER (exact_match_rate IS NOT NULL) AS first_em,
    arg_max(exact_match_rate, step) FILTER (exact_match_rate IS NOT NULL) AS last_em,
    count(exact_match_rate) AS rated FROM steps GROUP BY base, place),
samples AS (SELECT * FROM (
  SELECT d.run, d.row_id, s.text, row_number() OVER (PARTITION BY d.run ORDER BY d.row_id) AS sample
  FROM diffs d JOIN scored s ON s.run = d.run AND s.row_id = d.row_id WHERE NOT d.exact_match AND fields <> '')
  WHERE sample <= {ERROR_SAMPLES_PER_RUN})"""
    lines = "\nUNION ALL ".join(parts)
    return with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, DIFF_CTES, DIFF_TEXT_CTES, SUMMARY_CTE, _VARIANT_JOIN, ctes,
                     f"\nlines AS ({lines})", select=select)


@register("w07_report_lines", _report_sql("""
SELECT section::INTEGER AS section, rank::INTEGER AS rank, ord::INTEGER AS ord, line FROM lines"""))
def w07_report_lines(spark, sf_dir):
    """The whole Markdown report as ordered lines; summary and samples are written once and read by its sections."""
    path = scratch_path(spark, "report")
    sc = scored(spark, sf_dir)
    summarize(sc, runs_df(spark)).write.parquet(f"{path}/summary")
    error_samples(sc, ERROR_SAMPLES_PER_RUN).write.parquet(f"{path}/samples")
    return report_lines(spark.read.parquet(f"{path}/summary"), variants_df(spark), spark.read.parquet(f"{path}/samples"))


@register("s05_summary_csv", with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, SUMMARY_CTE, select=f"""
SELECT row_number() OVER (ORDER BY exact_match_rate DESC NULLS LAST, s.model) - 1 AS line, s.model,
  coalesce(d.precision, '?') AS precision, coalesce(d.backend, '?') AS backend, {", ".join(METRIC_FIELDS)},
  exact_match_rate, schema_valid_rate, latency_median_s, latency_p95_s, n,
  CAST(hits_forward AS VARCHAR) || '/' || CAST(total_forward AS VARCHAR) AS em_forward,
  CAST(hits_inverse AS VARCHAR) || '/' || CAST(total_inverse AS VARCHAR) AS em_inverse,
  CAST(hits_other AS VARCHAR) || '/' || CAST(total_other AS VARCHAR) AS em_other
FROM summary s LEFT JOIN rundim d ON d.name = s.model"""))
def s05_summary_csv(spark, sf_dir):
    """Summary.csv of the precision bench, read back by its header; ``line`` is the place in the file."""
    path = scratch_path(spark, "summary")
    summary = summarize(scored(spark, sf_dir), runs_df(spark))
    summary.write.parquet(f"{path}/rows")
    write_summary_file(spark.read.schema(summary.schema).parquet(f"{path}/rows"), f"{path}/out", SUMMARY_QUANT)
    back = with_file_position(spark.read.option("header", True).csv(f"{path}/out/summary.csv"), "line")
    kinds = {f.name: f.dataType for f in summary.schema.fields}
    return back.select("line", *[F.col(c).cast(kinds[c]).alias(c) for c in SUMMARY_QUANT])


@register("s06_report_file", _report_sql("""
SELECT row_number() OVER (ORDER BY section, rank, ord) - 1 AS line_no, line FROM lines"""))
def s06_report_file(spark, sf_dir):
    """The report written as one file and read back line by line."""
    path = scratch_path(spark, "report-file")
    write_report_file(w07_report_lines(spark, sf_dir), path)
    back = with_file_position(spark.read.text(f"{path}/rapport_quant.md"), "line_no")
    return back.select("line_no", F.col("value").alias("line"))
