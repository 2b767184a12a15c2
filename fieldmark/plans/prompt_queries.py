"""Queries M1, M2, M5, M6, M7: prompt tables, batch prediction, model files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fieldmark.operators.prompts import (
    FEW_SHOTS, build_messages, choose_model_files, few_shots_df, leakage, merge_system_long,
)
from fieldmark.plans.catalog import register
from fieldmark.sources import prompt_texts as texts
from fieldmark.sources.dimensions import closed_world_rows
from fieldmark.sources.fixtures import (
    QUANT_TAGS, WANTED_TAGS, gold_records, model_manifest, table,
)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if c is None else str(c) if isinstance(c, int) else _lit(c) for c in r) + ")" for r in rows)


_SHOTS = [(1 + 2 * i, t, json.dumps(g, ensure_ascii=False)) for i, (t, g) in enumerate(FEW_SHOTS)]
_LAST_TURN = 2 * len(FEW_SHOTS) + 1
# The system message by string aggregation over the same dimension rows.
SYSTEM_CTES = f"""
world AS (SELECT * FROM (VALUES {_values(closed_world_rows())}) t(key, kind, ord)),
entries AS (SELECT * FROM (VALUES {_values([e[:3] for e in texts.ENTRIES])}) t(key, description, note)),
names AS (SELECT key, string_agg(s, ', ' ORDER BY pos) AS names
  FROM (VALUES {_values([(e[0], i, s) for e in texts.ENTRIES for i, s in enumerate(e[3])])}) t(key, pos, s) GROUP BY key),
sections AS (SELECT * FROM (VALUES {_values([(k, i, "## " + chr(10).join([t, *notes])) for i, (k, t, notes) in enumerate(texts.SECTIONS)])}) t(kind, section, head)),
wide AS (SELECT kind, max(length(key)) + 2 AS w FROM world GROUP BY kind),
entry AS (SELECT kind, ord, '- ' || rpad(key, w::INTEGER, ' ') || ': ' || description
    || coalesce(chr(10) || repeat(' ', w + 4) || note, '') || chr(10) || repeat(' ', w + 4) || 'Synonymes: ' || names || '.' AS line
  FROM world JOIN wide USING (kind) JOIN entries USING (key) JOIN names USING (key)),
block AS (SELECT section, head || chr(10) || string_agg(line, chr(10) ORDER BY ord) AS t FROM sections JOIN entry USING (kind) GROUP BY section, head),
system AS (SELECT {_lit(texts.SYSTEM_PREAMBLE + chr(10).join(texts.INTRO) + chr(10) * 2)} || string_agg(t, chr(10) || chr(10) ORDER BY section)
  || {_lit(chr(10) * 2 + chr(10).join(texts.DISAMBIGUATION) + chr(10) * 2 + texts.RULES)} AS content FROM block)"""
M01_SQL = f"""
WITH {SYSTEM_CTES},
shots AS (SELECT * FROM (VALUES {_values(_SHOTS)}) t(idx, text, gold)),
prefix AS (SELECT 0 AS idx, 'system' AS role, content FROM system UNION ALL SELECT idx, 'user', text FROM shots
  UNION ALL SELECT idx + 1, 'assistant', gold FROM shots),
q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
msgs AS (
  SELECT q.conv_id, q.turn, p.idx, p.role, p.content FROM q CROSS JOIN prefix p
  UNION ALL
  SELECT conv_id, turn, {_LAST_TURN} AS idx, 'user', text FROM q
)
SELECT conv_id, turn, CAST(idx AS BIGINT) AS idx, role, md5(content) AS content_md5,
       CAST(length(content) AS BIGINT) AS content_len FROM msgs"""


@register("m01_build_messages", M01_SQL)
def m01_build_messages(spark, sf_dir):
    """M1 (+M3, M4 in the content): 20-message prompt for every user turn of the conversations."""
    q = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    m = build_messages(q, "text").select("conv_id", "turn", F.posexplode("messages").alias("idx", "m"))
    return m.select("conv_id", "turn", F.col("idx").cast("long").alias("idx"), F.col("m.role").alias("role"),
                    F.md5(F.col("m.content")).alias("content_md5"),
                    F.length(F.col("m.content")).cast("long").alias("content_len"))


@register("m02_merge_system", """
WITH c AS (SELECT * FROM conversations),
f AS (SELECT conv_id, min(turn) AS t0, arg_min(role, turn) AS r0, arg_min(text, turn) AS sys FROM c GROUP BY conv_id),
u AS (SELECT c.conv_id, min(c.turn) AS tu FROM c JOIN f ON f.conv_id = c.conv_id
      WHERE c.role = 'user' AND c.turn > f.t0 GROUP BY c.conv_id),
m AS (
  SELECT c.conv_id, c.turn, c.role,
         CASE WHEN f.r0 = 'system' AND c.turn = u.tu THEN f.sys || chr(10) || chr(10) || c.text ELSE c.text END AS content
  FROM c JOIN f ON f.conv_id = c.conv_id LEFT JOIN u ON u.conv_id = c.conv_id
  WHERE NOT (f.r0 = 'system' AND c.turn = f.t0)
)
SELECT conv_id, turn, role, md5(content) AS content_md5, CAST(length(content) AS BIGINT) AS content_len FROM m""",
          headline=True)
def m02_merge_system(spark, sf_dir):
    """M2: system message merged into the first user message of each conversation."""
    m = merge_system_long(table(spark, sf_dir, "conversations"))
    return m.select("conv_id", "turn", "role", F.md5("content").alias("content_md5"),
                    F.length("content").cast("long").alias("content_len"))


def _leak_sql() -> str:
    from fieldmark.plans.oracle_sql import GOLD_CTES, _fold_sql, with_ctes

    shots = ", ".join(f"({_lit(t)})" for t, _ in FEW_SHOTS)
    return with_ctes(GOLD_CTES, f"""
shots AS (SELECT DISTINCT {_fold_sql('t')} AS n FROM (VALUES {shots}) v(t)),
texts AS (SELECT DISTINCT text FROM (SELECT text FROM gold UNION ALL SELECT text FROM conversations))""",
                     select=f"SELECT text FROM texts WHERE {_fold_sql('text')} IN (SELECT n FROM shots)")


@register("m05_fewshot_leakage", _leak_sql())
def m05_fewshot_leakage(spark, sf_dir):
    """M5: evaluation / conversation texts equal to a few-shot after folding (expected: none)."""
    texts = gold_records(spark, sf_dir).select("text").unionByName(
        table(spark, sf_dir, "conversations").select("text"))
    return leakage(texts, "text", few_shots_df(spark))


def _manifest_sql() -> str:
    tags = "[" + ", ".join(_lit(t) for t in QUANT_TAGS) + "]"
    wanted = ", ".join(f"({_lit(t)})" for t in WANTED_TAGS)
    return f"""
WITH x AS (
  SELECT 'org/' || p_brand AS repo, p_partkey AS k,
    CASE WHEN p_partkey % 11 = 0 THEN 'mmproj-' ELSE '' END || replace(p_name, ' ', '-') || '-' || p_type || '-'
      || {tags}[CAST(p_partkey % {len(QUANT_TAGS)} AS INTEGER) + 1]
      || CASE WHEN p_partkey % 13 = 0 THEN '-MTP' ELSE '' END AS stem,
    unnest(CASE WHEN p_size % 7 = 0 THEN [1, 2] ELSE [0] END) AS shard
  FROM part
),
manifest AS (
  SELECT repo, 'weights/' || stem || CASE WHEN shard > 0 THEN printf('-%05d-of-00002', shard) ELSE '' END
         || CASE WHEN k % 17 = 0 THEN '.bin' ELSE '.gguf' END AS file FROM x
),
wanted AS (SELECT DISTINCT m.repo, t.quant FROM manifest m CROSS JOIN (VALUES {wanted}) t(quant)),
cand AS (
  SELECT m.repo, w.quant, m.file FROM manifest m JOIN wanted w ON w.repo = m.repo
  WHERE suffix(m.file, '.gguf') AND contains(regexp_extract(m.file, '[^/]*$'), w.quant)
    AND NOT contains(lower(m.file), 'mmproj') AND NOT contains(lower(m.file), 'mtp')
    AND NOT contains(lower(m.file), 'draft')
),
chosen AS (
  SELECT repo, quant, min(file) AS chosen FROM cand GROUP BY repo, quant
),
ch AS (SELECT *, CASE WHEN regexp_matches(chosen, '-(\\d+)-of-(\\d+)\\.gguf$')
                      THEN regexp_replace(chosen, '-(\\d+)-of-(\\d+)\\.gguf$', '') END AS stem FROM chosen)
SELECT w.repo, w.quant, string_agg(c.file, '|' ORDER BY c.file) AS files, count(c.file) AS n_files,
  count(c.file) = 0 AS missing
FROM wanted w LEFT JOIN (
  SELECT c.* FROM cand c JOIN ch ON ch.repo = c.repo AND ch.quant = c.quant
  WHERE (ch.stem IS NULL AND c.file = ch.chosen) OR (ch.stem IS NOT NULL AND starts_with(c.file, ch.stem))
) c ON c.repo = w.repo AND c.quant = w.quant
GROUP BY w.repo, w.quant"""


@register("m07_model_files", _manifest_sql())
def m07_model_files(spark, sf_dir):
    """M7: quantised weight files to fetch per (repo, quant) from a manifest."""
    man = model_manifest(spark, sf_dir)
    wanted = man.select("repo").distinct().select(
        "repo", F.explode(F.array(*[F.lit(t) for t in WANTED_TAGS])).alias("quant"))
    return choose_model_files(man, wanted)


@register("m06_batch_predict")
def m06_batch_predict(spark, sf_dir):
    """M6: prompts of every evaluation example sent to a predictor (Arrow batches),
    answers cleaned and validated.  Rows-only check (latencies are measured)."""
    from fieldmark.operators.inference import echo_gold_predictor_factory, predict_and_clean

    q = gold_records(spark, sf_dir).select("row_id", "text")
    out = predict_and_clean(build_messages(q, "text"), echo_gold_predictor_factory())
    return out.select("row_id", "valid_json", F.col("prediction.intent").alias("intent"),
                      (F.col("latency_raw") >= 0).alias("timed"))
