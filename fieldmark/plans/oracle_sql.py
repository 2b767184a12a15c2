"""DuckDB oracle SQL for the registered queries.

The oracles recompute every fixture from the raw driver tables and evaluate
the metrics relationally (long tables, joins, GROUP BY), independently of the
array/higher-order-function formulation used by the Spark operators.
Outputs are flat: arrays become sorted joined strings and doubles are rounded
to 9 digits on both sides.
"""

from __future__ import annotations

import re

from fieldmark.sources.dimensions import KPIS, LEVER_KEYS
from fieldmark.sources.fixtures import EVAL_RUNS, PRIORITY_PRODUCT


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_ASC = ", ".join(_LINE_ORDER)
_DESC = ", ".join(c + " DESC" for c in _LINE_ORDER)
_PRODUCT_CASE = "CASE o_orderpriority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_PRODUCT.items()) + " ELSE NULL END"
_RUNS_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(EVAL_RUNS))

# Gold side of F1 in long form.
GOLD_CTES = f"""
li AS (
  SELECT l_orderkey AS row_id, l_partkey, l_discount,
         ({_list(LEVER_KEYS)})[CAST(l_partkey % 9 AS INTEGER) + 1] AS lever_key,
         ({_list(KPIS)})[CAST(l_suppkey % 6 AS INTEGER) + 1] AS kpi,
         CASE WHEN l_returnflag = 'N' THEN 'relative' ELSE 'absolute' END AS ctype,
         CAST(l_quantity AS DOUBLE) AS cvalue,
         CASE WHEN l_returnflag = 'A' THEN 'bps' ELSE '%' END AS cunit,
         CASE WHEN l_linestatus = 'O' THEN 'increase' ELSE 'decrease' END AS cdir,
         {_ASC}
  FROM lineitem
),
g0 AS (
  SELECT o_orderkey AS row_id, o_orderstatus AS st,
         'commande ' || CAST(o_orderkey AS VARCHAR) || ' ' || o_orderpriority || ' ' || o_orderstatus AS text,
         {_PRODUCT_CASE} AS prod
  FROM orders
),
first_line AS (
  SELECT * FROM (
    SELECT row_id, lever_key, kpi, ctype, cvalue, cunit, cdir,
           row_number() OVER (PARTITION BY row_id ORDER BY {_ASC}) AS rn FROM li) WHERE rn = 1
),
gold AS (
  SELECT g0.row_id, g0.text,
         CASE WHEN st = 'O' OR st = 'F' THEN 'simulation' ELSE 'other' END AS g_intent,
         CASE WHEN st = 'O' THEN 'forward' WHEN st = 'F' THEN 'inverse' END AS g_mode,
         CASE WHEN st IN ('O', 'F') THEN prod END AS g_product,
         CASE WHEN st = 'F' THEN f.lever_key END AS g_lever,
         (st = 'F' AND f.row_id IS NOT NULL) AS g_has_goal,
         CASE WHEN st = 'F' THEN f.ctype END AS g_gtype,
         CASE WHEN st = 'F' THEN f.cvalue END AS g_gvalue,
         CASE WHEN st = 'F' THEN f.cunit END AS g_gunit,
         CASE WHEN st = 'F' THEN f.cdir END AS g_gdir,
         CASE WHEN st = 'F' THEN f.kpi END AS g_target
  FROM g0 LEFT JOIN first_line f ON f.row_id = g0.row_id
),
gold_drivers AS (
  SELECT d.row_id, d.lever_key AS k, d.ctype, d.cvalue, d.cunit, d.cdir,
         row_number() OVER (PARTITION BY d.row_id ORDER BY d.lever_key) AS pos,
         count(*) OVER (PARTITION BY d.row_id) AS n
  FROM (SELECT * FROM (
          SELECT row_id, lever_key, ctype, cvalue, cunit, cdir,
                 row_number() OVER (PARTITION BY row_id, lever_key ORDER BY {_DESC}) AS rn FROM li)
        WHERE rn = 1) d
  JOIN gold g ON g.row_id = d.row_id AND g.g_mode = 'forward'
),
gold_targets AS (
  SELECT DISTINCT li.row_id, li.kpi AS t FROM li JOIN gold g ON g.row_id = li.row_id AND g.g_mode = 'forward'
),
gold_terms AS (
  SELECT DISTINCT li.row_id, p.p_name AS u
  FROM li JOIN part p ON p.p_partkey = li.l_partkey
  JOIN gold g ON g.row_id = li.row_id AND g.g_intent = 'simulation'
  WHERE li.l_discount > CAST(0.085 AS DOUBLE)
)"""

# Per-run predictions of F1 in long form.
PRED_CTES = f"""
runs AS (SELECT * FROM (VALUES {_RUNS_VALUES}) t(r, run)),
rg AS (
  SELECT runs.r, runs.run, g.*, coalesce(d.nd, 0) AS nd
  FROM gold g CROSS JOIN runs
  LEFT JOIN (SELECT row_id, count(*) AS nd FROM gold_drivers GROUP BY row_id) d ON d.row_id = g.row_id
),
pbase AS (
  SELECT r, run, row_id, text, g_intent, g_mode,
    CASE WHEN (r = 0 AND row_id % 50 = 7) OR (r = 2 AND row_id % 40 = 0) THEN TRUE ELSE FALSE END AS p_null,
    -- r3 turns some 'other' rows into an empty forward record
    (r = 3 AND g_intent = 'other' AND row_id % 5 = 0) AS r3_fwd,
    ((r = 5 OR r = 6) AND (g_mode = 'inverse' OR g_intent = 'other')) AS as_other,
    CASE WHEN r = 1 AND row_id % 30 = 11 THEN FALSE ELSE TRUE END AS v
  FROM rg
),
pred AS (
  SELECT b.r, b.run, b.row_id, b.text, b.p_null, b.r3_fwd, b.as_other,
    CASE WHEN b.p_null THEN NULL WHEN b.as_other THEN 'other' WHEN b.r3_fwd THEN 'simulation' ELSE g.g_intent END AS p_intent,
    CASE WHEN b.p_null OR b.as_other THEN NULL WHEN b.r3_fwd THEN 'forward'
         WHEN b.r = 3 AND g.g_mode = 'forward' AND b.row_id % 9 = 1 THEN 'inverse' ELSE g.g_mode END AS p_mode,
    CASE WHEN b.p_null OR b.as_other OR b.r3_fwd THEN NULL
         WHEN b.r = 1 AND g.g_mode IN ('forward', 'inverse') AND b.row_id % 4 = 1 THEN
              CASE g.g_product WHEN 'CRED_IMMO' THEN 'CRED_CONSO' WHEN 'CRED_CONSO' THEN 'CRED_PME'
                               WHEN 'CRED_PME' THEN NULL ELSE 'CRED_IMMO' END
         ELSE g.g_product END AS p_product,
    CASE WHEN b.p_null OR b.as_other OR b.r3_fwd THEN NULL
         WHEN b.r = 3 AND g.g_mode = 'inverse' AND b.row_id % 6 = 5 THEN 'FP' ELSE g.g_lever END AS p_lever,
    CASE WHEN b.p_null OR b.as_other OR b.r3_fwd THEN FALSE ELSE g.g_has_goal END AS p_has_goal,
    g.g_gtype AS p_gtype, g.g_gvalue AS p_gvalue, g.g_gunit AS p_gunit,
    CASE WHEN b.r = 3 AND g.g_mode = 'inverse' AND b.row_id % 4 = 0
         THEN CASE WHEN g.g_gdir = 'increase' THEN 'decrease' ELSE 'increase' END ELSE g.g_gdir END AS p_gdir,
    CASE WHEN b.p_null OR b.as_other OR b.r3_fwd THEN NULL
         WHEN b.r = 4 AND g.g_mode = 'inverse' AND b.row_id % 5 = 3 THEN 'pnb' ELSE g.g_target END AS p_target,
    (b.v AND NOT b.p_null) AS valid_json,
    CASE WHEN b.p_null THEN CAST(0.0 AS DOUBLE)
         ELSE CAST((b.row_id * 31 + b.r * 17) % 997 AS DOUBLE) / CAST(100.0 AS DOUBLE)
              + CAST(b.r AS DOUBLE) * CAST(0.25 AS DOUBLE) END AS latency_s
  FROM pbase b JOIN gold g ON g.row_id = b.row_id
),
keep AS (
  -- predictions that carry the gold forward lists (possibly modified)
  SELECT r, row_id FROM pred p WHERE NOT p_null AND NOT as_other AND NOT r3_fwd
),
pred_drivers AS (
  SELECT k.r, d.row_id, d.pos, d.k, d.ctype,
         CASE WHEN k.r = 2 AND d.row_id % 7 = 4 THEN d.cvalue + CAST(1.0 AS DOUBLE) ELSE d.cvalue END AS cvalue,
         d.cunit, d.cdir
  FROM keep k JOIN gold_drivers d ON d.row_id = k.row_id
  WHERE NOT (k.r = 2 AND d.row_id % 5 = 2 AND d.pos = d.n)
  UNION ALL
  SELECT k.r, d.row_id, CASE WHEN d.row_id % 3 = 1 THEN d.n + 1 ELSE 0 END AS pos, d.k, d.ctype, d.cvalue, d.cunit,
         CASE WHEN d.cdir = 'increase' THEN 'decrease' ELSE 'increase' END AS cdir
  FROM keep k JOIN gold_drivers d ON d.row_id = k.row_id
  WHERE k.r = 4 AND d.pos = 1 AND d.row_id % 3 IN (1, 2)
),
pred_targets AS (
  SELECT k.r, t.row_id, t.t FROM keep k JOIN gold_targets t ON t.row_id = k.row_id
  WHERE NOT (k.r = 6 AND t.row_id % 3 = 0)
  UNION
  SELECT k.r, k.row_id, 'pnb' FROM keep k JOIN gold g ON g.row_id = k.row_id
  WHERE k.r = 2 AND g.g_mode = 'forward' AND k.row_id % 6 = 3
),
pred_terms AS (
  SELECT k.r, u.row_id, CASE WHEN k.r = 1 AND u.row_id % 3 = 0 THEN upper(u.u) ELSE u.u END AS u
  FROM keep k JOIN gold_terms u ON u.row_id = k.row_id
  WHERE NOT (k.r = 5 AND u.row_id % 2 = 0)
  UNION
  SELECT k.r, k.row_id, 'livret a' FROM keep k JOIN gold g ON g.row_id = k.row_id
  WHERE k.r = 6 AND g.g_mode = 'forward' AND k.row_id % 4 = 0
)"""

# Relational scoring of every (run, row).
SCORE_CTES = """
pd_last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, row_id, k ORDER BY pos DESC) AS rn
                 FROM pred_drivers) WHERE rn = 1
),
drv_match AS (
  SELECT p.r, p.row_id,
         count(*) AS tp,
         sum(CAST(p.ctype IS NOT DISTINCT FROM g.ctype AS INTEGER)
             + CAST(p.cvalue IS NOT DISTINCT FROM g.cvalue AS INTEGER)
             + CAST(p.cunit IS NOT DISTINCT FROM g.cunit AS INTEGER)
             + CAST(p.cdir IS NOT DISTINCT FROM g.cdir AS INTEGER)) AS eq_fields,
         sum(CASE WHEN p.ctype IS NOT DISTINCT FROM g.ctype AND p.cvalue IS NOT DISTINCT FROM g.cvalue
                   AND p.cunit IS NOT DISTINCT FROM g.cunit AND p.cdir IS NOT DISTINCT FROM g.cdir
                  THEN 1 ELSE 0 END) AS full_eq,
         avg((CAST(p.ctype IS NOT DISTINCT FROM g.ctype AS INTEGER)
             + CAST(p.cvalue IS NOT DISTINCT FROM g.cvalue AS INTEGER)
             + CAST(p.cunit IS NOT DISTINCT FROM g.cunit AS INTEGER)
             + CAST(p.cdir IS NOT DISTINCT FROM g.cdir AS INTEGER)) / CAST(4.0 AS DOUBLE)) AS acc
  FROM pd_last p JOIN gold_drivers g ON g.row_id = p.row_id AND g.k = p.k
  GROUP BY p.r, p.row_id
),
drv_np AS (SELECT r, row_id, count(*) AS np FROM pd_last GROUP BY r, row_id),
tgt_tp AS (SELECT p.r, p.row_id, count(*) AS tp FROM pred_targets p
           JOIN gold_targets g ON g.row_id = p.row_id AND g.t = p.t GROUP BY p.r, p.row_id),
tgt_np AS (SELECT r, row_id, count(*) AS np FROM pred_targets GROUP BY r, row_id),
tgt_ng AS (SELECT row_id, count(*) AS ng FROM gold_targets GROUP BY row_id),
pu AS (SELECT DISTINCT r, row_id, lower(u) AS u FROM pred_terms),
gu AS (SELECT DISTINCT row_id, lower(u) AS u FROM gold_terms),
unk_tp AS (SELECT p.r, p.row_id, count(*) AS tp FROM pu p JOIN gu g ON g.row_id = p.row_id AND g.u = p.u
           GROUP BY p.r, p.row_id),
unk_np AS (SELECT r, row_id, count(*) AS np FROM pu GROUP BY r, row_id),
unk_ng AS (SELECT row_id, count(*) AS ng FROM gu GROUP BY row_id),
joined AS (
  SELECT p.*, g.g_intent, g.g_mode, g.g_product, g.g_lever, g.g_has_goal, g.g_gtype, g.g_gvalue, g.g_gunit,
         g.g_gdir, g.g_target,
         CASE WHEN p.p_intent = 'other' THEN 'other' WHEN p.p_mode = 'forward' THEN 'forward'
              WHEN p.p_mode = 'inverse' THEN 'inverse' ELSE 'base' END AS p_branch,
         CASE WHEN g.g_intent = 'other' THEN 'other' WHEN g.g_mode = 'forward' THEN 'forward'
              WHEN g.g_mode = 'inverse' THEN 'inverse' ELSE 'base' END AS g_branch,
         coalesce(dm.tp, 0) AS d_tp, coalesce(dn.np, 0) AS d_np, g.nd AS d_ng, dm.acc AS d_acc,
         coalesce(dm.full_eq, 0) AS d_full,
         coalesce(tt.tp, 0) AS t_tp, coalesce(tn.np, 0) AS t_np, coalesce(tg.ng, 0) AS t_ng,
         coalesce(ut.tp, 0) AS u_tp, coalesce(un.np, 0) AS u_np, coalesce(ug.ng, 0) AS u_ng
  FROM pred p
  JOIN rg g ON g.row_id = p.row_id AND g.r = p.r
  LEFT JOIN drv_match dm ON dm.r = p.r AND dm.row_id = p.row_id
  LEFT JOIN drv_np dn ON dn.r = p.r AND dn.row_id = p.row_id
  LEFT JOIN tgt_tp tt ON tt.r = p.r AND tt.row_id = p.row_id
  LEFT JOIN tgt_np tn ON tn.r = p.r AND tn.row_id = p.row_id
  LEFT JOIN tgt_ng tg ON tg.row_id = p.row_id
  LEFT JOIN unk_tp ut ON ut.r = p.r AND ut.row_id = p.row_id
  LEFT JOIN unk_np un ON un.r = p.r AND un.row_id = p.row_id
  LEFT JOIN unk_ng ug ON ug.row_id = p.row_id
),
scored AS (
  SELECT run, row_id, text, g_intent, g_mode, p_null, valid_json, latency_s,
    p_intent IS NOT DISTINCT FROM g_intent AS intent_correct,
    CASE WHEN g_intent = 'other' THEN p_intent IS NOT DISTINCT FROM 'other' END AS other_recall,
    CASE WHEN g_intent = 'simulation' THEN p_mode IS NOT DISTINCT FROM g_mode END AS mode_correct,
    p_product IS NOT DISTINCT FROM g_product AS product_id_correct,
    CASE WHEN g_mode = 'forward' THEN CASE WHEN d_np = 0 THEN 1.0 ELSE d_tp / CAST(d_np AS DOUBLE) END END
      AS drivers_precision,
    CASE WHEN g_mode = 'forward' THEN CASE WHEN d_ng = 0 THEN 1.0 ELSE d_tp / CAST(d_ng AS DOUBLE) END END
      AS drivers_recall,
    CASE WHEN g_mode = 'forward' THEN d_acc END AS drivers_change_accuracy,
    CASE WHEN g_mode = 'forward' THEN CASE WHEN t_np = 0 THEN 1.0 ELSE t_tp / CAST(t_np AS DOUBLE) END END
      AS targets_precision,
    CASE WHEN g_mode = 'forward' THEN CASE WHEN t_ng = 0 THEN 1.0 ELSE t_tp / CAST(t_ng AS DOUBLE) END END
      AS targets_recall,
    CASE WHEN g_mode = 'inverse' THEN p_lever IS NOT DISTINCT FROM g_lever END AS lever_correct,
    CASE WHEN g_mode = 'inverse' THEN
      (NOT p_has_goal AND NOT g_has_goal)
      OR (p_has_goal AND g_has_goal AND p_gtype IS NOT DISTINCT FROM g_gtype
          AND p_gvalue IS NOT DISTINCT FROM g_gvalue AND p_gunit IS NOT DISTINCT FROM g_gunit
          AND p_gdir IS NOT DISTINCT FROM g_gdir) END AS goal_correct,
    CASE WHEN g_mode = 'inverse' THEN p_target IS NOT DISTINCT FROM g_target END AS target_correct,
    CASE WHEN u_np = 0 THEN 1.0 ELSE u_tp / CAST(u_np AS DOUBLE) END AS unknown_terms_precision,
    CASE WHEN u_ng = 0 THEN 1.0 ELSE u_tp / CAST(u_ng AS DOUBLE) END AS unknown_terms_recall,
    (p_branch = g_branch AND u_np = u_ng AND u_tp = u_np
     AND (p_branch = 'other' OR (p_intent IS NOT DISTINCT FROM g_intent AND p_mode IS NOT DISTINCT FROM g_mode
                                 AND p_product IS NOT DISTINCT FROM g_product))
     AND (p_branch <> 'forward' OR (d_np = d_ng AND d_full = d_np AND t_np = t_ng AND t_tp = t_np))
     AND (p_branch <> 'inverse' OR (p_lever IS NOT DISTINCT FROM g_lever AND p_target IS NOT DISTINCT FROM g_target
          AND ((NOT p_has_goal AND NOT g_has_goal)
               OR (p_has_goal AND g_has_goal AND p_gtype IS NOT DISTINCT FROM g_gtype
                   AND p_gvalue IS NOT DISTINCT FROM g_gvalue AND p_gunit IS NOT DISTINCT FROM g_gunit
                   AND p_gdir IS NOT DISTINCT FROM g_gdir))))) AS exact_match,
    (valid_json AND NOT p_null) AS schema_valid,
    CASE WHEN g_intent = 'other' THEN 'other' ELSE g_mode END AS gtype
  FROM joined
)"""


def _definitions(block: str) -> dict[str, str]:
    """Name and body (in parentheses) of each CTE of a block."""
    out, at = {}, 0
    while m := re.compile(r"\s*,?\s*(?:--[^\n]*\n\s*)*(\w+)\s+AS\s+(?:MATERIALIZED\s+)?\(", re.I).match(block, at):
        depth, i, quoted = 1, m.end(), False
        while depth:
            c = block[i]
            if c == "'":
                quoted = not quoted
            elif not quoted and block.startswith("--", i):
                i = block.index("\n", i)
            elif not quoted:
                depth += (c == "(") - (c == ")")
            i += 1
        out[m[1]] = block[m.end() - 1:i]
        at = i
    if block[at:].strip(" \n,"):
        raise ValueError(f"not a list of CTEs: {block[at:at + 80]!r}")
    return out


def with_ctes(*blocks: str, select: str) -> str:
    """The CTEs that ``select`` needs, in order, each computed once."""
    found: dict[str, str] = {}
    for block in blocks:
        found |= _definitions(block)
    needed, texts = set(), [select]
    while texts:
        used = set(re.findall(r"\w+", texts.pop())) & found.keys() - needed
        needed |= used
        texts += [found[name] for name in used]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED {body}" for n, body in found.items() if n in needed) + "\n" + select


def scored_sql(select: str) -> str:
    """SQL over the relational ``scored`` table (one row per run and example)."""
    return with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, select=select)


# ---------------------------------------------------------------------------
# F2 raw outputs and their cleaning (P1-P6), evaluated with DuckDB's JSON functions
# ---------------------------------------------------------------------------

def _raw_ctes() -> str:
    from fieldmark.sources.dimensions import CHANGE_DIRECTIONS, CHANGE_TYPES, CHANGE_UNITS, PRODUCTS
    from fieldmark.sources.fixtures import RAW_CASES, THINK_PREFIX, TRAILING_TEXT, UNCLOSED_PREFIX

    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def num(v: str) -> str:
        return (f"CASE WHEN c = 5 THEN '\"' ELSE '' END || CASE WHEN c = 4 THEN '-' ELSE '' END"
                f" || CAST(CAST({v} AS BIGINT) AS VARCHAR) || CASE WHEN c = 5 THEN '\"' ELSE '' END")

    def jstr(v: str) -> str:
        return f"CASE WHEN {v} IS NULL THEN 'null' ELSE '\"' || {v} || '\"' END"

    in_list = lambda xs: "(" + ", ".join(lit(x) for x in xs) + ")"
    return f"""
raw_base AS (
  SELECT runs.r, runs.run, g.*, CAST((g.row_id * 7 + runs.r) % {RAW_CASES} AS INTEGER) AS c
  FROM gold g CROSS JOIN runs
),
raw_drv AS (
  SELECT b.r, b.row_id,
         string_agg('{{"entity_key": "' || d.k || '", "change": {{"type": "' || d.ctype || '", "value": '
                    || {num('d.cvalue')} || ', "unit": "' || d.cunit || '", "direction": "' || d.cdir || '"}}}}',
                    ', ' ORDER BY d.pos) AS dj,
         count(*) AS nd
  FROM raw_base b JOIN gold_drivers d ON d.row_id = b.row_id GROUP BY b.r, b.row_id
),
raw_tgt AS (SELECT row_id, '[' || string_agg('"' || t || '"', ', ' ORDER BY t) || ']' AS tj
            FROM gold_targets GROUP BY row_id),
raw_terms AS (
  SELECT b.r, b.row_id,
         '[' || string_agg('"' || CASE WHEN b.c = 8 THEN upper(u.u) ELSE u.u END || '"', ', ' ORDER BY u.u) || ']' AS uj
  FROM raw_base b JOIN gold_terms u ON u.row_id = b.row_id GROUP BY b.r, b.row_id
),
raw_body AS (
  SELECT b.r, b.run, b.row_id, b.text, b.c,
    CASE WHEN b.c = 7 THEN '' ELSE '"intent": ' || {jstr('b.g_intent')} || ', ' END AS ij,
    CASE WHEN b.c = 6 THEN '"sideways"' ELSE {jstr('b.g_mode')} END AS mj,
    b.g_intent, b.g_mode, b.g_product, b.g_lever, b.g_has_goal, b.g_gtype, b.g_gvalue, b.g_gunit, b.g_gdir,
    b.g_target, coalesce(d.dj, '') AS dj, coalesce(d.nd, 0) AS nd, coalesce(t.tj, '[]') AS tj,
    coalesce(u.uj, '[]') AS uj
  FROM raw_base b
  LEFT JOIN raw_drv d ON d.r = b.r AND d.row_id = b.row_id
  LEFT JOIN raw_tgt t ON t.row_id = b.row_id
  LEFT JOIN raw_terms u ON u.r = b.r AND u.row_id = b.row_id
),
raw_json AS (
  SELECT r, run, row_id, text, c,
    CASE WHEN g_intent = 'other' THEN
      CASE WHEN c = 8 THEN '{{"intent": "other", "mode": "forward", "product_id": "CRED_IMMO", "drivers": [], "unknown_terms": ["reste"]}}'
           ELSE '{{' || ij || '"mode": ' || mj || ', "product_id": null, "drivers": null, "targets": null, "lever": null, "goal": null, "target": null, "unknown_terms": []}}' END
    ELSE '{{' || ij || '"mode": ' || mj || ', "product_id": ' || {jstr('g_product')}
      || ', "drivers": ' || CASE WHEN g_mode = 'forward' THEN '[' || CASE WHEN c = 9 THEN '42, "x"' || CASE WHEN nd > 0 THEN ', ' ELSE '' END ELSE '' END || dj || ']' ELSE 'null' END
      || ', "targets": ' || CASE WHEN g_mode = 'forward' THEN tj ELSE 'null' END
      || ', "lever": ' || CASE WHEN g_mode = 'inverse' AND g_lever IS NOT NULL THEN '{{"entity_key": "' || g_lever || '"}}' ELSE 'null' END
      || ', "goal": ' || CASE WHEN g_mode = 'inverse' AND g_has_goal THEN '{{"type": "' || g_gtype || '", "value": ' || {num('g_gvalue')} || ', "unit": "' || g_gunit || '", "direction": "' || g_gdir || '"}}' ELSE 'null' END
      || ', "target": ' || CASE WHEN g_mode = 'inverse' THEN {jstr('g_target')} ELSE 'null' END
      || ', "unknown_terms": ' || uj || '}}'
    END AS body
  FROM raw_body
),
raw AS (
  SELECT r, run, row_id, text, c,
    CASE c WHEN 1 THEN {lit(THINK_PREFIX)} || body
           WHEN 2 THEN left(body, length(body) - 1)
           WHEN 3 THEN '[' || body || ']'
           WHEN 10 THEN body || {lit(TRAILING_TEXT)}
           WHEN 11 THEN {lit(UNCLOSED_PREFIX)} || body
           ELSE body END AS raw
  FROM raw_json
),
stripped AS (
  SELECT *, regexp_replace(regexp_replace(raw, '<think>.*?</think>', '', 'gs'), '^\\s+|\\s+$', '', 'g') AS txt
  FROM raw
),
parsed AS (
  SELECT r, run, row_id, text, raw, txt,
         CASE WHEN json_valid(txt) AND json_type(txt) = 'OBJECT' THEN CAST(txt AS JSON) END AS j
  FROM stripped
),
obj AS (
  SELECT *,
    (json_type(j, '$.intent') = 'VARCHAR' AND j->>'$.intent' = 'other') AS is_other,
    coalesce(json_type(j, '$.mode') = 'VARCHAR' AND j->>'$.mode' = 'forward', FALSE) AS fwd,
    coalesce(json_type(j, '$.mode') = 'VARCHAR' AND j->>'$.mode' = 'inverse', FALSE) AS inv
  FROM parsed WHERE j IS NOT NULL
),
elems AS (
  SELECT o.r, o.row_id, 'd' AS kind, e.i, e.v FROM obj o,
    LATERAL (SELECT generate_subscripts(json_extract(o.j, '$.drivers[*]'), 1) AS i,
                    unnest(json_extract(o.j, '$.drivers[*]')) AS v) e
  WHERE o.fwd AND NOT coalesce(o.is_other, FALSE)
  UNION ALL
  SELECT o.r, o.row_id, 't', e.i, e.v FROM obj o,
    LATERAL (SELECT generate_subscripts(json_extract(o.j, '$.targets[*]'), 1) AS i,
                    unnest(json_extract(o.j, '$.targets[*]')) AS v) e
  WHERE o.fwd AND NOT coalesce(o.is_other, FALSE)
  UNION ALL
  SELECT o.r, o.row_id, 'u', e.i, e.v FROM obj o,
    LATERAL (SELECT generate_subscripts(json_extract(o.j, '$.unknown_terms[*]'), 1) AS i,
                    unnest(json_extract(o.j, '$.unknown_terms[*]')) AS v) e
  WHERE NOT coalesce(o.is_other, FALSE)
),
drv AS (
  SELECT r, row_id, i, v->>'$.entity_key' AS k, v->'$.change' AS ch,
    json_type(v, '$.entity_key') = 'VARCHAR' AS k_is_str
  FROM elems WHERE kind = 'd' AND json_type(v) = 'OBJECT'
),
drv_c AS (
  SELECT *,
    CASE WHEN json_type(ch, '$.value') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN abs(CAST(ch->>'$.value' AS DOUBLE))
         WHEN json_type(ch, '$.value') = 'VARCHAR' THEN TRY_CAST(trim(ch->>'$.value') AS DOUBLE) END AS cvalue,
    coalesce(json_type(ch) = 'OBJECT' AND json_type(ch, '$.type') = 'VARCHAR' AND ch->>'$.type' IN {in_list(CHANGE_TYPES)}
      AND (json_type(ch, '$.value') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
           OR (json_type(ch, '$.value') = 'VARCHAR' AND TRY_CAST(trim(ch->>'$.value') AS DOUBLE) IS NOT NULL))
      AND json_type(ch, '$.unit') = 'VARCHAR' AND ch->>'$.unit' IN {in_list(CHANGE_UNITS)}
      AND json_type(ch, '$.direction') = 'VARCHAR' AND ch->>'$.direction' IN {in_list(CHANGE_DIRECTIONS)}, FALSE)
      AS change_ok
  FROM drv
),
drv_agg AS (
  SELECT r, row_id,
    string_agg(coalesce(k, '') || ':' || coalesce(ch->>'$.type', '') || ':' || coalesce(CAST(cvalue AS VARCHAR), '')
               || ':' || coalesce(ch->>'$.unit', '') || ':' || coalesce(ch->>'$.direction', ''), '|'
               ORDER BY coalesce(k, '') || ':' || coalesce(ch->>'$.type', '') || ':' || coalesce(CAST(cvalue AS VARCHAR), '')
               || ':' || coalesce(ch->>'$.unit', '') || ':' || coalesce(ch->>'$.direction', '')) AS drivers,
    count(*) AS n_drivers,
    bool_and(coalesce(k_is_str AND k IN {in_list(LEVER_KEYS)}, FALSE) AND change_ok) AS drivers_ok
  FROM drv_c GROUP BY r, row_id
),
tgt_agg AS (
  SELECT r, row_id, string_agg(v->>'$', '|' ORDER BY v->>'$') AS targets,
    bool_and(coalesce(json_type(v) = 'VARCHAR' AND v->>'$' IN {in_list(KPIS)}, FALSE)) AS targets_ok
  FROM elems WHERE kind = 't' GROUP BY r, row_id
),
term_agg AS (
  SELECT r, row_id, string_agg(lower(v->>'$'), '|' ORDER BY lower(v->>'$')) AS terms,
    bool_and(coalesce(json_type(v) = 'VARCHAR', FALSE)) AS terms_ok
  FROM elems WHERE kind = 'u' GROUP BY r, row_id
),
cleaned AS (
  SELECT p.run, p.row_id, p.raw, p.txt, p.j IS NOT NULL AS parsed,
    o.is_other, o.fwd, o.inv,
    CASE WHEN p.j IS NULL THEN NULL WHEN coalesce(o.is_other, FALSE) THEN 'other' ELSE 'simulation' END AS intent,
    CASE WHEN p.j IS NULL OR coalesce(o.is_other, FALSE) THEN NULL ELSE o.j->>'$.mode' END AS mode,
    CASE WHEN p.j IS NULL OR coalesce(o.is_other, FALSE) THEN NULL ELSE o.j->>'$.product_id' END AS product_id,
    CASE WHEN o.fwd AND NOT coalesce(o.is_other, FALSE) THEN coalesce(da.drivers, '') END AS drivers,
    CASE WHEN o.fwd AND NOT coalesce(o.is_other, FALSE) THEN coalesce(da.n_drivers, 0) END AS n_drivers,
    CASE WHEN o.fwd AND NOT coalesce(o.is_other, FALSE) THEN coalesce(ta.targets, '') END AS targets,
    CASE WHEN p.j IS NULL THEN NULL ELSE coalesce(ua.terms, '') END AS terms,
    CASE WHEN o.inv AND NOT coalesce(o.is_other, FALSE) THEN o.j->>'$.lever.entity_key' END AS lever,
    CASE WHEN o.inv AND NOT coalesce(o.is_other, FALSE) AND json_type(o.j, '$.goal') = 'OBJECT' THEN
      coalesce(o.j->>'$.goal.type', '') || ':' ||
      coalesce(CAST(CASE WHEN json_type(o.j, '$.goal.value') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
                         THEN abs(CAST(o.j->>'$.goal.value' AS DOUBLE))
                         WHEN json_type(o.j, '$.goal.value') = 'VARCHAR'
                         THEN TRY_CAST(trim(o.j->>'$.goal.value') AS DOUBLE) END AS VARCHAR), '') || ':' ||
      coalesce(o.j->>'$.goal.unit', '') || ':' || coalesce(o.j->>'$.goal.direction', '') END AS goal,
    CASE WHEN o.inv AND NOT coalesce(o.is_other, FALSE) THEN o.j->>'$.target' END AS target,
    coalesce(ua.terms_ok, TRUE) AS terms_ok,
    coalesce(o.is_other, FALSE) OR (
      (json_type(o.j, '$.product_id') IS NULL OR json_type(o.j, '$.product_id') = 'NULL'
       OR (json_type(o.j, '$.product_id') = 'VARCHAR' AND o.j->>'$.product_id' IN {in_list(PRODUCTS)}))
      AND (o.fwd OR o.inv)
      AND (NOT o.fwd OR (coalesce(da.drivers_ok, TRUE) AND coalesce(ta.targets_ok, TRUE)))
      AND (NOT o.inv OR (
        coalesce(json_type(o.j, '$.lever') = 'OBJECT' AND json_type(o.j, '$.lever.entity_key') = 'VARCHAR'
                 AND o.j->>'$.lever.entity_key' IN {in_list(LEVER_KEYS)}, FALSE)
        AND coalesce(json_type(o.j, '$.goal') = 'OBJECT'
          AND json_type(o.j, '$.goal.type') = 'VARCHAR' AND o.j->>'$.goal.type' IN {in_list(CHANGE_TYPES)}
          AND (json_type(o.j, '$.goal.value') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
               OR (json_type(o.j, '$.goal.value') = 'VARCHAR' AND TRY_CAST(trim(o.j->>'$.goal.value') AS DOUBLE) IS NOT NULL))
          AND json_type(o.j, '$.goal.unit') = 'VARCHAR' AND o.j->>'$.goal.unit' IN {in_list(CHANGE_UNITS)}
          AND json_type(o.j, '$.goal.direction') = 'VARCHAR' AND o.j->>'$.goal.direction' IN {in_list(CHANGE_DIRECTIONS)}, FALSE)
        AND coalesce(json_type(o.j, '$.target') = 'VARCHAR' AND o.j->>'$.target' IN {in_list(KPIS)}, FALSE)))
    ) AS rec_ok
  FROM parsed p
  LEFT JOIN obj o ON o.r = p.r AND o.row_id = p.row_id
  LEFT JOIN drv_agg da ON da.r = p.r AND da.row_id = p.row_id
  LEFT JOIN tgt_agg ta ON ta.r = p.r AND ta.row_id = p.row_id
  LEFT JOIN term_agg ua ON ua.r = p.r AND ua.row_id = p.row_id
),
finalized AS (
  SELECT run, row_id, raw, txt, parsed,
    parsed AND terms_ok AS has_pred,
    coalesce(parsed AND terms_ok AND rec_ok, FALSE) AS valid,
    intent, mode, product_id, drivers, n_drivers, targets, terms, lever, goal, target
  FROM cleaned
)"""


def cleaned_sql(select: str) -> str:
    return with_ctes(GOLD_CTES, PRED_CTES, _raw_ctes(), select=select)


def _fold_sql(x: str) -> str:
    """T1 folding for accented Latin text (the oracle data is restricted to it)."""
    return f"lower(regexp_replace(strip_accents({x}), '^\\s+|\\s+$', '', 'g'))"


def surface_sql(select: str) -> str:
    from fieldmark.functions.cleaning import _FLOAT_RE
    from fieldmark.sources.dimensions import DIRECTION_DOWN, DIRECTION_UP, UNIT_BPS, UNIT_PCT
    from fieldmark.sources.fixtures import DIRECTION_SAMPLES, UNIT_SAMPLES

    def in_list(xs):
        return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"

    fre = _FLOAT_RE.replace("'", "''")
    t = "regexp_replace(replace(value_text, ',', '.'), '^\\s+|\\s+$', '', 'g')"
    return f"""WITH s0 AS (
  SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS line,
    ({_list(UNIT_SAMPLES)})[CAST(l_partkey % {len(UNIT_SAMPLES)} AS INTEGER) + 1] AS unit_text,
    ({_list(DIRECTION_SAMPLES)})[CAST(l_suppkey % {len(DIRECTION_SAMPLES)} AS INTEGER) + 1] AS direction_text,
    CASE l_partkey % 8
      WHEN 0 THEN CAST(l_quantity AS VARCHAR)
      WHEN 1 THEN replace(CAST(l_discount AS VARCHAR), '.', ',')
      WHEN 2 THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' '
      WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' bps'
      WHEN 4 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'd'
      WHEN 5 THEN '1_' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
      WHEN 6 THEN '-' || CAST(l_tax AS VARCHAR)
      ELSE 'abc' END AS value_text
  FROM lineitem
),
surfaces AS (
  SELECT *,
    CASE WHEN {_fold_sql('unit_text')} IN {in_list(UNIT_BPS)} THEN 'bps'
         WHEN {_fold_sql('unit_text')} IN {in_list(UNIT_PCT)} OR contains(unit_text, '%') THEN '%' END AS unit,
    CASE WHEN {_fold_sql('direction_text')} IN {in_list(DIRECTION_UP)} THEN 'increase'
         WHEN {_fold_sql('direction_text')} IN {in_list(DIRECTION_DOWN)} THEN 'decrease' END AS direction,
    CASE WHEN regexp_matches({t}, '{fre}') THEN TRY_CAST(replace({t}, '_', '') AS DOUBLE) END AS value
  FROM s0
)
{select}"""


def linking_sql(select: str) -> str:
    """Spans of F3 and the exact / phrase / reverse matches, evaluated by brute force."""
    from fieldmark.sources.dimensions import DICTIONARY
    from fieldmark.sources.fixtures import SPAN_VARIANTS

    dict_values = ", ".join("('" + s.replace("'", "''") + "', '" + c + "', " + str(i) + ")"
                            for i, (s, c) in enumerate(DICTIONARY))
    surf = "(" + _list([s for s, _ in DICTIONARY]) + ")"
    n = len(DICTIONARY)
    return f"""WITH dict AS (SELECT * FROM (VALUES {dict_values}) t(surface, canonical, ord)),
lookup AS (SELECT {_fold_sql('surface')} AS surface, arg_max(canonical, ord) AS canonical, min(ord) AS ord,
                  length({_fold_sql('surface')}) AS len
           FROM dict GROUP BY {_fold_sql('surface')}),
s0 AS (
  SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS line,
         {surf}[CAST(l_partkey % {n} AS INTEGER) + 1] AS base,
         {surf}[CAST(l_orderkey % {n} AS INTEGER) + 1] AS other,
         l_suppkey % {SPAN_VARIANTS} AS v
  FROM lineitem
),
spans AS (
  SELECT row_id, line, CASE v
    WHEN 0 THEN base WHEN 1 THEN upper(base) WHEN 2 THEN 'le ' || base || ' total'
    WHEN 3 THEN left(base, greatest(4, length(base) - 3))
    WHEN 4 THEN left(base, length(base) // 2) || 'x' || substr(base, length(base) // 2 + 2)
    WHEN 5 THEN replace(base, 'e', 'é') WHEN 6 THEN base || 's' WHEN 7 THEN 'la ' || base
    WHEN 8 THEN base || ' et ' || other ELSE substr(base, 2, 3) END AS span
  FROM s0
),
sn AS (SELECT DISTINCT {_fold_sql('span')} AS n FROM spans),
exact AS (SELECT sn.n, l.canonical FROM sn JOIN lookup l ON l.surface = sn.n),
t4 AS (SELECT sn.n, l.len, l.ord, l.canonical FROM sn JOIN lookup l
       ON regexp_matches(sn.n, '\\b' || regexp_escape(l.surface) || '\\b')),
t5 AS (SELECT sn.n, l.len, l.ord, l.canonical FROM sn JOIN lookup l
       ON length(sn.n) >= 4 AND contains(l.surface, sn.n)),
t4_best AS (SELECT n, arg_max(canonical, len * 1000 - ord) AS canonical FROM t4 GROUP BY n),
t5_best AS (SELECT n, arg_max(canonical, len * 1000 - ord) AS canonical FROM t5 GROUP BY n),
contain AS (SELECT n, arg_max(canonical, len * 1000 - ord) AS canonical
            FROM (SELECT * FROM t4 UNION ALL SELECT * FROM t5) GROUP BY n),
cascade AS (
  SELECT sn.n, coalesce(e.canonical, CASE WHEN sn.n <> '' THEN c.canonical END) AS key,
         CASE WHEN e.canonical IS NOT NULL THEN 'exact' WHEN sn.n <> '' AND c.canonical IS NOT NULL THEN 'contain' END AS path
  FROM sn LEFT JOIN exact e ON e.n = sn.n LEFT JOIN contain c ON c.n = sn.n
)
{select}"""


DIFF_CTES = """
raw_terms_tp AS (SELECT p.r, p.row_id, count(*) AS tp FROM pred_terms p
                 JOIN gold_terms g ON g.row_id = p.row_id AND g.u = p.u GROUP BY p.r, p.row_id),
raw_terms_np AS (SELECT r, row_id, count(*) AS np FROM pred_terms GROUP BY r, row_id),
raw_terms_ng AS (SELECT row_id, count(*) AS ng FROM gold_terms GROUP BY row_id),
diffs AS (
  SELECT j.run, j.row_id,
    CASE WHEN j.p_intent IS DISTINCT FROM j.g_intent THEN 'intent'
         WHEN j.g_intent = 'other' THEN ''
         ELSE concat_ws('|',
           CASE WHEN j.p_mode IS DISTINCT FROM j.g_mode THEN 'mode' END,
           CASE WHEN j.p_product IS DISTINCT FROM j.g_product THEN 'product_id' END,
           CASE WHEN j.g_mode = 'forward' AND NOT (j.d_np = j.d_ng AND j.d_full = j.d_np) THEN 'drivers' END,
           CASE WHEN j.g_mode = 'forward' AND NOT (j.t_np = j.t_ng AND j.t_tp = j.t_np) THEN 'targets' END,
           CASE WHEN j.g_mode = 'inverse' AND j.p_lever IS DISTINCT FROM j.g_lever THEN 'lever' END,
           CASE WHEN j.g_mode = 'inverse' AND NOT ((NOT j.p_has_goal AND NOT j.g_has_goal)
                 OR (j.p_has_goal AND j.g_has_goal AND j.p_gtype IS NOT DISTINCT FROM j.g_gtype
                     AND j.p_gvalue IS NOT DISTINCT FROM j.g_gvalue AND j.p_gunit IS NOT DISTINCT FROM j.g_gunit
                     AND j.p_gdir IS NOT DISTINCT FROM j.g_gdir)) THEN 'goal' END,
           CASE WHEN j.g_mode = 'inverse' AND j.p_target IS DISTINCT FROM j.g_target THEN 'target' END,
           CASE WHEN NOT (coalesce(rn.np, 0) = coalesce(rg2.ng, 0) AND coalesce(rt.tp, 0) = coalesce(rn.np, 0))
                THEN 'unknown_terms' END)
    END AS fields,
    s.exact_match
  FROM joined j
  JOIN scored s ON s.run = j.run AND s.row_id = j.row_id
  LEFT JOIN raw_terms_tp rt ON rt.r = j.r AND rt.row_id = j.row_id
  LEFT JOIN raw_terms_np rn ON rn.r = j.r AND rn.row_id = j.row_id
  LEFT JOIN raw_terms_ng rg2 ON rg2.row_id = j.row_id
)"""


# The differences as text: one row per differing field, with the JSON of both sides.
DIFF_TEXT_CTES = """
gold_driver_text AS (SELECT row_id, '{' || string_agg('"' || k || '": {"type": "' || ctype || '", "value": ' || CAST(cvalue AS VARCHAR)
    || ', "unit": "' || cunit || '", "direction": "' || cdir || '"}', ', ' ORDER BY pos) || '}' AS t FROM gold_drivers GROUP BY row_id),
first_pos AS (SELECT r, row_id, k, min(pos) AS first FROM pred_drivers GROUP BY r, row_id, k),
pred_driver_text AS (SELECT p.r, p.row_id, '{' || string_agg('"' || p.k || '": {"type": "' || ctype || '", "value": '
    || CAST(cvalue AS VARCHAR) || ', "unit": "' || cunit || '", "direction": "' || cdir || '"}', ', ' ORDER BY f.first) || '}' AS t
  FROM pd_last p JOIN first_pos f ON f.r = p.r AND f.row_id = p.row_id AND f.k = p.k GROUP BY p.r, p.row_id),
gold_target_text AS (SELECT row_id, '["' || string_agg(t, '", "' ORDER BY t) || '"]' AS t FROM gold_targets GROUP BY row_id),
pred_target_text AS (SELECT r, row_id, '["' || string_agg(t, '", "' ORDER BY t) || '"]' AS t FROM pred_targets GROUP BY r, row_id),
gold_term_text AS (SELECT row_id, '["' || string_agg(u, '", "' ORDER BY u) || '"]' AS t FROM gold_terms GROUP BY row_id),
pred_term_text AS (SELECT r, row_id, '["' || string_agg(u, '", "' ORDER BY u) || '"]' AS t FROM pred_terms GROUP BY r, row_id),
fielded AS (SELECT run, row_id, string_split(fields, '|') AS fs FROM diffs WHERE fields <> ''),
each_field AS (SELECT run, row_id, fs[i] AS field, i - 1 AS pos FROM (
    SELECT run, row_id, fs, unnest(range(1, len(fs) + 1)) AS i FROM fielded)),
difflines AS (
  SELECT e.run, e.row_id, e.pos, e.field,
    CASE e.field WHEN 'intent' THEN coalesce(j.g_intent, 'None')
      WHEN 'mode' THEN coalesce('"' || j.g_mode || '"', 'null') WHEN 'product_id' THEN coalesce('"' || j.g_product || '"', 'null')
      WHEN 'drivers' THEN coalesce(gd.t, '{}') WHEN 'targets' THEN coalesce(gt.t, '[]')
      WHEN 'lever' THEN coalesce('"' || j.g_lever || '"', 'null') WHEN 'target' THEN coalesce('"' || j.g_target || '"', 'null')
      WHEN 'goal' THEN CASE WHEN j.g_has_goal THEN '{"type": "' || j.g_gtype || '", "value": ' || CAST(j.g_gvalue AS VARCHAR)
        || ', "unit": "' || j.g_gunit || '", "direction": "' || j.g_gdir || '"}' ELSE 'null' END
      ELSE coalesce(gu.t, '[]') END AS expected,
    CASE e.field WHEN 'intent' THEN coalesce(j.p_intent, 'None')
      WHEN 'mode' THEN coalesce('"' || j.p_mode || '"', 'null') WHEN 'product_id' THEN coalesce('"' || j.p_product || '"', 'null')
      WHEN 'drivers' THEN coalesce(pd.t, '{}') WHEN 'targets' THEN coalesce(pt.t, '[]')
      WHEN 'lever' THEN coalesce('"' || j.p_lever || '"', 'null') WHEN 'target' THEN coalesce('"' || j.p_target || '"', 'null')
      WHEN 'goal' THEN CASE WHEN j.p_has_goal THEN '{"type": "' || j.p_gtype || '", "value": ' || CAST(j.p_gvalue AS VARCHAR)
        || ', "unit": "' || j.p_gunit || '", "direction": "' || j.p_gdir || '"}' ELSE 'null' END
      ELSE coalesce(pu2.t, '[]') END AS got
  FROM each_field e JOIN joined j ON j.run = e.run AND j.row_id = e.row_id
  LEFT JOIN gold_driver_text gd ON gd.row_id = j.row_id LEFT JOIN pred_driver_text pd ON pd.r = j.r AND pd.row_id = j.row_id
  LEFT JOIN gold_target_text gt ON gt.row_id = j.row_id LEFT JOIN pred_target_text pt ON pt.r = j.r AND pt.row_id = j.row_id
  LEFT JOIN gold_term_text gu ON gu.row_id = j.row_id LEFT JOIN pred_term_text pu2 ON pu2.r = j.r AND pu2.row_id = j.row_id
)"""


def diff_sql(select: str) -> str:
    return with_ctes(GOLD_CTES, PRED_CTES, SCORE_CTES, DIFF_CTES, select=select)
