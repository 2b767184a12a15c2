"""Exact percentiles, nearest association, file positions, report, entry contract."""

import random

import numpy as np
from pyspark.sql import functions as F

from small_tables import SF_SMALL


def test_exact_percentiles(spark):
    from fieldmark.operators.quantiles import exact_percentiles

    rnd = random.Random(3)
    rows = [("a" if rnd.random() < 0.7 else "b", float(rnd.randint(0, 500)) / 7) for _ in range(3000)]
    rows += [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p50, r.p95, r.p100) for r in
           exact_percentiles(df, ["g"], "v", [0.5, 0.95, 1.0], ["p50", "p95", "p100"]).collect()}
    for g in "abc":
        vals = [v for k, v in rows if k == g]
        for have, p in zip(got[g], (50, 95, 100)):
            assert abs(have - float(np.percentile(vals, p))) < 1e-9


def test_nearest_by_position_brute_force(spark):
    from fieldmark.operators.assembly import nearest_by_position

    rnd = random.Random(5)
    rows = []
    for i in range(600):
        rows.append((rnd.randint(0, 3), i, rnd.choice(["L", "V", "U"]), float(rnd.randint(0, 400))))
    df = spark.createDataFrame(rows, "grp int, oid int, kind string, pos double")
    for width in (1e9, 25.0, 3.0):
        got = {r.oid: (r.near_V, r.near_U) for r in nearest_by_position(
            df, ["grp"], "pos", "oid", "kind", "L", ["V", "U"], "oid", bucket_width=width).collect()}
        for g, o, k, p in rows:
            if k != "L":
                continue
            for idx, t in enumerate(("V", "U")):
                cands = [(abs(p2 - p), o2) for g2, o2, k2, p2 in rows if g2 == g and k2 == t]
                want = min(cands)[1] if cands else None
                assert got[o][idx] == want, (width, o, t)


def test_file_positions(spark, tmp_path):
    from fieldmark.sources.io import read_dataset

    d = tmp_path / "ds"
    d.mkdir()
    rows = 0
    for f in ("b.csv", "a.csv"):
        lines = ["text,json"]
        for i in range(5):
            lines.append(f'"{f} line {i}\nsecond","{{""intent"": ""other"", ""unknown_terms"": []}}"')
        (d / f).write_text("\n".join(lines) + "\n")
        rows += 5
    got = sorted((r.row_id, r.text) for r in read_dataset(spark, str(d)).collect())
    assert [r for r, _ in got] == list(range(rows))
    assert got[0][1].startswith("a.csv line 0") and got[5][1].startswith("b.csv line 0")


def test_error_samples_window_group_limit(spark):
    from fieldmark.plans.scoring_queries import scored
    from fieldmark.operators.report import error_samples

    s = error_samples(scored(spark, SF_SMALL), 4)
    assert s.groupBy("run").count().agg(F.max("count")).first()[0] <= 4
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 7
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_stream_scoring_matches_batch(spark, tmp_path):
    from fieldmark.operators.scoring import score_pairs
    from fieldmark.sources.fixtures import eval_pairs
    from fieldmark.sources.io import PREDICTION_DDL
    from fieldmark.streaming.scoring_stream import stream_scored

    src = tmp_path / "in"
    pairs = eval_pairs(spark, SF_SMALL).where(F.col("row_id") < 200)
    pairs.select(*[c.split(" ")[0] for c in PREDICTION_DDL.split(", ")]).write.json(str(src))
    import uuid

    # the checkpoint lives in the shared folder under the stream's name: a new name per run
    q = stream_scored(spark, str(src), str(tmp_path / "out"), name=f"test_{uuid.uuid4().hex[:8]}")
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("run").agg(F.sum(F.col("exact_match").cast("int")))
    want = score_pairs(pairs).groupBy("run").agg(F.sum(F.col("exact_match").cast("int")))
    assert sorted(got.collect()) == sorted(want.collect())


def test_plans_have_no_cross_products(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    for k in ("t07_match_cascade", "t06_fuzzy_link", "e02_nearest_association", "w05_error_samples",
              "a07_run_summary", "m02_merge_system"):
        plan = qs[k](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, k
        assert "BatchEvalPython" not in plan, k


def test_leakage_finds_planted_few_shot(spark):
    from fieldmark.operators.prompts import FEW_SHOTS, few_shots_df, leakage

    planted = [(FEW_SHOTS[0][0].upper(),), ("  " + FEW_SHOTS[6][0] + " ",), ("une autre phrase",)]
    df = spark.createDataFrame(planted, "text string")
    got = sorted(r.text for r in leakage(df, "text", few_shots_df(spark)).collect())
    assert got == sorted([planted[0][0], planted[1][0]])


def test_oracle_round_columns_match_spark_schemas(spark):
    import __spark_entry__ as entry
    from pyspark.sql import types as T

    from fieldmark.plans.catalog import ROUND9

    qs, oracles = entry.queries(), entry.oracle_sql()
    for k in oracles:
        sch = qs[k](spark, SF_SMALL).schema
        doubles = [f.name for f in sch.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        assert doubles == ROUND9.get(k, []), k
