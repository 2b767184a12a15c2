"""What the fourth round mended: lines made and parsed once, answers parsed without a VARIANT for every value."""

import os

from pyspark.sql import functions as F
from test_scale_r03 import _tables

from fieldmark.functions.cleaning import parse_object, py_strip
from fieldmark.operators.clean import clean_outputs
from fieldmark.sources import fixtures
from fieldmark.sources.io import read_predictions_checked
from fieldmark.sources.sinks import write_named_files


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return f"é{x}" if x % 3 else None

    df = spark.range(3000).repartition(3)
    write_named_files(df, str(tmp_path), F.concat(F.lit("f"), F.col("id") % 2), counted("id"), [F.col("id")])
    assert calls.value == 3000
    for k in (0, 1):
        assert (tmp_path / f"f{k}").read_text(encoding="utf-8") == "".join(f"é{i}\n" if i % 3 else "\n" for i in range(k, 3000, 2))


def test_order_of_null_and_repeated_keys(spark, tmp_path):
    df = spark.range(4000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("a"), (-F.col("id") * 0.5).alias("b"))
    write_named_files(df.repartition(3), str(tmp_path), F.lit("one"), F.concat_ws(",", "a", "b"), [F.col("a"), F.col("b")])
    rows = sorted((x % 7 if x % 5 else -1, -x * 0.5) for x in range(4000))
    assert (tmp_path / "one").read_text() == "".join((f"{b}" if a < 0 else f"{a},{b}") + "\n" for a, b in rows)


def test_a_checked_line_is_parsed_once_a_side(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"row_id": 1, "gold": {}}\n{"row_id": 1, "gold": {}} 2\n \r[{"row_id": 1}]\n\t{"row_id": []}\n')
    good, bad = read_predictions_checked(spark, os.fspath(tmp_path / "r.jsonl"))
    for side in (good.select("run"), bad.select("run", "reason")):
        assert _plan(side).count("from_json(") == 1
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["not JSON", "not an object", "wrong type"]


ODD = [  # (answer, whether there is a record, valid, reject, (mode, product, drivers, targets, goal value))
    ('{"mode": 5, "product_id": [1]}', True, False, ["product_id", "mode"], ("5", "[1]", None, None, None)),
    ('{"mode": "forward", "drivers": 0, "targets": ["pnb", 7, null]}', True, False, ["targets"], ("forward", None, [], ["pnb", "7", None], None)),
    ('{"mode": "forward", "drivers": true}', False, False, ["drivers"], None),
    ('{"mode": "forward", "drivers": "5"}', True, True, [], ("forward", None, [], [], None)),
    ('{"mode": "forward", "drivers": [4, {"entity_key": 1, "change": "x"}, {"entity_key": "FP", "change": {"type": "relative", '
     '"value": "-1_0", "unit": "%", "direction": "increase"}}]}', True, False, ["drivers"],
     ("forward", None, [(None, None), ("FP", ("relative", -10.0, "%", "increase"))], [], None)),
    ('{"mode": "inverse", "lever": {"entity_key": "DAV"}, "target": "pnb", "goal": {"type": "relative", "value": true, "unit": "%", '
     '"direction": "increase"}}', True, True, [], ("inverse", None, None, None, 1.0)),
    ('{"mode": "inverse", "lever": "DAV", "target": "pnb", "goal": {"type": "relative", "value": "10d", "unit": 3, '
     '"direction": "increase"}}', True, False, ["lever", "goal"], ("inverse", None, None, None, None)),
    ('{"intent": "other", "unknown_terms": 3}', True, True, [], (None, None, None, None, None)),
    ('{"mode": "forward", "unknown_terms": ["A", null]}', False, False, ["unknown_terms"], None),
    ('{"mode": "forward", "mode": "inverse"}', False, False, ["unparsable"], None), ('{}, "@end"', False, False, ["unparsable"], None),
]


def test_odd_answers(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(ODD)], "i int, raw string")
    got = {r.i: r for r in clean_outputs(df).collect()}
    plain = lambda d: (d.entity_key, d.change and tuple(d.change))
    for i, (_, there, valid, reject, fields) in enumerate(ODD):
        p = got[i].pred
        assert (p is not None, got[i].valid, got[i].reject) == (there, valid, reject), ODD[i]
        if p:
            assert (p.mode, p.product_id, p.drivers and [plain(d) for d in p.drivers] or p.drivers, p.targets, p.goal and p.goal.value) == fields


def test_answers_are_cast_once_and_without_type_names(spark):
    df = spark.createDataFrame([("{}",)], "raw string")
    plan = _plan(clean_outputs(df))
    assert "schema_of_variant" not in plan.lower() and "SchemaOfVariant" not in plan
    assert plan.count("entity_key,BinaryType") == 2  # of the drivers and of the lever, in one cast
    assert "SchemaOfVariant" not in _plan(df.select(parse_object(F.col("raw"))))


def test_answers_are_put_together_from_texts_made_once_per_order(spark, tmp_path):
    path = _tables(spark, tmp_path)
    spark.createDataFrame([(9, "Red"), (11, "blue")], "p_partkey long, p_name string").write.parquet(f"{path}/part.parquet")
    raw = fixtures.raw_outputs(spark, path)
    got = {(r.run, r.row_id): r.raw for r in raw.collect()}
    upper = got[fixtures.EVAL_RUNS[1], 1]  # 1 * 7 + 1: case 8
    assert len(got) == 21 and '"unknown_terms": ["RED"]' in upper and '"value": 18, "unit": "bps", "direction": "decrease"' in upper
    plan = _plan(raw.select("raw"))
    above = plan[:plan.index("Generate ")]
    assert "entity_key" not in above and "transform(" in plan


def test_white_space_at_the_ends_only(spark):
    texts = ["a", " a", "a\n", "\x1ca\x1f", "\u00a0a\u2003", "é", "é ", "a b", "", " ", "\u0085", "a\u200b", "\u3000é\u3000"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", py_strip(F.col("t")).alias("t"))
    assert {r.i: r.t for r in got.collect()} == {i: t.strip() for i, t in enumerate(texts)}
