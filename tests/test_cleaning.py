"""Raw output cleaning traps."""

from pyspark.sql import functions as F

from fieldmark.functions.cleaning import py_strip, strip_reasoning, to_float
from fieldmark.operators.clean import clean_outputs


def clean(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return {r.i: r for r in clean_outputs(df, "raw").collect()}


def test_reasoning_and_strict_object(spark):
    body = '{"intent": "other", "unknown_terms": []}'
    res = clean(spark, [
        "<think>a\nb</think>\n" + body,        # stripped
        "<think>open " + body,                 # unclosed: stays, unparsable
        body + " trailing",                    # trailing text: rejected
        "[" + body + "]",                      # array: rejected
        body + ", " + body,                    # two values: rejected
        "{}] xx",                              # junk after a closing bracket
        "　" + body + " ",            # Unicode whitespace stripped like str.strip()
    ])
    assert res[0].valid and res[0].pred.intent == "other"
    for i in (1, 2, 3, 4, 5):
        assert res[i].pred is None and res[i].valid is False
    assert res[6].valid


def test_bad_driver_element_only_dropped(spark):
    raw = ('{"intent": "simulation", "mode": "forward", "product_id": null, "drivers": [42, {"entity_key": "DAT", '
           '"change": {"type": "absolute", "value": -5, "unit": "bps", "direction": "increase"}}], '
           '"targets": [], "unknown_terms": ["Livret A"]}')
    r = clean(spark, [raw])[0]
    assert r.valid
    assert [d.entity_key for d in r.pred.drivers] == ["DAT"]
    assert r.pred.drivers[0].change.value == 5.0          # magnitude
    assert r.pred.unknown_terms == ["livret a"]          # lowercased


def test_missing_intent_is_simulation_and_invalid_kept(spark):
    fwd = ('{"mode": "forward", "drivers": [], "targets": [], "unknown_terms": []}')
    bad = ('{"intent": "simulation", "mode": "inverse", "lever": {"entity_key": "nope"}, '
           '"goal": null, "target": "pnb", "unknown_terms": []}')
    nonstr = '{"intent": "simulation", "mode": "forward", "unknown_terms": [1]}'
    r = clean(spark, [fwd, bad, nonstr])
    assert r[0].valid and r[0].pred.intent == "simulation"
    assert not r[1].valid and r[1].pred is not None and set(r[1].reject) == {"lever", "goal"}
    assert r[2].pred is None and not r[2].valid


def test_to_float_python_semantics(spark):
    vals = ["5,5", " 12 ", "10 bps", "10d", "5f", "1_000", "1e3", "-3", "abc", "", "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(to_float(F.col("v"))).collect()]
    want = []
    for v in vals:
        try:
            want.append(float(v.replace(",", ".").strip()))
        except ValueError:
            want.append(None)
    assert got == want


def test_strip_matches_python(spark):
    vals = [" a ", "\ta\n", " a　", "\x1ca\x1f", "<think>x</think>  y "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(py_strip(F.col("v"))).collect()]
    assert got[:4] == [v.strip() for v in vals[:4]]
    assert df.select(strip_reasoning(F.col("v"))).collect()[4][0] == "y"
