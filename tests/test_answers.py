"""Rows by hand for readers, cleaning, scoring and assembly: what a wrong or odd input must give."""

import json
import math

import pytest
from pyspark.sql import functions as F

from fieldmark.functions.metrics import exact_match
from fieldmark.functions.records import REC_DDL
from fieldmark.operators.assembly import SPAN_DDL, assemble_from_spans
from fieldmark.operators.clean import clean_outputs
from fieldmark.operators.prompts import choose_model_files
from fieldmark.sources.dimensions import dictionary_df
from fieldmark.sources.io import read_dataset, read_predictions

FORWARD = {"intent": "simulation", "mode": "forward", "product_id": "CRED_PME", "drivers": [], "targets": [], "unknown_terms": []}


@pytest.mark.parametrize("raw, has_pred, valid", [
    ('{"intent":"other"}', True, True),
    ('{"intent":"other"}] blah {}', False, False),
    ('{"intent":"other"}],[{"b":2}', False, False),
    ('{"intent":"other"},"@end"', False, False),
    (' {"intent":"other"} ', True, True),
    (json.dumps(FORWARD), True, True),
    (json.dumps(FORWARD | {"drivers": 42}), False, False),
    (json.dumps(FORWARD | {"drivers": True}), False, False),
    (json.dumps(FORWARD | {"drivers": 0}), True, True),
    (json.dumps(FORWARD | {"drivers": "dav"}), True, True),
    (json.dumps(FORWARD | {"drivers": {"a": 1}}), True, True),
    (json.dumps(FORWARD | {"mode": "x", "drivers": 42}), True, False),
])
def test_cleaned_answer(spark, raw, has_pred, valid):
    r = clean_outputs(spark.createDataFrame([(raw,)], "raw string")).select("valid", F.col("pred").isNotNull().alias("p")).first()
    assert (r.p, r.valid) == (has_pred, valid)


def test_dataset_columns_go_by_name(spark, tmp_path):
    gold = json.dumps({"intent": "other", "unknown_terms": []}).replace('"', '""')
    (tmp_path / "a.csv").write_text(f'json,extra,text\n"{gold}",1,"hello, you"\n')
    r = read_dataset(spark, str(tmp_path / "a.csv")).first()
    assert (r.row_id, r.text, r.gold.intent) == (0, "hello, you", "other")


def test_prediction_folders_and_files(spark, tmp_path):
    line = json.dumps({"row_id": 1, "text": "t", "gold": None, "prediction": None, "valid_json": False, "latency_s": 0.5})
    for name in ("parts/run=001/part-0.json", "flat/model.v2.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(line + "\n")
    assert [r.run for r in read_predictions(spark, str(tmp_path / "parts")).collect()] == ["001"]
    assert [r.run for r in read_predictions(spark, str(tmp_path / "flat")).collect()] == ["model.v2"]
    (tmp_path / "flat/model.v2.jsonl").write_text(line + '\n{"row_id": 2, \n')
    with pytest.raises(Exception):
        read_predictions(spark, str(tmp_path / "flat")).collect()


def test_sentence_without_spans(spark):
    df = spark.createDataFrame([(1, []), (2, [("pme", "produit_credit", 0, 3, 0.9)]), (3, None)], f"i int, s array<{SPAN_DDL}>")
    got = {r.i: r for r in assemble_from_spans(df, "i", "s", dictionary_df(spark), fuzzy=False).select("i", "prediction.*").collect()}
    assert {i: r.intent for i, r in got.items()} == {1: "other", 2: "simulation", 3: "other"}
    assert got[1].drivers == [] and got[2].product_id == "CRED_PME"


def test_missing_model_file(spark):
    files = [("r", f"w/m-Q4{x}.gguf") for x in ("-00001-of-00002", "-00002-of-00002", "-mtp")] + [("s", "w/x-Q8.bin")]
    wanted = [("r", "Q4"), ("r", "Q8"), ("s", "Q8"), ("t", "Q4")]
    out = choose_model_files(spark.createDataFrame(files, "repo string, file string"), spark.createDataFrame(wanted, "repo string, quant string"))
    assert {(r.repo, r.quant): (r.n_files, r.missing) for r in out.collect()} == {
        ("r", "Q4"): (2, False), ("r", "Q8"): (0, True), ("s", "Q8"): (0, True), ("t", "Q4"): (0, True)}


def test_nan_counts_only_where_the_branch_compares(spark):
    def rec(mode, goal):
        change = {"type": "absolute", "value": goal, "unit": "%", "direction": "increase"}
        return {"intent": "simulation", "mode": mode, "product_id": None, "drivers": [], "targets": [], "lever": None,
                "goal": change, "target": None, "unknown_terms": []}

    rows = [(m, rec(m, v), rec(m, v)) for m in ("forward", "inverse") for v in (1.0, math.nan)]
    df = spark.createDataFrame(rows, f"m string, p {REC_DDL}, g {REC_DDL}")
    got = [r.e for r in df.select(exact_match(F.col("p"), F.col("g")).alias("e")).collect()]
    assert got == [True, True, True, False]
