"""What the third round mended: fewer bytes between stages, scores written once, files in pieces."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from fieldmark.functions.metrics import drivers_change_accuracy
from fieldmark.functions.records import DRIVER_DDL, rec
from fieldmark.operators import linking, summary
from fieldmark.sources import fixtures
from fieldmark.sources.io import read_predictions, run_of_file
from fieldmark.sources.sinks import write_named_files


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _tables(spark, path):
    """Two orders: lines with equal numbers and a null flag; one order without lines."""
    li = [(1, 1, 9, 1, 17.5, 1.0, 0.09, 0.0, "N", "O"), (1, 1, 9, 1, 18.5, 1.0, 0.09, 0.0, "A", "F"),
          (1, 2, 10, 7, 3.0, 1.0, 0.01, 0.0, None, "O"), (1, 3, 11, 2, 4.0, 1.0, 0.01, 0.0, "R", "F"),
          (2, 2, 12, 3, 5.0, 1.0, 0.1, 0.0, "R", "F")]
    spark.createDataFrame(li, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
                          ).withColumn("l_shipdate", F.lit("2020-01-01").cast("timestamp")).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(1, "O", "1-URGENT"), (2, "F", "2-HIGH"), (3, "O", "5-LOW")],
                          "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_order_parts_by_hand(spark, tmp_path):
    got = {r.row_id: r for r in fixtures.order_parts(spark, _tables(spark, tmp_path)).collect()}
    assert [(d.entity_key, d.change.value, d.change.unit, d.change.direction) for d in got[1].drivers] == [
        ("DAT", 3.0, "%", "increase"), ("DAV", 18.5, "bps", "decrease"), ("MARCHE", 4.0, "%", "decrease")]
    assert got[1].targets == ["cout_risque_total", "pnb"] and got[2].targets == ["marge_nette"]
    assert (got[1].first_line.lever_key, got[1].first_line.chg.value, got[1].first_line.kpi) == ("DAV", 17.5, "pnb")


def test_per_order_buffers_hold_no_text_made_of_lines(spark, tmp_path):
    path = _tables(spark, tmp_path)
    for df in (fixtures.order_parts(spark, path), fixtures.order_spans(spark, path)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        before_the_shuffle = plan[plan.index("partial_"):]
        assert "l_orderkey" in before_the_shuffle
        assert not any(x in before_the_shuffle for x in ("increase", "Terme", "unite_variation", "collect_set", "max_by"))


def test_spans_of_an_order_keep_their_order(spark, tmp_path):
    got = {r.row_id: r.spans for r in fixtures.order_spans(spark, _tables(spark, tmp_path)).collect()}
    assert [s.text for s in got[1] if s.label == "valeur_numerique"] == ["17", "18", "3", "4"]
    assert [s.text for s in got[1] if s.label == "terme_inconnu"] == ["Terme N", "Terme A", None, "Terme R"]
    assert [s.start for s in got[2]] == [0, 200, 240, 245, 220, 260, 280] and got[3] == []


def test_lines_without_a_key_are_alike_before_and_after_the_shuffle(spark, tmp_path):
    path = _tables(spark, tmp_path / "a")
    lines = spark.read.parquet(f"{path}/lineitem.parquet").withColumn("l_suppkey", F.lit(None).cast("long"))
    os.makedirs(tmp_path / "b")
    lines.withColumn("l_partkey", F.lit(None).cast("long")).write.parquet(str(tmp_path / "b/lineitem.parquet"))
    spark.read.parquet(f"{path}/orders.parquet").write.parquet(str(tmp_path / "b/orders.parquet"))
    spans = {r.row_id: r.spans for r in fixtures.order_spans(spark, str(tmp_path / "b")).collect()}[2]
    assert [s.text for s in spans if s.label == "unite_variation"] == [fixtures.UNIT_SAMPLES[-1]]
    part = {r.row_id: r for r in fixtures.order_parts(spark, str(tmp_path / "b")).collect()}[2]
    assert [d.entity_key for d in part.drivers] == [fixtures.LEVER_KEYS[-1]] == [part.first_line.lever_key]
    assert part.targets == [fixtures.KPIS[-1]] == [part.first_line.kpi]


def test_summary_scores_once(spark):
    cols = ["run", "latency_s", "type", *summary.MEANS]
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    rows = spark.range(20).select(F.concat(F.lit("r"), F.col("id") % 2).alias("run"), F.lit("other").alias("type"),
                                  *[F.lit(1.0).alias(c) for c in summary.MEANS if c != "exact_match"],
                                  F.lit(True).alias("exact_match"), counted(F.col("id").cast("double")).alias("latency_s"))
    got = summary.summarize(rows.select(*cols)).orderBy("model").collect()
    assert [r.latency_median_s for r in got] == [9.0, 10.0] and calls.value == 20


def test_texts_are_linked_from_a_written_table(spark):
    spans = spark.createDataFrame([("dav",), ("DAV",), (None,), ("xyzzy",)], "t string")
    words = spark.createDataFrame([("dav", "DAV", 0)], "surface string, canonical string, ord int")
    out = linking.link(spans, "t", words)
    assert sorted((r.t or "", r.key) for r in out.collect()) == [("", None), ("DAV", "DAV"), ("dav", "DAV"), ("xyzzy", None)]
    assert "Aggregate" not in _plan(out) and "parquet" in _plan(out)


def test_change_accuracy_of_equal_and_nan_drivers(spark):
    d = lambda k, v: F.struct(F.lit(k).alias("entity_key"), F.struct(
        F.lit("relative").alias("type"), F.lit(v).cast("double").alias("value"), F.lit("%").alias("unit"),
        F.lit("increase").alias("direction")).alias("change")).cast(DRIVER_DDL)
    r = lambda *ds: rec(mode=F.lit("forward"), drivers=F.array(*ds).cast(f"array<{DRIVER_DDL}>"))
    cases = [(r(d("DAV", 1.0)), r(d("DAV", 1.0)), 1.0), (r(d("DAV", "NaN")), r(d("DAV", "NaN")), 0.75),
             (r(d("DAV", 2.0), d("FP", 1.0)), r(d("FP", 1.0), d("DAV", 1.0)), 0.875), (r(d("DAV", 1.0)), r(d("FP", 1.0)), None),
             (r(), r(), None)]
    got = spark.range(1).select(*[drivers_change_accuracy(p, g).alias(f"c{i}") for i, (p, g, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, _, want in cases]


def test_files_in_pieces(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(2000).select("id", F.concat(F.lit("run.v"), F.col("id") % 2, F.lit(".jsonl")).alias("f"))
    line = F.concat(F.lit('{"row_id": '), F.col("id"), F.lit("}"))
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_named_files(df.repartition(5), path, F.col("f"), line, [F.col("id")], pieces=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    names = sorted(os.listdir(path))
    assert len(names) > 2 and names[0] == "run.v0.part-00000.jsonl.gz"
    whole = b"".join(open(f"{path}/{n}", "rb").read() for n in names if n.startswith("run.v1."))
    assert gzip.decompress(whole).decode() == "".join(f'{{"row_id": {i}}}\n' for i in range(1, 2000, 2))
    back = read_predictions(spark, f"{path}/*.jsonl.gz").groupBy("run").count().collect()
    assert {(r.run, r["count"]) for r in back} == {("run.v0", 1000), ("run.v1", 1000)}
    with pytest.raises(Exception):
        write_named_files(df, path, F.col("f"), line, [F.col("id")], overwrite=False, pieces=True)
    write_named_files(df.where("id < 2").coalesce(1), path, F.col("f"), line, [F.col("id")], pieces=True)
    assert sorted(os.listdir(path)) == ["run.v0.part-00000.jsonl.gz", "run.v1.part-00000.jsonl.gz"]


def test_run_of_file(spark):
    names = ["a.v2.jsonl", "a.part-00012.jsonl.gz", "a.v1.part-00000.jsonl.gz", "a"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(run_of_file(F.col("n")).alias("r")).collect()
    assert [r.r for r in got] == ["a.v2", "a", "a.v1", "a"]
