"""The streamed summary against the batch summary: after every micro-batch, restarts, repeats and folds."""

import uuid

import pytest
from pyspark.sql import functions as F
from small_tables import SF_SMALL

from fieldmark.operators.scoring import score_pairs
from fieldmark.operators.summary import summarize
from fieldmark.sources.dimensions import runs_df
from fieldmark.sources.fixtures import eval_pairs
from fieldmark.sources.io import PREDICTION_DDL
from fieldmark.streaming.summary_stream import counted_parts, current_summary, fold, state_folder, stream_summary, write_partial

COLUMNS = [c.split(" ")[0] for c in PREDICTION_DDL.split(", ")]


def rows_of(df):
    return {r.model: r.asDict() for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    for run, row in want.items():
        assert got[run].keys() == row.keys()
        for c, v in row.items():
            assert got[run][c] == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v), (run, c)


def test_summary_after_every_batch(spark, tmp_path):
    name, source = f"sum_{uuid.uuid4().hex[:8]}", str(tmp_path / "in")
    state, runs = state_folder(spark, name), runs_df(spark)
    pairs = eval_pairs(spark, SF_SMALL).where("row_id < 90").select(*COLUMNS)
    pairs.write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    for k in range(3):
        # each time the query starts anew from its checkpoint; the last batch brings the runs that were not there before
        new = pairs.where((F.col("row_id") % 3 == k) & (F.lit(k == 2) | (F.length("run") > 9)))
        new.write.mode("append").json(source)
        stream_summary(spark, source, name).awaitTermination(120)
        so_far = spark.read.schema(PREDICTION_DDL).json(source)
        want = rows_of(summarize(score_pairs(so_far), runs))
        same(rows_of(current_summary(spark, state, runs)), want)
    # the last batch once more, as after a crash before the commit
    write_partial(score_pairs(pairs.where("row_id % 3 = 2")), state, 2)
    same(rows_of(current_summary(spark, state, runs)), want)
    fold(spark, state)
    same(rows_of(current_summary(spark, state, runs)), want)
    # a part without means does not count
    spark.read.parquet(f"{state}/latency/part=b0-2").write.parquet(f"{state}/latency/part=b3-3")
    same(rows_of(current_summary(spark, state, runs)), want)


def test_parts_inside_others_do_not_count():
    assert counted_parts(["b0-0", "b1-1", "b0-2", "b2-2", "b3-3", "b10-10"]) == ["b0-2", "b10-10", "b3-3"]
