"""Run summaries kept up with the stream of prediction files.

Each micro-batch is scored and leaves a partial summary: sums and counts per run, and the counts of latencies, which
merge exactly (medians and p95 too).  The summary at any time is the merge of the partials, not a new pass over the
examples.

Partials lie in the state folder, ``latency/part=b<first>-<last>`` and ``means/part=b<first>-<last>`` for the batches
first to last.  A batch writes its latencies, then its means as one file: only a part with means counts, so a crash
between the two leaves nothing half counted.  A batch that is repeated after a crash overwrites its own part.
``fold`` merges all parts into one that spans them; a part that lies inside another is ignored from then on, so a crash
during the fold does no harm either.  The folder and the stream's checkpoint belong together: both lie under
``spark.checkpoint.dir`` unless the caller names another state folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.scoring import score_pairs
from fieldmark.operators.summary import (
    merged_latencies, merged_means, partial_latencies, partial_means, summary_of_partials,
)
from fieldmark.session import checkpoint_dir
from fieldmark.sources.io import PREDICTION_DDL


def state_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/summary-{name}"


def _write(means: DataFrame, latencies: DataFrame, state: str, first: int, last: int) -> None:
    part = f"part=b{first}-{last}"
    latencies.write.mode("overwrite").parquet(f"{state}/latency/{part}")
    means.coalesce(1).write.mode("overwrite").parquet(f"{state}/means/{part}")  # a row per run


def write_partial(scored: DataFrame, state: str, batch_id: int) -> None:
    """The partial summary of one micro-batch; writing it again changes nothing."""
    scored.persist()
    try:
        _write(partial_means(scored), partial_latencies(scored), state, batch_id, batch_id)
    finally:
        scored.unpersist()


def stream_summary(spark: SparkSession, input_dir: str, name: str = "summary", state: str | None = None, once: bool = True):
    """Start a query that leaves a partial summary of every micro-batch of new prediction files; returns it."""
    state = state or state_folder(spark, name)
    source = spark.readStream.schema(PREDICTION_DDL).option("mode", "FAILFAST").json(input_dir)
    query = (score_pairs(source).writeStream.foreachBatch(lambda rows, batch_id: write_partial(rows, state, batch_id))
             .option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}").queryName(name))
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="30 seconds")).start()


def counted_parts(parts: list[str]) -> list[str]:
    """The parts that count: those inside no other."""
    spans = {p: tuple(map(int, re.fullmatch(r"b(\d+)-(\d+)", p).groups())) for p in parts}
    return sorted(p for p, (a, b) in spans.items()
                  if not any(q != p and c <= a and b <= d for q, (c, d) in spans.items()))


def _partials(spark: SparkSession, state: str) -> tuple[DataFrame, DataFrame, list[str]]:
    means = spark.read.parquet(f"{state}/means")
    parts = counted_parts([r.part for r in means.select("part").distinct().collect()])  # the batches since the last fold
    at = F.col("part").isin(parts)
    return means.where(at), spark.read.parquet(f"{state}/latency").where(at), parts


def current_summary(spark: SparkSession, state: str, runs: DataFrame | None = None) -> DataFrame:
    """The summary of all batches so far, in the columns of ``summarize``."""
    means, latencies, _ = _partials(spark, state)
    return summary_of_partials(means, latencies, runs)


def fold(spark: SparkSession, state: str) -> None:
    """Merge all parts into one, so that a summary reads as much after many batches as after one."""
    means, latencies, parts = _partials(spark, state)
    if len(parts) > 1:
        bounds = [int(x) for p in parts for x in re.findall(r"\d+", p)]
        _write(merged_means(means), merged_latencies(latencies), state, min(bounds), max(bounds))
