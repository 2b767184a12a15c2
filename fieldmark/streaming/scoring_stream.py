"""Incremental scoring of prediction files as they land (optional; not in the batch flow).

Prediction files are independent and scoring is a per-row projection, so the
same P6 -> C16 operators run unchanged on a file stream; per-run summaries are
recomputed from the scored table on demand (exact percentiles are not
incremental).  Each micro-batch is appended to a table under the shared
checkpoint folder, which also holds the stream's checkpoint: a restarted or
lost executor resumes from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmark.operators.scoring import score_pairs
from fieldmark.session import checkpoint_dir
from fieldmark.sources.io import PREDICTION_DDL


def stream_scored(spark: SparkSession, input_dir: str, output_dir: str, name: str = "scoring",
                  once: bool = True):
    """Start a file-stream query that scores new prediction files into ``output_dir`` (parquet).

    ``input_dir`` holds JSON lines with the prediction columns (``run`` included);
    returns the ``StreamingQuery``.  ``once=True`` processes what is there and stops.
    """
    src: DataFrame = spark.readStream.schema(PREDICTION_DDL).option("mode", "FAILFAST").json(input_dir)
    scored = score_pairs(src)
    w = (scored.writeStream.format("parquet").option("path", output_dir)
         .option("checkpointLocation", f"{checkpoint_dir(spark).rstrip('/')}/stream-{name}")
         .outputMode("append").queryName(name))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
