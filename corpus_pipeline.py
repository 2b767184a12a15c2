"""A corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, PII masking, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmark.llm import decontamination, ngram_join, packing, pii, quality_rules
from fieldmark.llm.common import table, written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("ngram_join", ngram_join.stage),
    ("decontamination", decontamination.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]
#: SQL cannot express the trained tagger and the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
