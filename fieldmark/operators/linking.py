"""Dictionary entity linking (T2-T8): surface spans -> closed-world keys.

Cascade per span (on its folded form ``n``):

1. exact: ``n`` is a dictionary surface (equi-join);
2. containment, one longest-first pass over two candidate kinds
   (``containment``): a surface occurs in ``n`` between word boundaries, or
   ``n`` (>= 4 characters) is a substring of a surface; the winner is the
   longest surface, ties to the earliest dictionary entry;
3. fuzzy: best ``difflib`` ratio >= 0.9 (ties: largest surface), by a
   similarity join on multisets of characters (``similarity``).

Only distinct folded spans go through the cascade, each stage receiving the
spans the previous one left unresolved; results are joined back to the spans.
The planner sizes the dictionary side and broadcasts it or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.text import fold_distinct
from fieldmark.operators.containment import containment_hits, phrase_hits, reverse_hits  # noqa: F401
from fieldmark.operators.similarity import fuzzy_hits
from fieldmark.session import scratch_path


def build_lookup(dictionary: DataFrame) -> DataFrame:
    """Folded surface -> key; the last entry wins on a collision, the first
    position is kept for the longest-first tie-break (dict semantics)."""
    d = fold_distinct(dictionary, "surface", "surface")
    return (d.groupBy("surface")
            .agg(F.max_by("canonical", "ord").alias("canonical"), F.min("ord").alias("ord"))
            .where(F.col("surface") != "")
            .withColumn("len", F.length("surface")))


def _best(df: DataFrame, key: str) -> DataFrame:
    """Longest surface wins, ties to the earliest entry."""
    return df.groupBy(key).agg(
        F.max_by("canonical", F.struct(F.col("len"), -F.col("ord"))).alias("canonical"),
        F.max(F.struct(F.col("len"), -F.col("ord"))).alias("_rank"))


def resolve_distinct(spans_n: DataFrame, lookup: DataFrame, containment: bool = True,
                     fuzzy: bool = True) -> DataFrame:
    """T7 on distinct folded spans: ``(n, key, path)`` with path exact / contain / fuzzy / NULL."""
    lk = lookup
    ex = spans_n.join(lk.select(F.col("surface").alias("n"), F.col("canonical").alias("k_exact")), "n", "left")
    out = ex.select("n", "k_exact")
    if containment:
        todo = out.where(F.col("k_exact").isNull() & (F.col("n") != "")).select("n")
        best = _best(containment_hits(todo, lookup), "n").select("n", F.col("canonical").alias("k_contain"))
        out = out.join(best, "n", "left")
    else:
        out = out.withColumn("k_contain", F.lit(None).cast("string"))
    if fuzzy and containment:
        todo = out.where(F.col("k_exact").isNull() & F.col("k_contain").isNull() & (F.col("n") != "")).select("n")
        fz = fuzzy_hits(todo, lookup).select("n", F.col("canonical").alias("k_fuzzy"))
        out = out.join(fz, "n", "left")
    else:
        out = out.withColumn("k_fuzzy", F.lit(None).cast("string"))
    key = F.coalesce("k_exact", "k_contain", "k_fuzzy")
    path = (F.when(F.col("k_exact").isNotNull(), "exact").when(F.col("k_contain").isNotNull(), "contain")
            .when(F.col("k_fuzzy").isNotNull(), "fuzzy"))
    return out.select("n", key.alias("key"), path.alias("path"))


def as_written(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of a written table, so that it is made once and the planner knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linked_texts(spans: DataFrame, text_col: str, dictionary: DataFrame, containment: bool = True,
                 fuzzy: bool = True) -> DataFrame:
    """Distinct texts with their folded form, key and path ``(text_col, n, key, path)``, as a written table.

    Spans that are joined with a small one need no shuffle by text, where a common text is one task.
    """
    texts = as_written(fold_distinct(spans.select(text_col).distinct(), text_col, "n"), "folded")
    resolved = resolve_distinct(texts.select("n").distinct(), build_lookup(dictionary), containment, fuzzy)
    return as_written(texts.join(resolved, "n", "left").select(text_col, "n", "key", "path"), "texts")


def link(spans: DataFrame, text_col: str, dictionary: DataFrame, containment: bool = True,
         fuzzy: bool = True, out_col: str = "key") -> DataFrame:
    """Add the linked key (or NULL) and the matching path to every span row."""
    keyed = linked_texts(spans.select(F.col(text_col).alias("_t")), "_t", dictionary, containment, fuzzy)
    return (spans.join(keyed.select(F.col("_t").alias(text_col), "key", "path"), text_col, "left")
            .withColumnRenamed("key", out_col).withColumnRenamed("path", f"{out_col}_path"))
