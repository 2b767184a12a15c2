"""Similarity join of spans and dictionary surfaces by the ``difflib`` ratio.

The ratio of x and y is 2 M / (a + b) for their lengths a and b, and M, the
characters in matching blocks, is at most the overlap of x and y as multisets
of characters.  A pair that reaches the cutoff therefore has an overlap of at
least t(a, b), the least whole M that does.  The join uses this three times:

* lengths: 2 min(a, b) / (a + b) must reach the cutoff;
* prefixes: a multiset is a set of numbered characters ("e1", "e2", ...);
  ordered alike on both sides, here by their rarity in the dictionary, two
  sets that share t elements share one among the first a - t + 1 of the one
  and the first b - t + 1 of the other.  Both sides are put under (a, b,
  element) for these elements and meet there.  An element that the dictionary
  lacks stands first, and a span with more than a - t of them meets nothing;
* overlap: of a pair that meets, the sets are intersected in full.

A pair meets under every prefix element that it shares; it counts at the first
one only, so that no ``distinct`` is needed.  What is left goes through
``difflib`` in an Arrow UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.sources.dimensions import FUZZY_CUTOFF


def least_overlap(a: Column, b: Column, cutoff: float) -> Column:
    """The least M with 2 M / (a + b) >= cutoff (never more: rounding is on the safe side)."""
    return F.ceil((a + b) * F.lit(cutoff / 2) - F.lit(1e-9)).cast("int")


def _elements_udf():
    """Numbered characters of a text: each with how often it has come so far."""
    def elements(col):
        from collections import Counter

        import pandas as pd

        out = []
        for text in col:
            seen, mine = Counter(), []
            for c in text or "":
                seen[c] += 1
                mine.append(f"{c}{seen[c]}")
            out.append(mine)
        return pd.Series(out)

    return F.pandas_udf(elements, "array<string>")


def _ratio_udf():
    def ratio(a, b):
        import difflib

        import pandas as pd

        out = []
        sm = difflib.SequenceMatcher()
        last = None
        for x, y in zip(a, b):
            if y != last:  # what difflib learns of the second text holds for all first ones
                sm.set_seq2(y)
                last = y
            sm.set_seq1(x)
            out.append(sm.ratio())
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(ratio, "double")


def _signed(df: DataFrame, text: str, rarity: DataFrame) -> DataFrame:
    """Adds ``sig``, the elements of ``text`` in the common order, and ``size``."""
    parts = df.select(text, F.explode(_elements_udf()(F.col(text))).alias("e")).join(rarity, "e", "left")
    sig = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "e"))), lambda s: s["e"])
    return parts.groupBy(text).agg(sig.alias("sig")).withColumn("size", F.size("sig"))


def candidate_pairs(spans_n: DataFrame, lookup: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """``(n, surface, overlap)``: every pair whose multiset overlap allows the cutoff."""
    spans_n = spans_n.select("n").where("n <> ''")
    surfaces = lookup.select("surface")
    # spans of a length that no surface's length allows fall out first
    a, b = F.length("n"), F.col("b")
    lengths = surfaces.select(F.length("surface").alias("b")).distinct()
    low, high = F.ceil(F.col("b") * cutoff / (2 - cutoff) - 1e-9), F.floor(F.col("b") * (2 - cutoff) / cutoff + 1e-9)
    pairs = lengths.select("b", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("a")).where(
        (2 * F.least("a", "b") >= least_overlap(F.col("a"), F.col("b"), cutoff) * 2) & (F.col("a") > 0))
    spans_n = spans_n.join(pairs.select(F.col("a").alias("_a")).distinct(), a == F.col("_a"), "left_semi")
    rarity = surfaces.select(F.explode(_elements_udf()(F.col("surface"))).alias("e")).groupBy("e").agg(
        F.count(F.lit(1)).alias("held"))
    t = least_overlap(F.col("a"), F.col("b"), cutoff)

    def keyed(signed, text, own, sig):
        """Rows under (a, b, element) for the first elements that must hold one in common."""
        at = signed.withColumnRenamed("size", own).withColumnRenamed("sig", sig).join(pairs, own)
        prefix = F.slice(sig, 1, F.col(own) - t + 1)
        return at.select("a", "b", text, sig, prefix.alias(f"{sig}_prefix")).select("*", F.explode(f"{sig}_prefix").alias("e"))

    left = keyed(_signed(spans_n, "n", rarity), "n", "a", "x")
    right = keyed(_signed(surfaces, "surface", rarity), "surface", "b", "y")
    met = left.join(right, ["a", "b", "e"]).where(
        F.element_at(F.array_intersect("x_prefix", "y_prefix"), 1) == F.col("e"))
    return met.withColumn("overlap", F.size(F.array_intersect("x", "y"))).where(F.col("overlap") >= t).select(
        "n", "surface", "overlap")


def fuzzy_hits(spans_n: DataFrame, lookup: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Best ratio >= cutoff per span; ties go to the lexicographically largest surface."""
    pairs = candidate_pairs(spans_n, lookup, cutoff)
    scored = pairs.select("n", "surface", _ratio_udf()(F.col("surface"), F.col("n")).alias("score"))
    best = scored.where(F.col("score") >= cutoff).groupBy("n").agg(F.max(F.struct("score", "surface")).alias("_best"))
    return best.join(lookup.select(F.col("surface").alias("_s"), "canonical"), F.col("_best.surface") == F.col("_s")).select(
        "n", "canonical", "_best")
