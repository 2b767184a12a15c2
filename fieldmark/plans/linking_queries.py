"""Queries T1-T8: dictionary entity linking over the F3 spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.functions.text import fold_distinct
from fieldmark.operators.linking import (
    build_lookup, link, phrase_hits, resolve_distinct, reverse_hits, _best,
)
from fieldmark.plans.catalog import register
from fieldmark.plans.oracle_sql import linking_sql
from fieldmark.sources.dimensions import dictionary_df
from fieldmark.sources.fixtures import spans


def _distinct_n(spark, sf_dir):
    texts = spans(spark, sf_dir).select("span").distinct()
    return fold_distinct(texts, "span", "n").select("n").distinct()


@register("t01_normalize", linking_sql("SELECT DISTINCT span, " + "lower(regexp_replace(strip_accents(span), "
                                       "'^\\s+|\\s+$', '', 'g')) AS n FROM spans"))
def t01_normalize(spark, sf_dir):
    """NFKD, combining marks dropped, stripped, lowercased."""
    return fold_distinct(spans(spark, sf_dir).select("span").distinct(), "span", "n")


@register("t02_build_lookup", linking_sql("""
SELECT l.surface, l.canonical, l.ord, l.len, count(s.n) AS exact_spans
FROM lookup l LEFT JOIN (SELECT lower(regexp_replace(strip_accents(span), '^\\s+|\\s+$', '', 'g')) AS n FROM spans) s
  ON s.n = l.surface GROUP BY ALL"""))
def t02_build_lookup(spark, sf_dir):
    """The folded lookup (last entry wins, first position kept) with its exact-hit count."""
    lookup = build_lookup(dictionary_df(spark))
    per_text = spans(spark, sf_dir).groupBy("span").agg(F.count(F.lit(1)).alias("c"))
    hits = fold_distinct(per_text, "span", "n").groupBy("n").agg(F.sum("c").alias("c"))
    return (lookup.join(hits.withColumnRenamed("n", "surface"), "surface", "left")
            .select("surface", "canonical", "ord", "len", F.coalesce("c", F.lit(0)).alias("exact_spans")))


@register("t03_exact_link", linking_sql("""
SELECT sn.n, e.canonical AS key FROM sn LEFT JOIN exact e ON e.n = sn.n"""))
def t03_exact_link(spark, sf_dir):
    """Exact lookup of every distinct folded span (NULL when absent)."""
    r = resolve_distinct(_distinct_n(spark, sf_dir), build_lookup(dictionary_df(spark)),
                         containment=False, fuzzy=False)
    return r.select("n", "key")


@register("t04_phrase_link", linking_sql("SELECT n, canonical AS key FROM t4_best"))
def t04_phrase_link(spark, sf_dir):
    """T4: longest dictionary surface found inside the span on word boundaries."""
    lookup = build_lookup(dictionary_df(spark))
    hits = phrase_hits(_distinct_n(spark, sf_dir), lookup)
    return _best(hits, "n").select("n", F.col("canonical").alias("key"))


@register("t05_reverse_link", linking_sql("SELECT n, canonical AS key FROM t5_best"))
def t05_reverse_link(spark, sf_dir):
    """T5: longest surface containing the span (span of 4+ characters, no boundary check)."""
    hits = reverse_hits(_distinct_n(spark, sf_dir), build_lookup(dictionary_df(spark)))
    return _best(hits, "n").select("n", F.col("canonical").alias("key"))


@register("t07_match_cascade", headline=True)
def t07_match_cascade(spark, sf_dir):
    """T7, the full cascade: exact, containment, then fuzzy (difflib, so no SQL; see tests/test_linking.py)."""
    return resolve_distinct(_distinct_n(spark, sf_dir), build_lookup(dictionary_df(spark)))


@register("t07_exact_contain", linking_sql("SELECT n, key, path FROM cascade"))
def t07_exact_contain(spark, sf_dir):
    """T7's first two stages: exact, then phrase/reverse containment longest-first."""
    return resolve_distinct(_distinct_n(spark, sf_dir), build_lookup(dictionary_df(spark)),
                            containment=True, fuzzy=False)


def _keys_per_order(linked):
    return linked.groupBy("row_id").agg(
        F.array_join(F.array_sort(F.collect_set("key")), "|").alias("keys"),
        F.count(F.lit(1)).alias("spans"), F.count("key").alias("linked"))


@register("t08_batch_link", headline=True)
def t08_batch_link(spark, sf_dir):
    """T8, the full cascade: link every span of every order, then the distinct keys per order."""
    return _keys_per_order(link(spans(spark, sf_dir), "span", dictionary_df(spark)))


@register("t08_batch_exact_contain", linking_sql("""
SELECT s.row_id, coalesce(string_agg(DISTINCT c.key, '|' ORDER BY c.key), '') AS keys, count(*) AS spans,
       count(c.key) AS linked
FROM spans s JOIN cascade c ON c.n = lower(regexp_replace(strip_accents(s.span), '^\\s+|\\s+$', '', 'g'))
GROUP BY s.row_id"""))
def t08_batch_exact_contain(spark, sf_dir):
    """T8 by the first two stages."""
    return _keys_per_order(link(spans(spark, sf_dir), "span", dictionary_df(spark), containment=True, fuzzy=False))


@register("t06_fuzzy_link")
def t06_fuzzy_link(spark, sf_dir):
    """T6 in the full cascade: spans resolved only by the difflib ratio (>= 0.9).

    No SQL oracle (difflib); checked against a brute-force resolver in tests.
    """
    r = resolve_distinct(_distinct_n(spark, sf_dir), build_lookup(dictionary_df(spark)),
                         containment=True, fuzzy=True)
    return r.where(F.col("path") == "fuzzy").select("n", "key")
