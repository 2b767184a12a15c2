"""URL filter: listed rules first, then association rules over URL tokens (native Spark, FP-growth of Spark ML).

A listed rule is a host and the start of a path; it fits its host and all subdomains, and the longest that fits
judges the url.  For the others, rules are mined: the labelled pages (judged by a listed rule, else by the label
table) become token sets, FP-growth finds the token combinations that come with a label, and a combination becomes
a rule if its support and confidence suffice and no part of it has as high a confidence for the same label.  No rule
rests on fewer than LEAST_PAGES pages.  Tokens that stand in exactly the same labelled pages are one item, under the
smallest of them: a combination of several is pruned anyway, and a long url that is repeated would else give every
subset of its tokens; a page that holds any of them holds the item.  Rules match through an inverted index: each stands under its rarest token, a page looks up its tokens, and what it finds
is checked in full.  The rule of highest confidence (then support, then size, then tokens) judges; without one a
page is allowed.

Edge cases: a null url, or one without ``://``, has an empty host and path and no tokens, and is allowed; repeated
rows are judged alike; without labelled pages nothing is mined; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import table, written

# The listed rules (verdict, host, path).
LISTED = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Share of the labelled pages that a rule's tokens and label must hold, and share of the pages with its tokens that
#: must have its label.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.9
#: Pages that a rule rests on, at least, however small the table.
LEAST_PAGES = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    # (?s): a url may hold line breaks
    host = F.regexp_extract(url, r"(?s)^(?>.*?://)([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^(?>.*?://)[^/?#]*+(/[^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """Name and verdict of the longest listed rule that fits, or nulls.  For short lists, of some hundreds at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # later ones, the longer, go outside
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: parts of the host, of the path and names in the query, digits as 0."""
    def parts(text: Column, by: str, kind: str) -> Column:
        return F.transform(F.filter(F.split(F.regexp_replace(text, "[0-9]+", "0"), by), lambda x: x != ""),
                           lambda x: F.concat(F.lit(kind), x))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    return F.array_distinct(F.concat(parts(host, r"\.", "host:"), parts(path, "[/.]", "path:"),
                                     parts(F.regexp_replace(query, "=[^&]*", ""), "&", "query:")))


def merged_tokens(labelled: DataFrame) -> DataFrame:
    """(token, item): tokens in exactly the same labelled pages share an item."""
    at = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("h"))
    where = at.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"),
                                    F.bit_xor("h").alias("x"))
    return where.groupBy("n", "s", "x").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens")).select(
        F.explode("tokens").alias("token"), "item")


def with_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """``pages`` with their tokens replaced by the items (token, item); a token without one goes."""
    sets = pages.select("tokens").distinct()
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(items, "token").groupBy("tokens").agg(
        F.sort_array(F.collect_set("item")).alias("items"))
    return pages.join(found, "tokens", "left").withColumn(
        "tokens", F.coalesce("items", F.array().cast("array<string>"))).drop("items")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               least: int = 1) -> DataFrame:
    """(rule_id, tokens, label, confidence, support) from rows (tokens, label); pruned, see the module."""
    # more than all rows is never reached: no rules then
    min_support = max(min_support, (least - 0.5) / max(labelled.count(), 1))
    if min_support > 1:
        labelled, min_support = labelled.limit(0), 1.0
    items = labelled.select(F.concat(F.col("tokens"), F.array(F.concat(F.lit("label="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("label=")).select(
        F.sort_array("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 7, 100).alias("label"),
        "confidence", "support")
    rules = written(rules, "mined").withColumn("rule_id", F.concat_ws(" ", F.concat(F.col("tokens"), F.array("label"))))
    # one token fewer is enough to look at: a longer chain of useless tokens falls away step by step
    shorter = rules.select(F.col("rule_id").alias("_id"), "label", F.explode("tokens").alias("_t"), "tokens", "confidence")
    shorter = shorter.select("_id", "label", F.array_except("tokens", F.array("_t")).alias("tokens"),
                             F.col("confidence").alias("_c"))
    useless = shorter.join(rules.select("tokens", "label", "confidence"), ["tokens", "label"]).where(
        "confidence >= _c").select(F.col("_id").alias("rule_id")).distinct()
    return rules.join(useless, "rule_id", "left_anti")


def match_rules(pages: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(page_id, label) of the pages (page_id, tokens) that a rule matches; ``counts`` (token, n) say what is rare."""
    by_token = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token", "left")
    index = by_token.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = index.join(rules, "rule_id").select("token", F.col("tokens").alias("needs"), "label", "confidence", "support")
    found = pages.select("page_id", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(
        F.forall("needs", lambda x: F.array_contains(F.col("tokens"), x)))
    best = F.struct(-F.col("confidence"), -F.col("support"), F.size("needs"), F.array_join("needs", " "), "label")
    return found.groupBy("page_id").agg(F.min(best)["label"].alias("label"))


def judge_urls(pages: DataFrame, labels: DataFrame, listed=LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``labels`` are rows (page_id, label)."""
    host, path = host_and_path(F.col("url").cast("string"))
    parted = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    base = written(parted.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"),
                                 url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")), "urls")
    given = labels.select(F.col("page_id").alias("_id"), F.col("label").alias("_label"))
    labelled = written(base.join(given, F.col("page_id") == F.col("_id"), "left").select(
        "tokens", F.coalesce("verdict", "_label").alias("label")).where("label IS NOT NULL AND size(tokens) > 0"), "labelled")
    open_pages = base.where("verdict IS NULL AND page_id IS NOT NULL AND size(tokens) > 0").select("page_id", "tokens")
    if not labelled.limit(1).count():
        matched = open_pages.select(F.col("page_id").alias("_id"), F.lit(None).cast("string").alias("label")).limit(0)
    else:
        items = written(merged_tokens(labelled), "items")
        rules = mine_rules(with_items(labelled, items), least=LEAST_PAGES)
        open_pages = written(with_items(open_pages, items), "open")
        counts = open_pages.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        matched = match_rules(open_pages, rules, counts).withColumnRenamed("page_id", "_id")
    return base.join(matched, F.col("page_id") == F.col("_id"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "label", F.lit("allow")).alias("verdict"))


def op4(spark, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow").alias("label"))
    return judge_urls(table(spark, sf_dir, "pages"), labels)
