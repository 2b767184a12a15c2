"""Quality rules as a short-circuit cascade (native Spark expressions only).

A rule is a named Boolean expression over measures of the text.  ``plan_cascade`` runs each rule alone over a
sample, takes its time per row as cost and its share of rejected rows as selectivity, and orders the rules by
rejection per cost.  Every row of the sample stands there REPEATS times with its words already split, so that the
time is that of the rule and not that of starting a job; what an empty rule takes is subtracted, and times are the
least of TURNS runs.  The cascade is one CASE over words that are split once: a row pays for the rules up to the
first that rejects it.  The order never changes which rows are rejected.

Edge cases: a null text is the empty text (no words, rejected by ``few_words``); an empty table gives
an empty result and keeps the given order of rules; columns with other names pass through.  ``cascade`` and
``with_measures`` replace a column that clashes with one of theirs; ``stage`` adds none.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import SPACE_CHARS, SPACES, text_of

#: Words of a window whose second occurrence in a text counts as repetition.
WINDOW = 8
#: Rows of the sample that the order of the rules is estimated on.
SAMPLE_ROWS = 1000
#: Times that each of them stands in a timed run, and runs whose least time counts.
REPEATS, TURNS = 8, 3
#: Share of the costliest rule's time below which times are noise: a rule costs at least that.
LEAST_COST = 0.05
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def chars_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(hashes: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more, from the hash of each word."""
    def windows(h):
        return F.when(F.size(h) >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(ranked):
        same = F.filter(ranked, lambda x, j: ((j > 0) & (F.get(ranked, j - 1)["h"] == x["h"]))
                        | (F.get(ranked, j + 1)["h"].eqNullSafe(x["h"])))
        starts = F.sort_array(F.transform(same, lambda x: x["i"]))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                           lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"),
                                                 i.alias("last")))["n"]

    def count(w):
        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ranked, covered))

    return let(let(hashes, windows), count)


def line_list(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def measures(text: Column, words: Column) -> dict[str, Column]:
    """Every measure as an expression of the text and its word list."""
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, SPACE_CHARS, "")),
        "n_symbols": chars_of(text, SYMBOLS),
        "n_exclaims": chars_of(text, "!"),
        "n_dup_lines": let(line_list(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_lines": F.size(line_list(text)),
        "n_repeat_words": repeated_words(F.transform(words, lambda w: F.xxhash64(w))),
    }


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add all measures; the text is split into words once."""
    t = text_of(text)
    m = measures(t, word_list(t))
    own = ["n_words", "word_chars", "n_symbols", "n_exclaims", "n_dup_lines", "n_lines", "n_repeat_words"]
    df = df.drop(*own, "_h", "_l")
    df = df.withColumns({
        "_h": F.transform(word_list(t), lambda w: F.xxhash64(w)),
        "_l": let(line_list(t), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
        **{k: m[k].cast("long") for k in ("word_chars", "n_symbols", "n_exclaims")},
    })
    return df.withColumns({
        "n_words": F.size("_h").cast("long"), "n_lines": F.col("_l.n").cast("long"),
        "n_dup_lines": (F.col("_l.n") - F.col("_l.d")).cast("long"),
        "n_repeat_words": repeated_words(F.col("_h")).cast("long"),
    }).drop("_h", "_l")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``reject(measures)`` is true; ``measures`` maps a name to its Column."""

    name: str
    reject: object
    uses: tuple[str, ...]


BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20, ("n_words",)),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"], ("n_repeat_words", "n_words")),
)
MORE_RULES = (
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"], ("n_symbols", "n_words")),
    Rule("shouting", lambda m: 2 * m["n_exclaims"] > m["n_words"], ("n_exclaims", "n_words")),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"], ("n_dup_lines", "n_lines")),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 14 * m["n_words"]),
         ("word_chars", "n_words")),
)
RULES = BASE_RULES + MORE_RULES


def plan_cascade(df: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS,
                 seed: int = 7) -> list[dict]:
    """Cost (seconds) and selectivity of each rule on a sample, in the order to run them."""
    total = df.count()
    if not total:
        return [{"rule": r, "cost": 0.0, "rejects": 0.0} for r in rules]
    sample = df.select(text_of(text).alias("t")).sample(min(1.0, sample_rows / total), seed).limit(sample_rows).select(
        "t", word_list(F.col("t")).alias("w")).persist()
    try:
        n, m = sample.count(), measures(F.col("t"), F.col("w"))
        if not n:
            return [{"rule": r, "cost": 0.0, "rejects": 0.0} for r in rules]
        again = sample.select("t", "w", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def timed(reject: Column) -> tuple[float, float]:
            job, spent = again.agg(F.sum(reject.cast("long"))), []
            for _ in range(TURNS):
                began = time.perf_counter()
                hits = job.first()[0] or 0
                spent.append(time.perf_counter() - began)
            return min(spent), hits / (n * REPEATS)

        nothing, _ = timed(F.col("t").isNull())
        runs = [timed(r.reject(m)) for r in rules]
    finally:
        sample.unpersist()
    least = LEAST_COST * max(spent - nothing for spent, _ in runs)
    found = [{"rule": r, "cost": max(spent - nothing, least, 1e-6) / (n * REPEATS), "rejects": rejects}
             for r, (spent, rejects) in zip(rules, runs)]
    return sorted(found, key=lambda x: -x["rejects"] / x["cost"])


def first_failed(rules, m: dict[str, Column]) -> Column:
    """Name of the first rule that rejects, null if none does: one CASE, evaluated lazily."""
    out = None
    for r in rules:
        out = F.when(r.reject(m), r.name) if out is None else out.when(r.reject(m), r.name)
    return out if out is not None else F.lit(None).cast("string")


def cascaded(df: DataFrame, rules=RULES, text: str = "text") -> Column:
    """Name of the first rule, in the planned order, that rejects the row: each measure is made when a rule asks for it."""
    order = [x["rule"] for x in plan_cascade(df, rules, text)]
    t = text_of(text)
    return let(word_list(t), lambda w: first_failed(order, measures(t, w)))


def cascade(df: DataFrame, rules=RULES, text: str = "text", measured: bool = False) -> DataFrame:
    """Add ``failed_rule``: the first rule, in the planned order, that rejects the row (null: kept).

    ``measured``: the measures are columns already; else each is computed when a rule asks for it.
    """
    if not measured:
        return df.withColumn("failed_rule", cascaded(df, rules, text))
    order = [x["rule"] for x in plan_cascade(df, rules, text)]
    return df.withColumn("failed_rule", first_failed(order, {k: F.col(k) for r in order for k in r.uses}))


def op9(spark, sf_dir: str) -> DataFrame:
    from fieldmark.llm.common import table

    docs = table(spark, sf_dir, "documents")
    order = [x["rule"] for x in plan_cascade(docs)]
    df = with_measures(docs.select("doc_id", "text"))
    m = {k: F.col(k) for k in df.columns}
    failed = first_failed(order, m)
    base = BASE_RULES[0].reject(m) | BASE_RULES[1].reject(m)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     base.alias("base_failed"), failed.isNull().alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that any rule rejects go."""
    return docs.where(cascaded(docs).isNull())


_WORDS_SQL = """
w AS (SELECT doc_id, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
d AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r WHERE c > 1),
c AS (SELECT doc_id, sum(CASE WHEN p IS NULL THEN 8 ELSE least(8, i - p) END) AS n FROM d GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
k AS (SELECT *, NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_exclaims > n_words
        OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept FROM f)
"""
ORACLE = f"""WITH {_WORDS_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM k"""
