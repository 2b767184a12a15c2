from collections import Counter

from fieldmark.llm import quality_rules as Q
from helpers import SPACE, awkward, documents, prose, words


def brute(text):
    t, w = text or "", words(text)
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in t.split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_exclaims": t.count("!"), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
            "n_repeat_words": len(hit)}


def rejected(m):
    return (m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
            or 2 * m["n_exclaims"] > m["n_words"] or 2 * m["n_dup_lines"] > m["n_lines"]
            or not 2 * m["n_words"] <= m["word_chars"] <= 14 * m["n_words"])


def texts():
    return awkward() + ["a b c d e f g h i " * 9, prose(20, 3), prose(19, 3), prose(40, 4) + "\n" + prose(40, 4),
                        " | ".join(words(prose(50, 5))), "!! ".join(words(prose(50, 6))), "same line of words here\n" * 12]


def test_measures_against_brute_force(spark):
    rows = texts()
    got = {r.doc_id: r for r in Q.with_measures(documents(spark, rows)).collect()}
    for i, t in enumerate(rows):
        for name, value in brute(t).items():
            assert got[i][name] == value, (i, name)


def test_cascade_keeps_what_no_rule_rejects(spark):
    rows, docs = texts(), documents(spark, texts())
    kept = Q.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(rows) if not rejected(brute(t))}
    lazy = {r.doc_id: r.failed_rule for r in Q.cascade(docs).collect()}
    done = {r.doc_id: r.failed_rule for r in Q.cascade(Q.with_measures(docs), measured=True).collect()}
    assert {i for i in lazy if lazy[i]} == {i for i in done if done[i]} == {i for i, t in enumerate(rows) if rejected(brute(t))}


def test_plan_orders_by_rejection_per_cost_and_empty_table(spark):
    docs = documents(spark, texts())
    plan = Q.plan_cascade(docs)
    worth = [x["rejects"] / max(x["cost"], 1e-6) for x in plan]
    assert worth == sorted(worth, reverse=True) and len(plan) == len(Q.RULES)
    assert Q.stage(spark, docs.limit(0), "").count() == 0


def test_same_order_every_time(spark):
    """Of two rules that reject the same rows, the one that needs no windows goes first in every run."""
    docs = documents(spark, [prose(2000, n) for n in range(30)] + [prose(300, 1) + " " + prose(300, 1)] * 10 + ["!"] * 10)
    cheap = Q.Rule("short", lambda m: (m["n_words"] == 600) | (m["n_words"] < 20), ("n_words",))
    for _ in range(3):
        plan = Q.plan_cascade(docs, (Q.BASE_RULES[1], cheap))
        assert [x["rule"].name for x in plan] == ["short", "repeated_words"] and plan[1]["cost"] > 3 * plan[0]["cost"]


def test_stage_keeps_columns_named_like_inner_ones(spark):
    rows = [(i, t, "own", 1, "w") for i, t in enumerate([prose(60, 1), "few", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, failed_rule string, n_words long, t string")
    out = Q.stage(spark, docs, "")
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == rows[:1]


def test_space_pattern():
    assert SPACE.split("a\x0bb\x0cc") == ["a", "b", "c"]
