import itertools

import numpy as np

from fieldmark.llm import ngram_join as J
from helpers import awkward, documents, prose, words


def shingles(text):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def copies(n, seed, size=80):
    """Near copies of each other at similarities around the threshold, and some that chain."""
    rng, out, base = np.random.default_rng(seed), [], words(prose(size, seed))
    for k in range(n):
        w = list(base)
        for at in rng.integers(0, size, rng.integers(0, 5)):
            w[at] = f"edit{seed}x{k}y{at}"
        out.append(" ".join(w[rng.integers(0, 6):]))
    return out


def check(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(documents(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def test_against_brute_force(spark):
    texts = awkward() + [t for s in range(6) for t in copies(9, s)] + ["Tiny TEXT", "tiny text", "five words are in here"]
    check(spark, texts)


def test_hot_shingles_and_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "FLUSH", 900)
    monkeypatch.setattr(J, "RANGE", 400)
    passage = prose(30, 77)
    texts = copies(40, 3) + [passage + " " + prose(12, 100 + k) for k in range(25)] + copies(12, 5, 30)
    check(spark, texts)


def test_stage_keeps_one_of_each_group(spark):
    texts = awkward() + copies(8, 1) + ["", None]
    docs = documents(spark, texts)
    want = brute(list(enumerate(texts)))
    kept = J.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, c) in want.items() if i == c]
    twice = docs.unionByName(docs)
    ids = sorted(r.doc_id for r in J.stage(spark, twice, "").collect())
    with_words = [i for i, (n, c) in want.items() if i == c and n]
    assert [i for i in ids if want[i][0]] == with_words


def test_empty_table(spark):
    docs = documents(spark, ["a"]).limit(0)
    assert J.jaccard_components(docs).count() == 0 and J.stage(spark, docs, "").count() == 0


def test_stage_with_null_and_repeated_ids(spark):
    a, b, c = prose(40, 1), prose(40, 2), prose(40, 3)
    near = " ".join(a.split()[:-1] + ["other"])
    rows = [(None, a), (5, near), (None, near),  # a group with one id: 5 stays
            (None, b), (None, b + " "), (None, b),  # only null ids: one row stays
            (7, c), (7, c.upper()), (7, "  " + c),  # an id repeated with the same set: one row stays
            (5, c + " "),  # the smallest id of the group of c, and the id of another group's leader
            (9, a), (9, None), (None, ""), (None, "")]
    kept = J.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    left = [(r.doc_id, r.text) for r in kept]
    worded = [x for x in left if x[1]]
    assert len(worded) == 3
    assert (5, near) in worded and (5, c + " ") in worded
    assert [t.strip() for i, t in worded if i is None] == [b]
    assert sorted(x for x in left if not x[1] and x[0] is None) == [(None, "")] * 2 and (9, None) in left


def test_stage_with_columns_named_like_inner_ones(spark):
    names = ["id", "key", "_id", "_key", "root", "sig", "n", "h", "KEY2", "none", "l", "f"]
    text = prose(80, 1)
    rows = [(i, t, *range(i, i + len(names))) for i, t in enumerate([text, prose(90, 2), text, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
    kept = J.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[1], rows[3]], key=str)
