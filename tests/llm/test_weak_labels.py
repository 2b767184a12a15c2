import numpy as np

from fieldmark.llm import weak_labels as W
from helpers import awkward, documents, prose, words


def table(n=260):
    rng, texts, bad = np.random.default_rng(4), [], []
    for k in range(n):
        w = [x + "." if j % 9 == 8 else x for j, x in enumerate(words(prose(int(rng.integers(30, 90)), 100 + k)))]
        kind = k % 6
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        elif kind == 1:
            w = [x + "***" for x in w]
        elif kind == 2:
            w.insert(int(rng.integers(0, len(w))), "vexgrob" + rng.choice(["a", "ti", "un"]))  # only labels tell
        texts.append(" ".join(w))
        bad.append(kind < 3)
    return texts, bad


def test_held_out_documents(spark):
    texts, bad = table()
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 0 if bad[i] and i % 6 != 2 else 1, int(i % 6 == 2)) for i in range(len(texts)) if i % 5 < 3],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in W.score(docs, labels).collect()}
    held = [i for i in range(len(texts)) if i % 5 >= 3]
    assert np.mean([got[i] != bad[i] for i in held]) > 0.93
    assert np.mean([got[i] for i in held if not bad[i]]) > 0.95


def test_em_recovers_the_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    right = (0.9, 0.75, 0.6)
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) for a in right], 1)
    patterns = ["".join("0" if v else "1" for v in row) + "2" for row in votes]
    counted = sorted({p: patterns.count(p) for p in set(patterns)}.items())
    _, share, seen = W.fit_labellers([p for p, _ in counted], [n for _, n in counted], 400)
    assert abs(share - 0.3) < 0.12
    assert seen[0, 0, 0] > seen[1, 0, 0] > seen[2, 0, 0] > 0.5


def test_awkward_rows_and_empty_tables(spark):
    docs = documents(spark, awkward())
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, None), (7, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert W.score(docs, labels).count() == len(awkward())
    assert W.score(docs.limit(0), labels).count() == 0
    assert W.score(docs, labels.limit(0)).count() == len(awkward())
