"""The similarity join against all pairs."""

import difflib
import random
from collections import Counter

from fieldmark.operators.similarity import candidate_pairs, fuzzy_hits


def misspelt(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(out) + 1)
        out[k:k + rng.randint(0, 1)] = rng.choice(["", "x", "e", "é", out[k] * 2 if k < len(out) else "s"])
    return "".join(out)


def corpus(n_surfaces, n_spans, seed):
    rng = random.Random(seed)
    syllables = ["cre", "dit", "tau", "x", "mar", "ge", "ne", "tte", " ", "ris", "que", "pro", "vi", "sion", "a", "im", "mo"]
    surfaces = list(dict.fromkeys("".join(rng.choice(syllables) for _ in range(rng.randint(2, 8))).strip() for _ in range(n_surfaces)))
    surfaces = [s for s in surfaces if s]
    spans = list(dict.fromkeys(misspelt(rng, rng.choice(surfaces)) if k % 2 else
                               "".join(rng.choice(syllables) for _ in range(rng.randint(1, 8))) for k in range(n_spans)))
    return surfaces, spans


def overlap(x, y):
    return sum((Counter(x) & Counter(y)).values())


def frames(spark, surfaces, spans):
    lookup = spark.createDataFrame([(s, f"K{i}", i, len(s)) for i, s in enumerate(surfaces)],
                                   "surface string, canonical string, ord int, len int")
    return spark.createDataFrame([(s,) for s in spans] + [(None,)], "n string"), lookup


def test_against_all_pairs(spark):
    surfaces, spans = corpus(400, 500, 1)
    spans += ["", "aaaaaaaaaa", "z" * 300, "中文字"]
    surfaces += ["中文字", "aaaaaaaaaaa", "y" * 299 + "z"]
    spans_n, lookup = frames(spark, surfaces, spans)
    for cutoff in (0.9, 0.75):
        bags = {s: Counter(s) for s in surfaces}
        near, best = set(), {}
        for n in dict.fromkeys(spans):
            own = Counter(n)
            for s in surfaces:
                m = sum((own & bags[s]).values())
                if n and 2.0 * m / (len(n) + len(s)) >= cutoff:
                    near.add((n, s, m))
                    score = difflib.SequenceMatcher(None, s, n).ratio()
                    if score >= cutoff:
                        best[n] = max(best.get(n, (0, "")), (score, s))
        pairs = [tuple(r) for r in candidate_pairs(spans_n, lookup, cutoff).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == near  # each once, none lost, none beyond the bound
        got = {r.n: tuple(r._best) for r in fuzzy_hits(spans_n, lookup, cutoff).collect()}
        assert got == best


def test_candidates_are_few(spark):
    """Of all pairs only those whose overlap allows the cutoff reach ``difflib``."""
    surfaces, spans = corpus(1500, 1500, 2)
    spans_n, lookup = frames(spark, surfaces, spans)
    n = candidate_pairs(spans_n, lookup).count()
    assert n < len(surfaces) * len(spans) / 200


def test_empty_sides(spark):
    spans_n, lookup = frames(spark, ["abc"], ["abc"])
    assert fuzzy_hits(spans_n.limit(0), lookup).collect() == []
    assert fuzzy_hits(spans_n, lookup.limit(0)).collect() == []
