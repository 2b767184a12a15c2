"""Ranked search against a plain ranking over all pairs."""

import math
import re
from collections import Counter

import pytest
from helpers import awkward, documents, prose

from fieldmark.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, k=10):
    """docs: (doc_id, text) rows; items: distinct (item_id, text)."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, bag in bags:
            n = sum(bag.values())
            score = 0
            for t in terms(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 25 + 75 * n * n_docs // n_terms
                    score += w * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int")


ITEMS = [(1, prose(12, 1)), (2, prose(30, 2) + " " + prose(4, 2)), (3, "Ünïcode été 中文 x_y a-b A1"), (4, "zzzunknown"),
         (5, " .,"), (None, prose(9, 3)), (1, prose(8, 4))]


def test_against_all_pairs(spark):
    texts = awkward() + [prose(40 + i % 50, 100 + i % 30) for i in range(90)] + [
        "UNICODE ünïcode été", "中文 中文 a1 A1 x", prose(12, 1) + ". " + prose(12, 1).upper(), "x\x00y a b"] + [prose(12, 1)] * 13
    docs = documents(spark, texts).unionByName(documents(spark, [prose(12, 1), prose(12, 1)], 3)).unionByName(
        documents(spark, [prose(12, 1)]).selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang", "source", "n_chars", "h", "id"))
    want = ranking([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    items = items_of(spark, ITEMS + [(9, None), (2, ITEMS[1][1])])
    assert rows(L.search(docs, items)) == want
    assert rows(L.search(docs, items, block_bytes=100)) == want
    assert rows(L.search(docs, items, k=1)) == [r for r in want if r[1] == 1]


def test_buckets_prune_and_lose_nothing(monkeypatch):
    """Small buckets, small focus, many chunks: pruned, and still the exact ranking."""
    import numpy as np
    import pyarrow as pa

    for name, value in (("BUCKET_MOST", 16), ("BUCKET_LEAST", 4), ("FOCUS", 2), ("CHUNK_ENTRIES", 2000)):
        monkeypatch.setattr(L, name, value)
    docs = [(i, prose(20 + i % 70, i, 3000)) for i in range(900)]
    items = [(i, prose(15, 7 * i, 3000)) for i in range(20)]
    queries = L.Queries([t for _, t in items])
    batch = pa.record_batch([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    chunks = [r for b in L._chunk_rows(queries.vocabulary, [batch.slice(i, 90) for i in range(0, 900, 90)]) for r in b.to_pylist()]
    df = Counter()
    for c in chunks:
        df.update({d["term"]: d["n"] for d in c["df"]})
    queries.weigh(sum(c["n_docs"] for c in chunks), sum(c["n_terms"] for c in chunks), df)
    search = L.Search(queries, 10, np.zeros(len(items)))
    for c in chunks:
        search.chunk(c, False)
    got = [(items[q][0], r + 1, int(i), int(s)) for q, (score, _, ids) in search.best.items()
           for r, (s, i) in enumerate(zip(score, ids))]
    assert sorted(got, key=str) == ranking(docs, items)
    assert search.scored < search.pairs / 4 and search.pairs <= len(docs) * len(items)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_terms_at_any_cut(chunk):
    import numpy as np

    texts = ["ab c", "", "Cd été", "x", "y", "a" * 100 + " b", "", "-", "é中"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    hashes, docs = L.term_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets, chunk)
    want = [(d, t) for d, text in enumerate(texts) for t in terms(text)]
    assert docs.tolist() == [d for d, _ in want]
    assert hashes.tolist() == L.hash_of([t for _, t in want]).tolist()


def test_empty_tables(spark):
    none = documents(spark, ["a b"]).limit(0)
    some = items_of(spark, ITEMS)
    assert rows(L.search(none, some)) == []
    assert rows(L.search(documents(spark, [None, "", " "]), some)) == []
    got = L.search(documents(spark, ["a b"]), some.limit(0))
    assert rows(got) == [] and got.columns == ["item_id", "rank", "doc_id", "score"]
