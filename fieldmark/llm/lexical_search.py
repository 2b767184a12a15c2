"""Ranked lexical search: buckets by length, Cauchy-Schwarz and coordinate bounds, exact integer rescoring.

Every document is an impact vector over the terms of the queries: coordinate ``sqrt(w) * x`` for the integer impact
``x = (10^9 tf) div (1000 tf + 8 m)``; a query is ``sqrt(w) * tf`` over its terms, so that their inner product is the
score.  One pass over the texts writes the term counts of each document (only of terms that a query holds) with the
counts of the whole table; from these come the weights.  The search then reads vectors, not texts:

* the vectors of a chunk are ordered by length and cut into buckets of similar length;
* a bucket whose longest vector times the query's length stays below the query's threshold holds no hit
  (Cauchy-Schwarz), nor does any later one;
* inside a bucket the query's coordinates are looked up, the largest first and ``FOCUS`` at a time; what the others can
  add is bounded by the lengths of what is left of both vectors, and, coordinate by coordinate, by the document's
  largest impact; documents below the threshold fall out;
* the others are scored in 64-bit integers, from all their terms.

A threshold is the k-th best score so far.  It starts with that of the longest bucket of every chunk, found in a round
of its own, and rises with the task's own hits.  Bounds are only compared with strictly smaller values, with a margin
for rounding, so that no hit and no tie is lost.  Queries are taken in blocks of about ``BLOCK_BYTES`` of text; the
documents are read once a block.

Terms stand as 64-bit hashes of their bytes.  Scale: texts are never shuffled; what goes to the driver is a block of
queries, the document counts of its terms and one threshold for each.  A task sends at most k rows a query.

Edge cases: null and empty texts have no terms and are never found; a very long text is read in pieces; repeated rows
of ``docs`` are documents of their own, and come out as often; equal scores go by ascending id, a null id after all
others; repeated rows of ``items`` (same id and text) are one query, rows that share an id but not the text are
queries of their own, and an item without terms has no rows; empty tables give an empty result; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import (
    LOWER, arrow_text, planes, prefix_hash, row_slices, runs, span_hash, table, unplanes, written,
)

#: Hits of a query.
K = 10
#: Text of the queries of one block.
BLOCK_BYTES = 4 << 20
#: Bytes of text hashed at once, and vector entries in one chunk.
SLICE_BYTES, CHUNK_ENTRIES = 2 << 20, 1 << 20
#: A bucket ends at this many vectors, or, from the smaller number on, at this share of its longest vector.
BUCKET_MOST, BUCKET_LEAST, BUCKET_SHARE = 2048, 256, 0.9
#: Coordinates of a query that are looked up between two looks at the bounds.
FOCUS = 8
#: What floating-point sums may be off by, as a share.
MARGIN = 1e-9
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
CHUNK = {"n_docs": "long", "n_terms": "long", "n_found": "int", "df": "array<struct<term:int, n:int>>", "ids": "binary",
         "nulls": "binary", "n": "binary", "sizes": "binary", "terms": "binary", "tfs": "binary"}


def terms_of(text: str | None) -> list[str]:
    """Terms of a text, in order."""
    return _TERM.findall((text or "").translate(_UPPER))


def hash_of(terms: list[str]) -> np.ndarray:
    """64-bit hashes of terms, as ``term_hashes`` finds them in a text."""
    if not terms:
        return np.empty(0, np.uint64)
    raw = [t.encode() for t in terms]
    ends = np.cumsum([len(t) for t in raw])
    return span_hash(prefix_hash(np.frombuffer(b"".join(raw), np.uint8)), np.concatenate(([0], ends[:-1])), ends)


def term_hashes(data: np.ndarray, offsets: np.ndarray, chunk: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every term, in order, in pieces that end between terms."""
    hashes, docs, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = min(at + chunk, len(data))
        inside = _INSIDE[data[at:end]]
        while end < len(data) and inside[-1]:  # go on to the end of the last term
            more = _INSIDE[data[end:end + chunk]]
            stop = np.flatnonzero(~more)
            more = more[:int(stop[0]) + 1] if len(stop) else more
            inside, end = np.concatenate((inside, more)), end + len(more)
        part = LOWER[data[at:end]]
        cuts = np.unique(offsets[(offsets > at) & (offsets < end)]) - at
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        both = cuts[inside[cuts] & inside[cuts - 1]]  # a term never goes on in the next document
        start = np.sort(np.concatenate((np.flatnonzero(edge == 1), both)))
        stop = np.sort(np.concatenate((np.flatnonzero(edge == -1), both)))
        hashes.append(span_hash(prefix_hash(part), start, stop))
        docs.append(np.searchsorted(offsets, start + at, "right") - 1)
        at = end
    return np.concatenate(hashes), np.concatenate(docs)


def _chunk_rows(vocabulary: np.ndarray, batches):
    """Rows of ``CHUNK``: counts of all documents read, term counts of those that hold a term of the vocabulary."""
    import pyarrow as pa

    held, entries, n_docs, n_terms = [], 0, 0, 0

    def row():
        ids, nulls, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.int64),) * 6
        there = np.bincount(terms)
        df = [{"term": int(t), "n": int(there[t])} for t in np.flatnonzero(there)]
        values = [n_docs, n_terms, len(ids), df, planes(ids.astype(np.int64)), nulls.astype(np.uint8).tobytes(),
                  planes(n.astype(np.int64)), planes(sizes.astype(np.int32)), planes(terms.astype(np.int32)),
                  planes(tfs.astype(np.int32))]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())])),
                 *[pa.binary()] * 6]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)],
                               names=list(CHUNK))

    for batch in batches:
        data, offsets = arrow_text(batch.column(1))
        ids, nulls = batch.column(0).fill_null(0).to_numpy(), np.asarray(batch.column(0).is_null())
        for lo, hi in row_slices(offsets, SLICE_BYTES):
            hashes, docs = term_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            n = np.bincount(docs, minlength=hi - lo)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + len(hashes)
            if len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                hit = vocabulary[at] == hashes
                key, tf = np.unique(docs[hit] * len(vocabulary) + at[hit], return_counts=True)
                doc, term = np.divmod(key, len(vocabulary))
                cut = runs(doc)
                found = doc[cut[:-1]]
                if len(found):
                    held.append((ids[lo + found], nulls[lo + found], n[found], np.diff(cut), term, tf))
                    entries += len(term)
            if entries >= CHUNK_ENTRIES:
                yield row()
                held, entries, n_docs, n_terms = [], 0, 0, 0
    yield row()


class Queries:
    """A block of queries: their terms, and, once the table's counts are known, their weights."""

    def __init__(self, texts: list[str]):
        found = [terms_of(t) for t in texts]
        words = sorted({t for ts in found for t in ts})
        hashes = hash_of(words)
        order = np.argsort(hashes)
        number = {words[i]: k for k, i in enumerate(order.tolist())}
        self.vocabulary = hashes[order]
        self.terms, self.counts = [], []
        for ts in found:
            t, c = np.unique([number[x] for x in ts], return_counts=True) if ts else (np.empty(0, np.int64),) * 2
            self.terms.append(t)
            self.counts.append(c.astype(np.int64))

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))
                                 for t in range(len(self.vocabulary))], np.int64)
        self.roots = np.sqrt(self.weights.astype(np.float64))
        self.values, self.rest, self.lengths = [], [], np.zeros(len(self.terms))
        for q, (t, c) in enumerate(zip(self.terms, self.counts)):
            value = self.roots[t] * c
            order = np.argsort(-value, kind="stable")  # the largest coordinates first
            self.terms[q], self.counts[q] = t[order], c[order]
            self.values.append(value[order])
            weight = (self.weights[t] * c)[order].astype(np.float64)
            # what is left from each coordinate on: the length, and the sum of the weights
            self.rest.append([np.append(x[::-1].cumsum()[::-1], 0.0) for x in (self.values[q] ** 2, weight)])
            self.lengths[q] = math.sqrt(self.rest[q][0][0])


class Vectors:
    """The impact vectors of a chunk, the longest first."""

    def __init__(self, queries: Queries, row: dict):
        ids, n, sizes = unplanes(row["ids"], np.int64), unplanes(row["n"], np.int64), unplanes(row["sizes"], np.int32)
        terms, tf = unplanes(row["terms"], np.int32), unplanes(row["tfs"], np.int32).astype(np.int64)
        m = 25 + (75 * n * queries.n_docs) // max(queries.n_terms, 1)
        doc = np.repeat(np.arange(len(ids)), sizes)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        square = (queries.roots[terms] * impact) ** 2
        length = np.sqrt(np.bincount(doc, square, len(ids)))
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        by = np.argsort(place[doc], kind="stable")
        self.terms, self.impact = terms[by].astype(np.int64), impact[by]
        self.starts = np.concatenate(([0], np.cumsum(sizes[order])))
        self.ids, self.lengths = ids[order], length[order]
        self.largest = np.maximum.reduceat(self.impact, self.starts[:-1]).astype(np.float64) if len(ids) else length
        self.nulls = np.frombuffer(row["nulls"], np.uint8)[order]

    def buckets(self):
        lo = 0
        while lo < len(self.ids):
            shorter = int(np.searchsorted(-self.lengths, -self.lengths[lo] * BUCKET_SHARE, "right"))
            hi = min(max(shorter, lo + BUCKET_LEAST), lo + BUCKET_MOST, len(self.ids))
            yield lo, hi
            lo = hi


class Search:
    """The best documents of each query among the vectors seen."""

    def __init__(self, queries: Queries, k: int, thresholds: np.ndarray):
        self.q, self.k, self.least = queries, k, thresholds.astype(np.float64).copy()
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.dense = np.zeros(len(queries.vocabulary), np.int64)
        self.scored = self.pairs = 0

    def bucket(self, v: Vectors, lo: int, hi: int, alive: np.ndarray) -> None:
        begin, end = int(v.starts[lo]), int(v.starts[hi])
        terms = v.terms[begin:end]
        doc = np.repeat(np.arange(hi - lo), np.diff(v.starts[lo:hi + 1]))
        value = self.q.roots[terms] * v.impact[begin:end]
        by = np.argsort(terms, kind="stable")
        index, doc_by, value_by = terms[by], doc[by], value[by]
        squares, largest = v.lengths[lo:hi] ** 2, v.largest[lo:hi]
        for q in alive.tolist():
            mine, values, (lengths, weights) = self.q.terms[q], self.q.values[q], self.q.rest[q]
            left, right = np.searchsorted(index, mine), np.searchsorted(index, mine, "right")
            part, off, among = np.zeros(hi - lo), np.zeros(hi - lo), np.arange(hi - lo)
            for f in range(0, len(mine), FOCUS):
                g = min(f + FOCUS, len(mine))
                for a, b, x in zip(left[f:g].tolist(), right[f:g].tolist(), values[f:g].tolist()):
                    if b > a:  # a term stands once in a document
                        part[doc_by[a:b]] += x * value_by[a:b]
                        off[doc_by[a:b]] += value_by[a:b] ** 2
                bound = part[among] + np.minimum(
                    np.sqrt(lengths[g] * (np.maximum(squares[among] - off[among], 0) + MARGIN * squares[among])),
                    weights[g] * largest[among])
                among = among[(bound * (1 + MARGIN) >= self.least[q]) & (bound > 0)]
                if not len(among):
                    break
            self.pairs += hi - lo
            if len(among):
                self._score(v, q, lo + among)

    def _score(self, v: Vectors, q: int, docs: np.ndarray) -> None:
        self.scored += len(docs)
        sizes = v.starts[docs + 1] - v.starts[docs]
        ends = np.cumsum(sizes)
        entries = np.repeat(v.starts[docs] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        terms = self.q.terms[q]
        self.dense[terms] = self.q.weights[terms] * self.q.counts[q]
        score = np.add.reduceat(self.dense[v.terms[entries]] * v.impact[entries], ends - sizes)
        self.dense[terms] = 0
        good = np.flatnonzero((score > 0) & (score >= self.least[q]))
        if not len(good):
            return
        new = score[good], v.nulls[docs[good]], v.ids[docs[good]]
        if q in self.best:
            new = tuple(np.concatenate(x) for x in zip(self.best[q], new))
        order = np.lexsort((new[2], new[1], -new[0]))[:self.k]
        self.best[q] = tuple(x[order] for x in new)
        if len(order) == self.k:
            self.least[q] = max(self.least[q], float(new[0][order[-1]]))

    def chunk(self, row: dict, first_only: bool) -> None:
        if not row["n_found"]:
            return
        v = Vectors(self.q, row)
        for lo, hi in v.buckets():
            reach = self.q.lengths * v.lengths[lo] * (1 + MARGIN)
            alive = np.flatnonzero((reach >= self.least) & (reach > 0))
            if not len(alive):  # nor does any later bucket reach further
                return
            self.bucket(v, lo, hi, alive)
            if first_only:
                return


def _hit_rows(queries: Queries, k: int, thresholds: np.ndarray, first_only: bool, batches):
    import pyarrow as pa

    search = Search(queries, k, thresholds)
    for batch in batches:
        for row in batch.to_pylist():
            search.chunk(row, first_only)
    for q, (score, null, ids) in search.best.items():
        yield pa.record_batch([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=null.astype(bool)),
                               pa.array(score)], names=["q", "doc_id", "score"])


def _best(hits: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[str], k: int) -> DataFrame:
    """(q, doc_id, score, rank) of a block of queries, q their number in ``texts``."""
    queries = Queries(texts)
    chunks = written(docs.mapInArrow(partial(_chunk_rows, queries.vocabulary),
                                     ", ".join(f"{c} {kind}" for c, kind in CHUNK.items())), "impacts")
    n_docs, n_terms = chunks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = chunks.select(F.explode("df").alias("d")).groupBy("d.term").agg(F.sum("d.n").alias("n")).collect()
    queries.weigh(n_docs or 0, n_terms or 0, {r.term: r.n for r in df})
    vectors = chunks.where("n_found > 0").drop("n_docs", "n_terms", "df")

    def hits(thresholds, first_only):
        return vectors.mapInArrow(partial(_hit_rows, queries, k, thresholds, first_only), "q int, doc_id long, score long")

    start = np.zeros(len(texts))
    for r in _best(hits(start, True), k).where(F.col("rank") == k).select("q", "score").collect():
        start[r.q] = r.score
    return _best(hits(start, False), k)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents above score 0 of every item."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = items.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).where("t <> ''").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks, out = 1 + 2 * total // block_bytes, None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        rows = [r for r in rows if terms_of(r.t)]
        if not rows:
            continue
        names = spark.createDataFrame([(q, r.i) for q, r in enumerate(rows)], f"q int, item_id {kind.simpleString()}")
        found = written(_search_block(docs, [r.t for r in rows], k), "hits").join(names, "q").select(
            "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out


def op11(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t"""
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
w AS (SELECT d, doc_id, {_SQL_TERMS} FROM d),
c AS (SELECT count(DISTINCT d) AS docs, count(*) AS terms FROM w),
n AS (SELECT d, count(*) AS n FROM w GROUP BY d),
tf AS (SELECT d, doc_id, t, count(*) AS tf FROM w GROUP BY d, doc_id, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, {_SQL_TERMS} FROM i),
r AS (SELECT item_id, text, t, count(*) AS r FROM q GROUP BY item_id, text, t),
x AS (SELECT item_id, text, t, r * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM r JOIN df USING (t), c),
s AS (SELECT item_id, text, d, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM x JOIN tf USING (t) JOIN n USING (d), c GROUP BY item_id, text, d, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank,
    doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
