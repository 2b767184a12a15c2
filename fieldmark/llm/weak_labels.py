"""Quality classifier from weak labels: expectation-maximisation over labellers, then a hashed linear scorer.

Labellers vote bad, good, or nothing on every document; they overlap and err.  One is the label table (bad: quality
0 or toxic 1), which is right with probability TRUST where it has a vote; the others are heuristics.  Documents are counted by their votes (at most 3 ** labellers patterns, so
the counts are small at any size), and EM finds from these counts of all documents the share of bad documents and
each labeller's votes given the truth; that gives every pattern a posterior.  A logistic scorer over hashed words and
shape features learns the posteriors of a bounded sample (TRAIN_ROWS and MORE_ROWS documents, by a hash of the id) and scores all
documents from their whole texts.  A document is kept if the scorer finds it more likely good than bad.

Edge cases: a null or empty text has no words, and only the scorer's bias and shape; a document without a label has
no vote from the table, and several labels count as bad if one is; repeated rows get the same score; an empty table
gives an empty result; without any votes for one side nothing is learned and all is kept.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import LOWER, arrow_text, mix, prefix_hash, row_slices, span_hash, table, words, written
from fieldmark.llm.quality_rules import SYMBOLS, chars_of, word_list, let

BAD, GOOD, NONE = 0, 1, 2
#: Documents that the scorer learns from, at most (about): with a vote of the table, and without.
TRAIN_ROWS, MORE_ROWS = 12_000, 4_000
#: How far the label table is trusted where it has a vote.
TRUST = 0.98
#: Weight of a document that the table has no vote on, beside 1 of one that it has.  The scorer learns only from those of
#: them that the heuristics reject: that none rejects a text says little, and a scorer that learns it by heart forgets
#: what only the table tells.
UNLABELLED = 0.1
#: Hash buckets of the scorer.
BUCKETS = 1 << 18
#: Further buckets, for the shape.
SHAPES = 64
#: Bytes of a word's beginnings that are features beside the word.
STEMS = (4, 5)
# Insults that one labeller counts.
INSULTS = ("idiot", "moron", "stupid", "trash", "scum", "pathetic", "worthless", "loser", "disgusting", "clown")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)


def labellers(text: Column) -> dict[str, Column]:
    """The heuristics' votes, from the text alone."""
    words_of = let(word_list(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    insults = F.size(F.regexp_extract_all(F.lower(text), F.lit(rf"\b({'|'.join(INSULTS)})\b"), F.lit(0)))
    n, d, size = F.col("_w.n"), F.col("_w.d"), F.length(text)
    return {
        "_w": words_of,
        "symbols": _vote(10 * chars_of(text, SYMBOLS) > n, chars_of(text, SYMBOLS) == 0),
        "shouting": _vote(2 * chars_of(text, "!") > n, chars_of(text, "!") * 50 < n),
        "length": _vote((size > 8 * n) | (n < 20), size < 7 * n),
        "variety": _vote(10 * d < 3 * n, 10 * d > 5 * n),
        "sentences": _vote((n > 60) & (60 * chars_of(text, ".") < n), 30 * chars_of(text, ".") > n),
        "insults": _vote(insults > 0, insults == 0),
    }


def votes_of(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, votes) of every row: one digit per labeller, the label table's last."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    made = labellers(F.col("text"))
    own = own.withColumn("_w", made.pop("_w"))
    own = written(own.select("doc_id", F.concat(*[v.cast("string") for v in made.values()]).alias("votes")), "votes")
    given = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(((F.col("quality") == 0) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("_bad"))
    return own.join(given, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.concat(
        "votes", F.when(F.col("_bad") == 1, str(BAD)).when(F.col("_bad") == 0, str(GOOD)).otherwise(str(NONE))).alias("votes"))


def fit_labellers(patterns: list[str], counts: list[int], turns: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """EM from counts of vote patterns: P(bad | pattern), the share of bad, and P(vote | truth) as [labeller, truth, vote]."""
    votes = np.array([[int(c) for c in p] for p in patterns])
    n = np.array(counts, float)
    against, in_favour = (votes == BAD).sum(1), (votes == GOOD).sum(1)
    bad = np.where(against > 0, 0.5 + 0.45 * (against / (against + 0.25 * in_favour)), 0.05)  # rejections are the rarer votes
    seen = (votes[:, :, None] == np.arange(3)).astype(float)
    table_says = np.array([{BAD: TRUST, GOOD: 1 - TRUST, NONE: np.nan}[v] for v in votes[:, -1]])
    given = ~np.isnan(table_says)
    for _ in range(turns):
        bad = np.where(given, table_says, bad)  # anchors: else the two classes may become any two kinds of text
        known = n * np.where(given, 1.0, UNLABELLED)
        weight = np.stack((known * bad, known * (1 - bad)), 1)
        share = (weight.sum(0) + 1) / (known.sum() + 2)
        table_ = np.einsum("pc,pkv->kcv", weight, seen) + 0.5
        table_ /= table_.sum(2, keepdims=True)
        score = np.log(share) + np.einsum("pkv,kcv->pc", seen, np.log(table_))
        bad = 1 / (1 + np.exp(np.clip(score[:, 1] - score[:, 0], -50, 50)))
    return np.where(given, table_says, bad), float(share[0]), table_


_STRIP = np.isin(np.arange(256), list(b".,;:!?\"'()"))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, as (text number, bucket): its distinct words and their beginnings, and its shape."""
    low = LOWER[data]
    start, end, doc = words(low, offsets)
    n = len(offsets) - 1
    bare = end - (_STRIP[low[np.maximum(end - 1, 0)]] & (end - start > 1)) if len(end) else end
    sums, own = prefix_hash(low), doc.astype(np.uint64) << np.uint64(32)
    pairs = np.unique(own | span_hash(sums, start, bare) % np.uint64(BUCKETS))
    stems = [own[(long := bare - start > size)] | mix(span_hash(sums, start[long], start[long] + size)) % np.uint64(BUCKETS)
             for size in STEMS]
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    at = np.searchsorted(offsets, np.arange(len(data)), "right") - 1 if len(data) else np.empty(0, int)
    shapes = []
    for k, mask in enumerate((np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8)), data == 33, (data >= 65) & (data <= 90))):
        shapes.append((np.bincount(at[mask], minlength=n) / count, (0.02, 0.1, 0.4, 0.8), 10 * k))
    shapes.append((np.diff(offsets) / count, (5.0, 6.5, 7.5, 8.5), 30))
    shapes.append((np.bincount((pairs >> np.uint64(32)).astype(int), minlength=n) / count, (0.1, 0.3, 0.5, 0.7), 40))
    shapes.append((count, (20, 50, 200, 1000), 50))
    extra = [(np.arange(n, dtype=np.uint64) << np.uint64(32)) | (np.searchsorted(steps, value, "right") + BUCKETS + base).astype(np.uint64)
             for value, steps, base in shapes]
    pairs = np.unique(np.concatenate((pairs, *stems, *extra)))
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def values_of(text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """A text's words share a weight whatever its length; its shape counts in full."""
    shape = bucket >= BUCKETS
    count = np.bincount(text[~shape], minlength=n)
    return np.where(shape, 1.0, 6.0 / np.sqrt(np.maximum(count, 1))[text])


def _feature_rows(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = arrow_text(batch.column(0))
        for lo, hi in row_slices(offsets):
            doc, bucket = features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(lo, hi - lo), pa.array([bucket[a:b].astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                names=["votes", "features"])


def fit_scorer(rows: list[np.ndarray], bad: np.ndarray, weight: np.ndarray, turns: int = 12, most: int = 400, settled: float = 0.02,
               batch: int = 64, rate: float = 0.1, shrink: float = 1e-3, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels (AdaGrad): bucket weights and bias of the log-odds of bad.

    A feature counts by how far its rows' labels lean to one side (the log of its share in bad rows over that in good
    ones), so that a word which tells is not outweighed by the many that only tell the rows of the sample apart.
    At least ``turns`` passes, then until the loss above that of the soft labels themselves falls by less than the share
    ``settled`` in a pass: few rows make few steps a pass, and rare words need as many steps as in a large sample.
    """
    rng, w, seen, bias, bias_seen = np.random.default_rng(seed), np.zeros(BUCKETS + SHAPES), np.ones(BUCKETS + SHAPES), 0.0, 1.0
    side = np.zeros((2, BUCKETS + SHAPES))
    for row, b, u in zip(rows, bad, weight):
        side[0, row] += u * b
        side[1, row] += u * (1 - b)
    whole = np.array([(weight * bad).sum(), (weight * (1 - bad)).sum()])
    lean = np.abs(np.log((side[0] + 1) / (whole[0] + 2)) - np.log((side[1] + 1) / (whole[1] + 2)))
    lean[BUCKETS:] = 1.0
    sure = np.clip(bad, 1e-9, 1 - 1e-9)
    floor = -float((weight * (bad * np.log(sure) + (1 - bad) * np.log(1 - sure))).sum())  # what no weights can undercut
    before = np.inf
    for turn in range(most):
        order, loss = rng.permutation(len(rows)), -floor
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            at = np.repeat(np.arange(len(pick)), [len(rows[k]) for k in pick])
            f = np.concatenate([rows[k] for k in pick])
            v = values_of(at, f, len(pick)) * lean[f]
            z = np.bincount(at, w[f] * v, len(pick)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            loss -= float((weight[pick] * (bad[pick] * np.log(p) + (1 - bad[pick]) * np.log1p(-p))).sum())
            miss = (p - bad[pick]) * weight[pick]
            used, back = np.unique(f, return_inverse=True)
            g = np.bincount(back, miss[at] * v) + shrink * w[used]
            seen[used] += g * g
            w[used] -= rate * g / np.sqrt(seen[used])
            b = float(miss.sum())
            bias_seen += b * b
            bias -= rate * b / np.sqrt(bias_seen)
        if turn + 1 >= turns and loss > (1 - settled) * before:
            break
        before = loss
    return (w * lean).astype(np.float32), bias


def _scores(weights, bias: float, batches):
    import pyarrow as pa

    w = weights.value
    for batch in batches:
        data, offsets = arrow_text(batch.column(1))
        for lo, hi in row_slices(offsets):
            doc, bucket = features(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            z = np.bincount(doc, w[bucket] * values_of(doc, bucket, hi - lo), hi - lo) + bias
            p = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array(p < 0.5)],
                                             names=["doc_id", "bad_score", "kept"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS):
    """(weights, bias) of the scorer, or (None, 0.0) where one side has no votes."""
    votes = written(votes_of(docs, labels, doc_id, text), "all-votes")
    found = sorted(tuple(r) for r in votes.groupBy("votes").count().collect())
    if not any(str(BAD) in p for p, _ in found) or not any(str(GOOD) in p for p, _ in found):
        return None, 0.0
    bad = dict(zip([p for p, _ in found], fit_labellers(*zip(*found))[0]))
    given = sum(n for p, n in found if p[-1] != str(NONE))
    steps, total = 1 << 20, sum(n for _, n in found)
    share = lambda most, of: max(1, int(steps * min(1.0, most / max(1, of))))
    limit = F.when(F.col("votes").endswith(str(NONE)), share(MORE_ROWS, total - given)).otherwise(share(rows, given))
    votes = votes.dropDuplicates(["doc_id"]).where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < limit)
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).where(
        F.pmod(F.xxhash64("_id"), F.lit(steps)) < max(share(MORE_ROWS, total - given), share(rows, given)))
    sample = sample.join(votes, F.col("_id") == F.col("doc_id")).dropDuplicates(["doc_id"]).select("text", "votes")
    got = sorted((r[0], bytes(r[1])) for r in sample.mapInArrow(_feature_rows, "votes string, features binary").collect())
    if not got:
        return None, 0.0
    # without any vote of the table the heuristics' posteriors are all there is
    weight = np.array([1.0 if not v.endswith(str(NONE)) else UNLABELLED * (bad[v] >= 0.5 or not given) for v, _ in got])
    use = np.flatnonzero(weight)
    if not len(use):
        return None, 0.0
    return fit_scorer([np.frombuffer(got[k][1], np.uint32) for k in use], np.array([bad[got[k][0]] for k in use]), weight[use])


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bad_score, kept) of every row."""
    weights, bias = train(docs, labels, doc_id, text)
    if weights is None:
        return docs.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("bad_score"), F.lit(True).alias("kept"))
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS floats, whatever the table's size
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        partial(_scores, sent, bias), f"doc_id {kind}, bad_score double, kept boolean")


def op7(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
