"""Exact Jaccard self-join of documents on word 5-grams, by vertical partitioning.

1. Every document becomes the set of 64-bit hashes of its shingles.  Documents with the same set form one class;
   only classes take part from here on.
2. The hash space is cut into ranges, and each class's set is cut with it, so that a task holds one range of the
   order for all classes.  There, shingles of a single class fall away (most do), and those that only classes of
   too different sizes share; the others get their number of classes, which fixes the global order: rare first.
3. A class can only have a partner if the shingles that it shares with others are three quarters of its set.  Those
   that remain are compared where the rarest parts (the prefixes) of their order meet, and only if what both have
   left from there on is enough.
4. Pairs are compared with one leader per shingle first, linked groups are contracted, and only pairs between
   different groups go on, so that a group of n near copies costs about n pairs and not their square.
5. For a pair, the shared order is cut into fragments; each counts its part of the overlap separately, and the
   counts are summed per pair: 100 * overlap >= 75 * union.

Hot shingles: one that many classes of the same task hold is sent as one mark, and its classes are dealt out by
task instead of by shingle, so that no range is filled by it.

Edge cases: a null or empty text has no shingles and links with nothing; a text of fewer than five words is one
shingle; repeated rows are copies of each other; an empty table gives an empty result; other columns pass through
the stage, and names that clash with inner ones do no harm since only id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import (arrow_text, components, mix, planes, row_slices, runs, table, unplanes, unused,
                                  word_hashes, written)

SHINGLE = 5
#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles that a task gathers before it deals them out by range.
FLUSH = 1_000_000
#: Shingles of about one range of the hash space.
RANGE = 2_000_000
#: Classes of one task from which on a shingle counts as hot there.
HOT = 16
#: Ranges of the order in which a pair's overlap is counted separately: 2 ** FRAGMENT_BITS.
FRAGMENT_BITS = 3
FRAGMENTS = 1 << FRAGMENT_BITS

_WEIGHTS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                     0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending within it, and the number per document."""
    w, doc = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    at = np.arange(len(w))
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    place = at - first[doc]
    left = count[doc] - place
    start = at[(left >= size) | (place == 0)]
    total = np.zeros(len(start), np.uint64)
    for k in range(size):
        ok = left[start] > k
        total[ok] += mix(w[start[ok] + k]) * _WEIGHTS[k % 5] + np.uint64(k + 1)
    h, doc = mix(total) & ~np.uint64(255), doc[start]  # 56 bits are enough, and pack better
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=n)


def _signatures(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash for each document's set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x2545F4914F6CDD1D)))))
    end = np.cumsum(count)
    return mix(sums[end] - sums[end - count]).view(np.int64)


def _sets(batch, text_at: int):
    data, offsets = arrow_text(batch.column(text_at))
    for lo, hi in row_slices(offsets):
        part = data[offsets[lo]:offsets[hi]]
        h, count = shingle_sets(part, offsets[lo:hi + 1] - offsets[lo])
        yield lo, hi, h, count


def _class_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for lo, hi, h, count in _sets(batch, 1):
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(count), pa.array(_signatures(h, count))],
                                  names=["doc_id", "n", "sig"])


def _range_rows(bits: int):
    """Map side: rows (range, hashes, node numbers, signatures, sizes, marked hashes)."""
    def deal(h, node, sig, size):
        import pyarrow as pa

        order = np.argsort(h)
        h, node = h[order], node[order]
        cut = runs(h)
        length = np.diff(cut)
        hot = np.repeat(length >= HOT, length)
        marks = h[cut[:-1]][length >= HOT]
        rows = []

        def put(key, hh, nn, mm):
            used, short = np.unique(nn, return_inverse=True)
            rows.append((int(key), planes(hh), planes(short.astype(np.uint32)), planes(sig[used]), planes(size[used]),
                         planes(mm)))

        def by_range(x):
            return (x >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)

        for part in range(0, int(hot.sum()), RANGE // 8):  # hot ones: dealt out by task, they meet by class later
            pick = np.flatnonzero(hot)[part:part + RANGE // 8]
            put((1 << bits) + int(mix(sig[node[pick[:1]]].view(np.uint64) + np.uint64(part))[0] % np.uint64(1 << bits)),
                h[pick], node[pick], marks[:0])
        cool_h, cool_node = h[~hot], node[~hot]
        key, mark_key = by_range(cool_h), by_range(marks)
        at = np.searchsorted(key, np.arange((1 << bits) + 1))
        mark_at = np.searchsorted(mark_key, np.arange((1 << bits) + 1))
        for k in np.union1d(key, mark_key):
            put(k, cool_h[at[k]:at[k + 1]], cool_node[at[k]:at[k + 1]], marks[mark_at[k]:mark_at[k + 1]])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)]],
            names=["range", "h", "node", "sig", "size", "mark"])

    def run(batches):
        held, n = [], 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            count = np.concatenate([x[1] for x in held])
            sig = np.concatenate([x[2] for x in held])
            doc = np.repeat(np.arange(len(count)), count)
            _, first, node = np.unique(np.stack((sig, count.astype(np.int64))), axis=1, return_index=True, return_inverse=True)
            node = node.ravel()
            lead = first[node] == np.arange(len(count))  # one document of each class of this task
            keep = lead[doc]
            return deal(h[keep], node[doc[keep]], sig[first], count[first].astype(np.int64))

        for batch in batches:
            for _, _, h, count in _sets(batch, 0):
                held.append((h, count, _signatures(h, count)))
                n += len(h)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
    return run


_SHARED = "bucket long, sig binary, n binary, h binary, df binary"


def _shared_rows(bits: int, buckets: int):
    """Reduce side: the shingles of a range that two classes or more hold, with their number of classes, by a hash
    of the class."""
    def run(key, rows):
        import pyarrow as pa

        hs, sigs, sizes, marks = [], [], [], []
        for i in range(rows.num_rows):
            node = unplanes(rows["node"][i].as_py(), np.uint32)
            hs.append(unplanes(rows["h"][i].as_py(), np.uint64))
            sigs.append(unplanes(rows["sig"][i].as_py(), np.int64)[node])
            sizes.append(unplanes(rows["size"][i].as_py(), np.int64)[node])
            marks.append(unplanes(rows["mark"][i].as_py(), np.uint64))
        h, sig, size, marks = map(np.concatenate, (hs, sigs, sizes, marks))
        del hs, sigs, sizes
        if key[0].as_py() >= 1 << bits:
            df = np.full(len(h), np.iinfo(np.int64).max)
        else:
            order = np.argsort(h)
            h, sig, size = h[order], sig[order], size[order]
            cut = runs(h)
            length = np.diff(cut)
            marked = np.isin(h[cut[:-1]], marks)
            several = np.repeat((length > 1) | marked, length)
            df = np.repeat(np.where(marked, np.iinfo(np.int64).max, length), length)[several]
            h, sig, size = h[several], sig[several], size[several]
        order = np.lexsort((h, size, sig))
        h, sig, size, df = h[order], sig[order], size[order], df[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]) | (size[1:] != size[:-1])
        h, sig, size, df = h[new], sig[new], size[new], df[new]
        if key[0].as_py() < 1 << bits and len(h):  # a class that several tasks sent counts once
            values, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            hot = df == np.iinfo(np.int64).max
            df = np.where(hot, df, count[inverse])
            # of use only where the next smaller or larger class with it is alike enough in size
            order = np.lexsort((size, h))
            near = (h[order][1:] == h[order][:-1]) & (100 * size[order][:-1] >= PERCENT * size[order][1:])
            keep = hot.copy()
            keep[order[1:][near]] = True
            keep[order[:-1][near]] = True
            h, sig, size, df = h[keep], sig[keep], size[keep], df[keep]
        part = (mix(sig.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = runs(part[order])
        rows = [(int(part[order[a]]), *(planes(x[order[a:b]]) for x in (sig, size, h, df))) for a, b in zip(cut[:-1], cut[1:])]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.binary())
                                                                        for k in range(1, 5)]],
                        names=["bucket", "sig", "n", "h", "df"])
    return run


def _ordered_sets(rows):
    """Each class's shared shingles in the global order; classes that cannot have a partner go.

    A shingle that is hot in one task of a class's copies and not in another comes twice, and counts once.
    """
    import pyarrow as pa

    sig, n, h, df = (np.concatenate([unplanes(x.as_py(), kind) for x in rows[c]])
                     for c, kind in (("sig", np.int64), ("n", np.int64), ("h", np.uint64), ("df", np.int64)))
    order = np.lexsort((h, df, n, sig))
    sig, n, h = sig[order], n[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
    sig, n, h = sig[new], n[new], h[new]
    first = np.ones(len(h), bool)
    first[1:] = (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
    start = np.flatnonzero(first)
    count = np.diff(np.append(start, len(h)))
    enough = 100 * count >= PERCENT * n[start]
    start, count = start[enough], count[enough]
    h = h[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    return pa.table({"sig": sig[start], "n": n[start],
                     "hs": pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))})


def _shared_sets(docs: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """(id, n, hs): classes that share enough shingles to have a partner, with these in the global order."""
    bits = max(0, int(np.ceil(np.log2(max(1, total / RANGE)))))
    ranges = docs.select("text").mapInArrow(
        _range_rows(bits), "range long, h binary, node binary, sig binary, size binary, mark binary")
    shared = ranges.groupBy("range").applyInArrow(_shared_rows(bits, 1 << bits), _SHARED)
    by_class = shared.groupBy("bucket").applyInArrow(_ordered_sets, "sig long, n long, hs array<long>")
    ids = classes.groupBy("sig", "n").agg(F.min("doc_id").alias("id"))
    return by_class.join(ids, ["sig", "n"]).select("id", "n", "hs")


def _least_overlap(n):
    return F.ceil(n * PERCENT / 100.0)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that link: partial overlaps of each fragment, summed per pair."""
    cut = sets.select("id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)), lambda f: F.struct(
        f.alias("f"), F.filter("hs", lambda h: F.shiftright(h, 64 - FRAGMENT_BITS) + FRAGMENTS // 2 == f).alias("hs")))
    ).alias("p")).select("id", "n", "p.f", "p.hs")
    left = cut.select(F.col("id").alias("a"), F.col("n").alias("na"), "f", F.col("hs").alias("ha"))
    right = cut.select(F.col("id").alias("b"), F.col("n").alias("nb"), "f", F.col("hs").alias("hb"))
    part = pairs.join(left, "a").join(right, ["b", "f"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("part"))
    both = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o"))
    return both.where(100 * F.col("o") >= PERCENT * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _enough(shared, n, m):
    """Whether sets of n and m shingles can reach the similarity with an overlap of ``shared``."""
    return (100 + PERCENT) * shared >= PERCENT * (n + m)


def _alike(n, m, c, d):
    """Sizes, and shingles left from a first common one on, that can reach the similarity."""
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & _enough(F.least(c, d), n, m)


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig) of every document, and (id, root) of each class that links with another.

    ``id`` is the smallest doc_id of a class of equal sets, ``root`` the smallest one it reaches.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    classes = written(docs.mapInArrow(_class_rows, "doc_id long, n long, sig long"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    own = classes.where("n > 0 AND doc_id IS NOT NULL")
    sets = written(_shared_sets(docs, own, total), "shared")
    # c: what is left of the set from this shingle on.  Two sets can be no more alike than this allows at the first
    # shingle that both have, so only rows that allow enough there need to meet.
    prefix = sets.select("id", "n", F.size("hs").alias("c"), F.posexplode(F.slice(
        "hs", 1, (F.size("hs") - _least_overlap(F.col("n")) + 1).cast("int"))).alias("k", "h")).select(
        "id", "n", (F.col("c") - F.col("k")).alias("c"), "h")
    least = prefix.groupBy("h").agg(F.min("n").alias("m"))
    prefix = written(prefix.join(least, "h").where(_enough(F.col("c"), F.col("n"), F.greatest(
        "m", F.col("n") * PERCENT / 100))).drop("m"), "prefix")
    labels, edges = None, None
    for last in (False, True):  # first with leaders only, then all pairs that are left between groups
        at = prefix.withColumn("root", F.col("id")) if labels is None else prefix.join(
            labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
        stat = at.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(
            F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("s"))
        mixed = stat.where("c * c > s")
        at = written(at.join(mixed.select("h"), "h"), "mixed")
        if last:
            other = at.select("h", F.col("id").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"),
                              F.col("root").alias("other"))
            pairs = at.withColumnRenamed("id", "a").join(other, "h").where(
                (F.col("root") < F.col("other")) & _alike(*map(F.col, "nmcd"))).select("a", "b").distinct()
        else:  # a shingle's leader has the least of its own: near copies are near to it
            lead = at.groupBy("h").agg(F.min(F.struct(
                (1 - F.col("c") / F.col("n")).alias("far"), "id", "n", "c", "root")).alias("l"))
            pairs = at.join(lead, "h").where((F.col("root") != F.col("l.root")) & _alike(F.col("n"), F.col("l.n"), F.col("c"), F.col("l.c"))).select(
                F.col("id").alias("a"), F.col("l.id").alias("b")).distinct()
        found = _verified(pairs, sets)
        edges = written(found if edges is None else edges.unionByName(found), "links")
        labels = components(edges, "labels")
    return classes, labels


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, and the inner signature ``sig``."""
    classes, labels = jaccard_links(docs, doc_id, text)
    ids = classes.where("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("id"))
    roots = ids.join(labels, "id", "left").select("sig", "n", F.coalesce("root", "id").alias("root"))
    return classes.join(roots, ["sig", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("root", "doc_id")).alias("component_id"), "sig")


def op10(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("sig")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the document with the smallest doc_id stays.

    A row without an id stays only where no row of its group has one.  Rows that share an id are told apart by their
    texts, of which the one with the smallest hash stays; of identical rows one stays.  Rows without words all stay.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    rows = docs.where(worded)
    own = rows.select(key.alias("key"), F.col("doc_id").alias("id"), "text")
    # groups of texts, whatever the ids of their rows
    found = jaccard_components(own.select("key", "text"), "key")
    groups = found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("root"))
    ids = own.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    first = ids.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("f"))
    lead = written(first.join(groups, "key").groupBy("root").agg(
        F.min(F.struct("f.none", "f.id", "key", "f.n")).alias("l")).select("l.id", "l.key", "l.n"), "leaders")
    # names that no column of the documents has
    as_id, as_key = unused("id", docs.columns), unused("key", docs.columns)
    kept = rows.join(lead.select(F.col("id").alias(as_id), F.col("key").alias(as_key)),
                     (key == F.col(as_key)) & F.col("doc_id").eqNullSafe(F.col(as_id)), "left_semi")
    if lead.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(~worded))


ORACLE = """WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
