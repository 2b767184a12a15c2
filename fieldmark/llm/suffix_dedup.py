"""Exact removal of repeated passages: every byte of a MATCH-byte string that also starts earlier goes.

Earlier means a smaller doc_id, or an earlier start in the same document; all strings are judged on the input.

1. Anchors.  In every window of MATCH bytes the smallest hash of its GRAM-byte grams (the leftmost on ties) is the
   window's anchor, so equal windows have equal anchors at the same place, and about one byte in forty is one.
2. Anchors are grouped by their gram, cut into ranges of the hash.  A gram that occurs once in the table rules out
   its windows.  Equal texts count as one here: the first of them is judged, later copies go whole.
3. What remains (repeated grams, with the bytes that their windows cover) is grouped by gram again.  Within a range of
   grams the starts are ordered by their first MATCH bytes (prefix doubling), ties by place in the table.  A start has
   an earlier match exactly if the entry before it has the same MATCH bytes.  Only this equality is computed: no array
   of longest previous factors is built, since a factor would matter only in whether it reaches MATCH.
   A gram that stands more often than one range should hold (a sample of the places tells) is no key: each of its
   windows is grouped by the hash of its MATCH bytes, and a task sends the first of equal ones only.
4. Starts with an earlier match are merged to byte spans and cut out of their documents.

Hot passages: what one task holds many times is resolved there (only its first occurrence is sent on, the later ones
are known to be repeated), so a group of n copies sends as many rows as there are tasks.  A passage whose edges stand in
other text in every document makes hot grams with surroundings that all differ; these are split by window (3).

Edge cases: a null text is empty and keeps the hash of no bytes; texts under MATCH bytes lose nothing; a null
doc_id comes before all others; rows that repeat a doc_id come in the order of their texts' hash, and of identical rows
one is the first; texts of any length are handled in overlapping parts; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import arrow_text, mix, piece_hashes, planes, prefix_hash, runs, span_hash, table, unplanes, written

MATCH, GRAM = 100, 24
#: Bytes of text that are scanned together.
PART = 1 << 19
#: Anchors, or bytes around anchors, that a task gathers before it deals them out.
FLUSH, FLUSH_BYTES = 250_000, 4 << 20
#: Anchors of about one range, and bytes around repeated anchors of one range.
RANGE, RANGE_BYTES = 300_000, 2 << 20
#: Bytes of whole grams that one suffix array covers.
SUFFIX_BYTES = 1 << 19
#: About the bytes of the windows of one place of a hot gram (hash, document, hash of the text, start of each).
WINDOWS_BYTES = 1280
#: One place in so many, at most, is looked at to find hot grams.
LOOK = 64
#: Occurrences in one task from which on a gram counts as hot there.
HOT = 16


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:len(x) - width + 1], out[width - have:]) if width > have else out


def _parts(offsets: np.ndarray, match: int):
    """Lists of (row, start, end) whose bytes are scanned together; a long text in parts that overlap by match - 1."""
    held, size = [], 0
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        if b - a < match:
            continue
        for s in range(a, b - match + 1, PART):
            e = min(b, s + PART + match - 1)
            held.append((row, s, e))
            size += e - s
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchors(data: np.ndarray, offsets: np.ndarray, match: int = MATCH, gram: int = GRAM):
    """Per part: arrays (gram hash, row, place in the row, first and last window start that it anchors)."""
    for held in _parts(offsets, match):
        row, start, end = (np.array(c, np.int64) for c in zip(*held))
        size = end - start
        base = np.concatenate(([0], np.cumsum(size)))
        text = np.concatenate([data[s:e] for s, e in zip(start, end)])
        at = np.arange(len(text) - gram + 1)
        h = span_hash(prefix_hash(text), at, at + gram)
        bits = np.uint64(int(len(text)).bit_length())
        pick = sliding_min(((h >> bits) << bits) | at.astype(np.uint64), match - gram + 1)
        pick = (pick & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        part = np.repeat(np.arange(len(held)), size)[:len(pick)]
        inside = np.arange(len(pick)) + match <= base[part + 1]
        window = np.flatnonzero(inside)
        pick, part = pick[window], part[window]
        new = np.ones(len(pick), bool)
        new[1:] = (pick[1:] != pick[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pick)) - 1
        shift = start[part[first]] - base[part[first]] - offsets[row[part[first]]]
        yield h[pick[first]], row[part[first]], pick[first] + shift, window[first] + shift, window[last] + shift


def _range_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _batch(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if v and isinstance(v[0], bytes) else pa.int64())
                                       for v in columns.values()], names=list(columns))


_GRAMS = "range long, h binary, doc binary, docs binary, hashes binary, at binary, mark binary"


def _anchor_rows(bits: int, match: int, gram: int, batches):
    """Anchors of each task by range of the gram's hash: (hash, text, place), and marks for hot grams."""
    def flush(held):
        h, doc, th, at = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(h)
        h, doc, th, at = h[order], doc[order], th[order], at[order]
        cut = runs(h)
        length = np.diff(cut)
        hot = np.repeat(length >= HOT, length)
        marks = h[cut[:-1]][length >= HOT]
        out = {k: [] for k in ("range", "h", "doc", "docs", "hashes", "at", "mark")}

        def put(key, pick, mark):
            pair, short = np.unique(np.stack((doc[pick], th[pick])), axis=1, return_inverse=True)
            for k, v in zip(out, (int(key), planes(h[pick]), planes(short.ravel().astype(np.uint32)), planes(pair[0].copy()),
                                  planes(pair[1].copy()), planes(at[pick]), planes(mark))):
                out[k].append(v)

        warm = np.flatnonzero(hot)
        for lo in range(0, len(warm), RANGE):
            put((1 << bits) + int(mix(h[warm[lo:lo + 1]])[0] % np.uint64(1 << bits)), warm[lo:lo + RANGE], marks[:0])
        cool = np.flatnonzero(~hot)
        key, mark_key = _range_of(h[cool], bits), _range_of(marks, bits)
        edge = np.arange((1 << bits) + 1)
        a, b = np.searchsorted(key, edge), np.searchsorted(mark_key, edge)
        for k in np.union1d(key, mark_key):
            put(k, cool[a[k]:a[k + 1]], marks[b[k]:b[k + 1]])
        return _batch(out)

    held, n = [], 0
    for batch in batches:
        doc_id, text_hash = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = arrow_text(batch.column(2))
        for h, row, at, _, _ in anchors(data, offsets, match, gram):
            held.append((h, doc_id[row], text_hash[row], at))
            n += len(h)
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
    if n:
        yield flush(held)


def _repeated_rows(bits: int, key, rows):
    """Anchors of a range whose gram occurs twice or more, by document: (doc, th, places)."""
    import pyarrow as pa

    cols = {k: [] for k in ("h", "doc", "th", "at", "mark")}
    for i in range(rows.num_rows):
        short = unplanes(rows["doc"][i].as_py(), np.uint32)
        cols["h"].append(unplanes(rows["h"][i].as_py(), np.uint64))
        cols["doc"].append(unplanes(rows["docs"][i].as_py(), np.int64)[short])
        cols["th"].append(unplanes(rows["hashes"][i].as_py(), np.int64)[short])
        cols["at"].append(unplanes(rows["at"][i].as_py(), np.int64))
        cols["mark"].append(unplanes(rows["mark"][i].as_py(), np.uint64))
    h, doc, th, at, marks = (np.concatenate(v) for v in cols.values())
    if key[0].as_py() < 1 << bits:
        order = np.lexsort((doc, at, th, h))
        h, doc, th, at = h[order], doc[order], th[order], at[order]
        new = np.ones(len(h), bool)  # of equal texts the first counts
        new[1:] = (h[1:] != h[:-1]) | (th[1:] != th[:-1]) | (at[1:] != at[:-1])
        h, doc, th, at = h[new], doc[new], th[new], at[new]
        cut = runs(h)
        length = np.diff(cut)
        keep = np.repeat((length > 1) | np.isin(h[cut[:-1]], marks), length)
        doc, th, at = doc[keep], th[keep], at[keep]
    order = np.lexsort((at, th, doc))
    doc, th, at = doc[order], th[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    start = np.flatnonzero(new)
    ends = pa.array(np.append(start, len(doc)).astype(np.int32))
    return pa.table({"doc": doc[start], "th": th[start], "at": pa.ListArray.from_arrays(ends, pa.array(at))})


def _looked_rows(one_in: int, gram: int, batches):
    """The gram's hash at one in ``one_in`` of the places of repeated anchors."""
    import pyarrow as pa

    for batch in batches:
        marked = batch.column(3)
        data, offsets = arrow_text(batch.column(2))
        places, cut = marked.values.to_numpy(), marked.offsets.to_numpy()
        row, places = np.repeat(np.arange(len(cut) - 1), np.diff(cut)), places[cut[0]:cut[-1]]
        salt = batch.column(0).to_numpy() ^ batch.column(1).to_numpy()
        pick = mix((salt[row] + places).view(np.uint64)) % np.uint64(one_in) == 0
        at = offsets[row[pick]] + places[pick]
        for lo in range(0, len(at), 1 << 15):
            body = data[at[lo:lo + (1 << 15), None] + np.arange(gram)].ravel()
            yield pa.record_batch([pa.array(piece_hashes(body, np.full(len(body) // gram, gram)).view(np.int64))], names=["h"])


def _hot_grams(near: DataFrame, match: int, gram: int) -> tuple[np.ndarray, int]:
    """Hashes of the grams whose surroundings are too many for one range, ascending, and about how many these are.

    The sample decides only how windows are grouped, for all places of a gram alike; the result does not depend on it.
    """
    most = max(2, int(RANGE_BYTES / (1.4 * match)))
    one_in = max(1, min(LOOK, most // 200))
    count = near.mapInArrow(partial(_looked_rows, one_in, gram), "h long").groupBy("h").count()
    rows = count.where(F.col("count") > most // one_in).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64)), one_in * sum(r[1] for r in rows)


_AROUND = "range long, h binary, doc binary, th binary, start binary, size binary, text binary, known binary"


def _windows(text: np.ndarray, size: np.ndarray, match: int):
    """Per part of the pieces in ``text``: arrays (hash of a window, number of its piece, start in the piece)."""
    ends, k = np.cumsum(size), 0
    while k < len(size):
        begin = int(ends[k] - size[k])
        last = max(k + 1, int(np.searchsorted(ends, begin + PART, "right")))
        count = size[k:last] - match + 1
        own = np.repeat(np.arange(k, last), count)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = ends[own] - size[own] - begin + step
        yield span_hash(prefix_hash(text[begin:int(ends[last - 1])]), at, at + match), own, step
        k = last


def _around_rows(bits: int, match: int, gram: int, hot: np.ndarray, hot_bits: int, batches):
    """The bytes that the windows of repeated anchors cover, by range of the gram's hash.

    Of equal ones in a task only the first is sent on; ``known`` marks the others, whose windows all repeat it.  Around
    hot grams it is the windows that go on, without their bytes, by range of their own hash.
    """
    def flush(held):
        h, doc, th, start, size = (np.concatenate([x[k] for x in held]) for k in range(5))
        text = np.concatenate([x[5] for x in held])
        base = np.cumsum(size) - size
        same = piece_hashes(text, size) ^ mix(h)
        order = np.lexsort((start, th, doc, same))
        new = np.ones(len(order), bool)
        new[1:] = same[order][1:] != same[order][:-1]
        out = {k: [] for k in ("range", "h", "doc", "th", "start", "size", "text", "known")}

        def put(key, pick, known):
            body = b"" if known is not False else b"".join(raw[b:b + s] for b, s in zip(base[pick].tolist(), size[pick].tolist()))
            for k, v in zip(out, (int(key), planes(h[pick]), planes(doc[pick]), planes(th[pick]), planes(start[pick]),
                                  planes(size[pick]), body, b"1" if known else b"")):
                out[k].append(v)

        raw, later, first = text.tobytes(), order[~new], order[new]

        def put_known(pick):
            for lo in range(0, len(pick), RANGE):
                put((1 << bits) + int(mix(h[pick[lo:lo + 1]])[0] % np.uint64(1 << bits)), pick[lo:lo + RANGE], True)

        put_known(later)
        split = np.isin(h[first], hot)
        if split.any():
            mine, first = np.sort(first[split]), first[~split]
            body = text[np.repeat(base[mine] - (np.cumsum(size[mine]) - size[mine]), size[mine]) + np.arange(int(size[mine].sum()))]
            cool = h, doc, th, start, size
            h, own, step = (np.concatenate(c) for c in zip(*_windows(body, size[mine], match)))
            doc, th, start, size = doc[mine][own], th[mine][own], start[mine][own] + step, np.full(len(own), match)
            order = np.lexsort((start, th, doc, h))
            new = np.ones(len(order), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            lead, again = order[new], np.sort(order[~new])
            if len(again):  # neighbouring ones of one piece make one span
                far = np.ones(len(again), bool)
                far[1:] = (again[1:] != again[:-1] + 1) | (own[again[1:]] != own[again[:-1]])
                ends = again[np.append(np.flatnonzero(far)[1:], len(again)) - 1]
                again = again[far]
                size[again] += start[ends] - start[again]
                put_known(again)
            key = _range_of(h[lead], hot_bits)  # ascending: the hash came first in the order
            edge = np.searchsorted(key, np.arange((1 << hot_bits) + 1))
            for k in np.unique(key):
                put((2 << bits) + k, lead[edge[k]:edge[k + 1]], None)
            h, doc, th, start, size = cool
        first = first[np.argsort(h[first], kind="stable")]
        key = _range_of(h[first], bits)
        edge = np.searchsorted(key, np.arange((1 << bits) + 1))
        for k in np.unique(key):
            put(k, first[edge[k]:edge[k + 1]], False)
        return _batch(out)

    held, n = [], 0
    for batch in batches:
        doc_id, text_hash, marked = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        data, offsets = arrow_text(batch.column(2))
        places, cut = marked.values.to_numpy(), marked.offsets.to_numpy()
        keys = np.sort((np.repeat(np.arange(len(cut) - 1), np.diff(cut)) << 40) | places[cut[0]:cut[-1]])
        for h, row, at, first, last in anchors(data, offsets, match, gram):
            mine = (row << 40) | at
            ok = keys[np.minimum(np.searchsorted(keys, mine), len(keys) - 1)] == mine if len(keys) else np.zeros(len(mine), bool)
            h, row, first, last = h[ok], row[ok], first[ok], last[ok]
            if not len(h):
                continue
            size = last + match - first
            begin = offsets[row] + first
            body = data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            held.append((h, doc_id[row], text_hash[row], first, size, body))
            n += len(body)
            if n >= FLUSH_BYTES:
                yield flush(held)
                held, n = [], 0
    if held:
        yield flush(held)


def suffix_runs(text: np.ndarray, starts: np.ndarray, place: np.ndarray, match: int) -> np.ndarray:
    """For each start, whether its ``match`` bytes have an earlier occurrence (a smaller ``place``) among the starts.

    A suffix array of the text by prefix doubling, cut at ``match`` bytes; no factor lengths are computed.
    """
    padded = np.concatenate((text, np.zeros(match + 8, np.uint8)))
    n = len(text)
    words = np.zeros(n + match, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k:k + n + match]
    need, have = starts, 8
    rank = np.unique(words, return_inverse=True)[1].astype(np.uint64)  # order of the first 8 bytes, at every place
    while have * 2 < match:
        pair = (rank[:-have] << np.uint64(32)) | rank[have:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        have *= 2
    pair = (rank[need] << np.uint64(32)) | rank[need + (match - have)]
    order = np.lexsort((place, pair))
    pair = pair[order]
    out = np.zeros(len(starts), bool)
    out[order[1:]] = pair[1:] == pair[:-1]  # the previous entry: the same bytes, at the previous smaller place
    return out


def _span_rows(bits: int, match: int, key, rows):
    """Byte spans (start, end) by document that the starts of a range with an earlier match cover."""
    import pyarrow as pa

    cols = {k: [] for k in ("h", "doc", "th", "start", "size")}
    for i in range(rows.num_rows):
        for k, kind in zip(cols, (np.uint64, np.int64, np.int64, np.int64, np.int64)):
            cols[k].append(unplanes(rows[k][i].as_py(), kind))
    h, doc, th, start, size = (np.concatenate(v) for v in cols.values())
    if key[0].as_py() >= 2 << bits:  # windows of hot grams: all but the first of equal ones
        order = np.lexsort((start, th, doc, h))
        again = order[1:][h[order][1:] == h[order][:-1]]
        spans = (doc[again], th[again], start[again], start[again] + match)
    elif key[0].as_py() >= 1 << bits:
        spans = (doc, th, start, start + size)
    else:
        text = np.frombuffer(b"".join(rows["text"][i].as_py() for i in range(rows.num_rows)), np.uint8)
        base = np.cumsum(size) - size
        same = piece_hashes(text, size) ^ mix(h)
        order = np.lexsort((start, th, doc, same))
        first = np.ones(len(order), bool)
        first[1:] = same[order][1:] != same[order][:-1]
        later, lead = order[~first], order[first]  # equal bytes around equal grams: all windows of the later ones repeat
        lead = lead[np.argsort(h[lead], kind="stable")]
        cut = runs(h[lead])
        lead = lead[np.repeat(np.diff(cut) > 1, np.diff(cut))]
        found = [np.stack((doc[later], th[later], start[later], start[later] + size[later]))]
        cut = runs(h[lead])
        edge = np.searchsorted(np.cumsum(size[lead])[cut[1:] - 1] if len(lead) else [], np.arange(0, int(size[lead].sum()), SUFFIX_BYTES))
        groups = np.unique(np.concatenate((cut[edge], [0, len(lead)]))) if len(lead) else [0]
        for a, b in zip(groups[:-1], groups[1:]):  # whole grams, of bounded bytes together
            mine = lead[a:b]
            mine = mine[np.lexsort((start[mine], th[mine], doc[mine]))]
            count = size[mine] - match + 1
            own = np.repeat(np.arange(len(mine)), count)
            step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            new_base = np.cumsum(size[mine]) - size[mine]
            body = text[np.repeat(base[mine] - new_base, size[mine]) + np.arange(int(size[mine].sum()))]
            place = start[mine][own] + step
            order = np.lexsort((place, th[mine][own], doc[mine][own]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            hit = np.flatnonzero(suffix_runs(body, new_base[own] + step, rank, match))
            if len(hit):  # neighbouring starts of one anchor make one span
                new = np.ones(len(hit), bool)
                new[1:] = (hit[1:] != hit[:-1] + 1) | (own[hit[1:]] != own[hit[:-1]])
                s, e = hit[new], hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
                found.append(np.stack((doc[mine][own[s]], th[mine][own[s]], place[s], place[e] + match)))
        spans = tuple(np.concatenate(found, axis=1))
    doc, th, start, end = spans
    order = np.lexsort((start, th, doc))
    doc, th, start, end = doc[order], th[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    at = np.flatnonzero(new)
    ends = pa.array(np.append(at, len(doc)).astype(np.int32))
    return pa.table({"doc": doc[at], "th": th[at], "starts": pa.ListArray.from_arrays(ends, pa.array(start)),
                     "ends": pa.ListArray.from_arrays(ends, pa.array(end))})


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as maximal ones."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:], len(start)) - 1]


def _cut_rows(with_text: bool, batches):
    """(doc, th, n_removed, n_spans, kept_sha256[, kept]) of documents that lose spans."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            raw = (batch.column(2)[k].as_py() or "").encode()
            s, e = merged(batch.column(3)[k].values.to_numpy(), batch.column(4)[k].values.to_numpy())
            kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)]))
            out.append((int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        removed, spans, sums, kept = zip(*out) if out else ((), (), (), ())
        columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string())]
        names = ["doc", "th", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


_NULL_ID = -(1 << 63)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", match: int = MATCH, gram: int = GRAM,
                   with_kept: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_kept`` the bytes that stay."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("doc"), t.alias("text"))
    keyed = docs.select("doc", F.xxhash64("text").alias("th"), "text")
    # every row: size, and its rank among rows of the same text, of which the first is judged
    sizes = written(keyed.select("doc", "th", F.octet_length("text").cast("long").alias("n_bytes"),
                                 F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "sizes")
    # per text the first document, and how often that row stands in the table
    lead = sizes.groupBy("th", "n_bytes", "sha").agg(F.min("doc").alias("first"))
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, int(total / 40 / RANGE).bit_length())
    grams = keyed.mapInArrow(partial(_anchor_rows, bits, match, gram), _GRAMS)
    repeated = grams.groupBy("range").applyInArrow(partial(_repeated_rows, bits), "doc long, th long, at array<long>")
    repeated = repeated.groupBy("doc", "th").agg(F.flatten(F.collect_list("at")).alias("at"))
    if sizes.groupBy("doc", "th").count().where("count > 1").limit(1).count():  # rows that stand in the table twice
        keyed = keyed.dropDuplicates(["doc", "th"])
    near = written(keyed.join(repeated, ["doc", "th"]).select("doc", "th", "text", "at"), "near")
    found = near.agg(F.sum(F.size("at"))).first()[0] or 0
    around_bits = max(0, int(found * 1.4 * match / RANGE_BYTES).bit_length())
    hot, places = _hot_grams(near, match, gram)
    hot_bits = int(places * WINDOWS_BYTES / (4 * RANGE_BYTES)).bit_length()
    around = near.mapInArrow(partial(_around_rows, around_bits, match, gram, hot, hot_bits), _AROUND)
    spans = around.groupBy("range").applyInArrow(partial(_span_rows, around_bits, match),
                                                 "doc long, th long, starts array<long>, ends array<long>")
    spans = spans.groupBy("doc", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"),
                                           F.flatten(F.collect_list("ends")).alias("ends"))
    kept_kind = ", kept binary" if with_kept else ""
    cut = near.select("doc", "th", "text").join(spans, ["doc", "th"]).mapInArrow(
        partial(_cut_rows, with_kept), "doc long, th long, n_removed long, n_spans long, kept_sha256 string" + kept_kind)
    cut = written(cut, "cut")
    rows = sizes.join(lead.select("th", "n_bytes", "sha", "first"), ["th", "n_bytes", "sha"])
    same = Window.partitionBy("doc", "th").orderBy("n_bytes")
    rows = rows.withColumn("again", (F.col("doc") > F.col("first")) | (F.row_number().over(same) > 1))
    out = rows.join(cut, ["doc", "th"], "left")
    gone = F.col("again") & (F.col("n_bytes") >= match)
    empty = hashlib.sha256(b"").hexdigest()
    out = out.select(
        F.when(F.col("doc") != _NULL_ID, F.col("doc")).alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), "th"] if with_kept else []))
    return out


def op2(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
