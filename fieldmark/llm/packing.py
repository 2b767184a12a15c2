"""Packing of tokenised documents into fixed-length sequences by vector bin packing.

Every document becomes ids (byte-level BPE) and a closing id.  A document of instruction data may begin with tokens
that bear no loss (its prompt, counted in a column); of the others all bear loss but the first of a piece, which
nothing predicts.  Pieces as long as a sequence, or with as much loss as one may hold, are cut off from the front; what
does not fill a sequence is an item with three sizes: tokens, segments (1) and loss-bearing tokens.  Items are dealt
into groups of about GROUP_ROWS by a hash; each group fills sequence after sequence with the item whose normalised
sizes have the largest dot product with what is left of the sequence's capacities.  When nothing fits, or one segment
is left, an item is cut to fill the sequence as far as all limits let it.  So only the last sequence of a group is
padded, or one that the limits on segments or loss close early.

Token ids: text is cut before single spaces between two other characters, where the vocabulary's own
pre-tokenisation always starts a token; each distinct chunk is encoded once per slice of text.  A text that holds
a special token's string goes whole through ``tokenizers``, which knows it.

Edge cases: a null or empty text is the closing id alone; a null or negative prompt is none, one longer than the
document leaves it without loss; very long texts are handled slice by slice; repeated rows
are packed each for itself; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import zlib
from functools import partial
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import arrow_text, prefix_hash, row_slices, span_hash, table

LENGTH = 2048
#: Segments a sequence may hold.
MAX_SEGMENTS = 32
#: Loss-bearing tokens a sequence may hold.
MAX_LOSS = 2047
#: Items of one group, packed in one task.
GROUP_ROWS = 10_000
#: Chunks whose ids a task remembers, at most; beyond, those not used in the longest time go, half of them at once.
CACHE = 400_000
SPECIAL = b"<|endoftext|>"


class Encoder:
    """Ids of whole texts from the vocabulary's files; made once per task."""

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.json_path, self.whole = json_path, None
        # known chunks: their hashes in order, where their ids start in ``flat``, how many, and when last used
        self.keys, self.at, self.size, self.used = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
        self.flat, self.now = np.empty(0, np.uint32), 0

    def with_special(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer
            self.whole = Tokenizer.from_file(self.json_path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number per text."""
        n = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        start = chunk_starts(data, offsets)
        end = np.append(start[1:], len(data))
        keys = span_hash(prefix_hash(data), start, end)
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = self._known(keys, start[first], end[first], data)
        size, begin = self.size[at], self.at[at]
        count = size[inverse]
        out = self.flat[np.repeat(begin[inverse] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        doc = np.searchsorted(offsets, start, "right") - 1
        return out, np.bincount(doc, weights=count, minlength=n).astype(np.int64)

    def _known(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Places of the chunks ``keys`` (in order) among the known ones, new ones encoded first."""
        self.now += 1
        if len(self.keys) and len(self.keys) + len(keys) > CACHE:
            self._forget(CACHE // 2)
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw, encode = data.tobytes(), self.encode
            ids = [encode(raw[s:e].decode()) for s, e in zip(start[new].tolist(), end[new].tolist())]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(size.sum())
            place = np.searchsorted(self.keys, keys[new])
            self.at = np.insert(self.at, place, len(self.flat) + np.cumsum(size) - size)
            self.size, self.keys = np.insert(self.size, place, size), np.insert(self.keys, place, keys[new])
            self.used = np.insert(self.used, place, self.now)
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, total)))
            at = np.searchsorted(self.keys, keys)
        self.used[at] = self.now
        return at

    def _forget(self, keep: int) -> None:
        """Only the ``keep`` chunks used last stay."""
        stay = np.sort(np.argsort(-self.used, kind="stable")[:keep])
        size, begin = self.size[stay], self.at[stay]
        self.flat = self.flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self.keys, self.used, self.size, self.at = self.keys[stay], self.used[stay], size, np.cumsum(size) - size


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where every text may be cut without changing its ids: single spaces between two other characters.

    A character next to the space that may be white space beyond ASCII leaves the text uncut there.
    """
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    lead2 = data[np.maximum(at - 2, 0)]
    lead3 = data[np.maximum(at - 3, 0)]
    wide = lambda x: (x == 0xC2) | (x == 0xE1) | (x == 0xE2) | (x == 0xE3)
    ok = (before > 32) & (after > 32) & ~wide(after) & ~((before >= 0x80) & (wide(lead2) | wide(lead3)))
    return np.union1d(at[ok], offsets[:-1][np.diff(offsets) > 0])


def cuts(total: int, prompt: int, length: int, max_loss: int):
    """(start, end, lead) of the pieces of a document; the first ``lead`` tokens of a piece, at least one, bear no loss."""
    start = 0
    while start < total:
        lead = max(1, prompt - start)
        end = min(start + length, start + lead + max_loss, total)
        yield start, end, min(lead, end - start)
        start = end


def _pieces(length: int, max_loss: int, end_id: int, json_path: str, ranks_path: str, batches):
    """(doc_id, start, length, crc, doc_tokens, lead, ids): full sequences without their ids, and items with them."""
    import pyarrow as pa

    encoder = Encoder(json_path, ranks_path)
    for batch in batches:
        data, offsets = arrow_text(batch.column(1))
        for lo, hi in row_slices(offsets):
            part, own = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            ids, count = encoder.texts(part, own)
            ids_at = np.concatenate(([0], np.cumsum(count)))
            raw, rows, prompts = part.tobytes(), [], batch.column(2).slice(lo, hi - lo).to_pylist()
            special = SPECIAL in raw
            # every text's ids, and room for its closing id
            closed = np.insert(ids, ids_at[1:], np.uint32(end_id))
            for k in range(hi - lo):
                if special and SPECIAL in raw[own[k]:own[k + 1]]:
                    mine = np.array(encoder.with_special(raw[own[k]:own[k + 1]].decode()) + [end_id], np.uint32)
                else:
                    mine = closed[ids_at[k] + k:ids_at[k + 1] + k + 1]
                for a, b, lead in cuts(len(mine), prompts[k], length, max_loss):
                    own_ids = mine[a:b]
                    rows.append((k, a, b - a, zlib.crc32(own_ids), len(mine), lead,
                                 own_ids.tobytes() if b - a < length else None))
            k, start, size, crc, total, lead, rest = zip(*rows)
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo).take(pa.array(k)), pa.array(start, pa.int64()),
                                   pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()),
                                   pa.array(lead, pa.int64()), pa.array(rest, pa.binary())],
                                  names=["doc_id", "start", "length", "crc", "doc_tokens", "lead", "ids"])


def fill_sequences(sizes: np.ndarray, limits: tuple[int, int, int], lead: np.ndarray | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, from, to), for items of ``sizes`` tokens (each below the limit).

    The first ``lead`` tokens of an item (at least one, the default) bear no loss.  Items of one size and lead have the
    same vector, so the heuristic picks such a kind and takes any item of it.
    """
    tokens, segments, loss = limits
    lead = np.ones(len(sizes), np.int64) if lead is None else lead
    held: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for item in np.lexsort((lead, -sizes)).tolist():
        held.setdefault((int(sizes[item]), int(lead[item])), []).append((item, 0))
    # kinds in order of size; those that arise from cuts follow
    kinds = sorted(held)
    number = {kind: k for k, kind in enumerate(kinds)}
    spare = 2 * len(kinds) + 64
    size, free, have = np.zeros(spare, np.int64), np.zeros(spare, np.int64), np.zeros(spare, bool)
    size[:len(kinds)], free[:len(kinds)] = np.array(kinds).reshape(-1, 2).T
    have[:len(kinds)] = True
    out = []

    def put(kind, part):
        nonlocal size, free, have
        k = number.setdefault(kind, len(number))
        if k == len(size):
            size, free, have = (np.concatenate((x, np.zeros_like(x))) for x in (size, free, have))
        size[k], free[k], have[k] = *kind, True
        held.setdefault(kind, []).append(part)

    def take(k):
        kind = int(size[k]), int(free[k])
        got = held[kind].pop()
        if not held[kind]:
            del held[kind]
            have[k] = False
        return (*got, *kind)

    while held:
        left, mine = [tokens, segments, loss], []
        while left[0] and left[1] and held:
            at = np.flatnonzero(have)
            t, f = size[at], free[at]
            fits = (t <= left[0]) & (t - f <= left[2])
            if left[1] == 1:  # the last segment: only what fills the sequence, else a cut
                fits &= t == left[0]
            if fits.any():
                t, f = t[fits], f[fits]
                worth = (t / tokens) * (left[0] / tokens) + left[1] / segments ** 2 + ((t - f) / loss) * (left[2] / loss)
                item, begin, pick, bare = take(int(at[fits][np.argmax(worth)]))
            else:  # cut the item that fills most of what is left, the smallest of such
                room = np.minimum(np.minimum(t, left[0]), f + left[2])
                if not left[2] and room.max() < left[0]:
                    break  # no loss is left, and single tokens of many items would only fill segments
                best = np.flatnonzero(room == room.max())
                k = int(best[np.argmin(t[best])])
                pick = int(room[k])
                item, begin, whole, bare = take(int(at[k]))
                if whole > pick:
                    put((whole - pick, min(whole - pick, max(1, bare - pick))), (item, begin + pick))
            mine.append((item, begin, begin + pick))
            left = [left[0] - pick, left[1] - 1, left[2] - max(0, pick - bare)]
        out.append(mine)
    return out


def _packed(length: int, limits: tuple[int, int, int], key, rows):
    import pyarrow as pa

    rows = rows.combine_chunks()
    group, doc = key[0].as_py(), rows["doc_id"]
    start, size, crc, total, lead = (rows[c].to_numpy() for c in ("start", "length", "crc", "doc_tokens", "lead"))
    order = np.lexsort((crc, lead, start, total, doc.fill_null(-1).to_numpy()))  # the same result from any order of arrival
    full = order[size[order] == length]
    items = order[size[order] < length]
    row, begin, span, sums, seq, offset = [full], [start[full]], [size[full]], [crc[full]], [np.arange(len(full))], [np.zeros(len(full), np.int64)]
    ids = [np.frombuffer(rows["ids"][int(i)].as_py(), np.uint32) for i in items]
    cut = [(int(items[i]), int(start[items[i]]) + a, b - a, zlib.crc32(ids[i][a:b]), len(full) + s, o)
           for s, mine in enumerate(fill_sequences(size[items], limits, lead[items]))
           for (i, a, b), o in zip(mine, np.cumsum([0] + [b - a for _, a, b in mine]).tolist())]
    if cut:
        for held, values in zip((row, begin, span, sums, seq, offset), zip(*cut)):
            held.append(np.array(values, np.int64))
    row, begin, span, sums, seq, offset = map(np.concatenate, (row, begin, span, sums, seq, offset))
    # the tokens without loss, counted from the document's start, are lead[row] from the uncut piece's start
    bare = np.maximum(start[row] + lead[row] - begin, 1)
    return pa.table({"doc_id": doc.take(pa.array(row)), "start": begin, "length": span, "ids_crc32": sums,
                     "doc_tokens": total[row], "sequence_id": seq.astype(np.int64) + (group << 32), "offset": offset,
                     "loss_tokens": np.maximum(span - bare, 0)})


def pack(docs: DataFrame, length: int = LENGTH, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS,
         end_id: int = 1, json_path: str | None = None, ranks_path: str | None = None,
         prompt: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``prompt`` names a column with the number of tokens at a document's start that bear no loss (by default none).
    ``max_loss`` (at least 1) below ``length`` - 1 may leave padding.  The files' paths must hold on every executor.
    """
    if max_loss < 1:
        raise ValueError("max_loss must be at least 1")
    import public_tokenizers

    paths = (json_path or public_tokenizers.path("byte_bpe_50k.json"),
             ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bare = F.lit(0) if prompt is None else F.greatest(F.coalesce(F.col(prompt), F.lit(0)), F.lit(0))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       bare.cast("long").alias("prompt"))
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    pieces = docs.mapInArrow(partial(_pieces, length, max_loss, end_id, *map(str, paths)),
                             "doc_id long, start long, length long, crc long, doc_tokens long, lead long, ids binary")
    key = F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(groups)).alias("group")
    return pieces.groupBy(key).applyInArrow(
        partial(_packed, length, (length, max_segments, max_loss)),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "loss_tokens long")


def op6(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): the pieces of the packed sequences."""
    return pack(docs)
