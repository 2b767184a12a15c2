"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH, exact verification.

Texts are compared as their words, A-Z lower-cased, with single spaces between.  An item is found in a document if a
part of it lies within ``max_edits`` (a share of the item's characters) of the whole item.

The CGK walk reads a text with a random step function: at step t it writes the character it stands on, and moves on
by a random bit that depends on t and the character.  Texts at a small edit distance then agree at most steps, so a
sample of steps is a locality-sensitive key.  A walk reads about a character every two steps.  Each document is walked
from every word start and every character of a word of LONG_WORD bytes, each item too, up to the last start whose walk
stays in the item; equal keys say which part of the document the item would cover, and a bit-parallel edit distance
over that window (the item's size and the allowed edits to each side) decides.  The repetitions use independent walks.

The steps follow from the item (``steps_for``): the longest of STEPS at which, with MAX_EDITS of the characters edited
at random, the modelled recall still reaches TARGET.  A longer walk meets fewer wrong candidates, but an item has fewer
starts with room for it and each is more easily hit by an edit.  Items of the same steps share their walks.  An
unchanged passage is found with certainty, in each repetition; an edited one is missed only if no start of it keeps its
sampled steps in any repetition (tests measure the recall by length and share of edits).  Items of fewer than SHORT
bytes must stand in the document as they are.

Items go to the tasks in blocks of at most BLOCK_CHARS characters, one pass over the documents per block.

Edge cases: null or empty texts, and items without words, match nothing; texts of any length are read whole; a
repeated row gives its own rows; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import LOWER, _IS_SPACE, arrow_text, mix, row_slices, table

#: Steps of a walk to choose from, most sampled steps, independent repetitions.
STEPS, SAMPLED, REPEATS = (32, 24, 16, 10, 6), 14, 2
#: Recall of items with MAX_EDITS of their characters edited, by the model of ``steps_for``.
TARGET = 0.98
#: Bytes of a text from one independent start to the next; bytes from which on a word is walked from every character.
APART, LONG_WORD = 6, 24
#: Items of fewer bytes are looked up as they are.
SHORT = 12
#: Share of an item's characters that may be edited.
MAX_EDITS = 0.1
#: Characters of benchmark items that are sent to the tasks at once.
BLOCK_CHARS = 8_000_000
#: Word starts that are walked together.
TOGETHER = 1 << 19


def plain(text: str) -> str:
    return normal_bytes(np.frombuffer(text.encode(), np.uint8)).tobytes().decode()


def normal_bytes(data: np.ndarray) -> np.ndarray:
    """Words of one text, A-Z lower-cased, with single spaces between."""
    if not len(data):
        return data
    inside = ~_IS_SPACE[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    out = np.where(inside, LOWER[data], np.uint8(32))[keep]
    return out[:-1] if len(out) and out[-1] == 32 else out


def edit_distance_within(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of the whole pattern to any part of the text, and where the first such part ends."""
    m, where = len(pattern), {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | (1 << i)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = where.get(c, 0)
        x = eq | down
        diag = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(diag | up) & full), up & diag
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, at
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~(x | plus) & full), plus & x
    return best, end


GRAM = 4


def grams_of(text: str) -> list[str]:
    return [text[i:i + GRAM] for i in range(len(text) - GRAM + 1)]


def starts_of(x: np.ndarray) -> np.ndarray:
    """Where walks start in texts with single spaces, or zeros, between words."""
    gap = np.flatnonzero((x == 32) | (x == 0))
    begin, end = np.concatenate(([0], gap + 1)), np.append(gap, len(x))
    long = np.flatnonzero(end - begin >= LONG_WORD)
    inner = [np.arange(a, b) for a, b in zip(begin[long].tolist(), end[long].tolist())]
    begin = np.concatenate((begin[end > begin], *inner))
    return np.unique(begin[(x[begin] & 0xC0) != 0x80]) if inner else begin


def steps_for(size: int, starts: np.ndarray, max_edits: float = MAX_EDITS, repeats: int = REPEATS) -> int:
    """The longest walk that reaches TARGET for an item of ``size`` bytes.

    A walk of s steps reads s / 2 characters and keeps its key with chance (1 - max_edits) ** (s / 2); starts APART
    from each other are independent.  Repetitions read the same edits: each further one counts as half a walk.
    """
    for steps in STEPS:
        read = steps // 2
        room = min(int((starts + read <= size).sum()), max(0, size - read) // APART + 1)
        if (1 - (1 - max_edits) ** read) ** (room * (repeats + 1) / 2) <= 1 - TARGET:
            return steps
    return STEPS[-1]


class Walk:
    """One repetition: the random step function, the sampled steps, and the keys of the items."""

    def __init__(self, steps: int, sampled: int, seed: int):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, (steps, 256)).astype(np.intp)
        self.sampled = sorted(rng.choice(steps, sampled, replace=False).tolist())
        self.weight = rng.integers(1, 1 << 62, sampled).astype(np.uint64) | np.uint64(1)
        self.early, self.gate = min(4, sampled), None

    def keys(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the walks that start at ``at``, and which of them passed the gate; x ends in padding."""
        index = np.arange(len(at))
        key, code, taken = np.zeros(len(at), np.uint64), np.zeros(len(at), np.intp), 0
        for step in range(self.sampled[-1] + 1):
            c = x[at]
            if step == self.sampled[taken]:
                key += (c.astype(np.uint64) + np.uint64(1)) * self.weight[taken]
                taken += 1
                if taken <= self.early:
                    code = (code << 5) | (c & 31)
                if taken == self.early:
                    if self.gate is None:  # learning: the items' own first characters become the gate
                        self.codes = code
                    else:
                        ok = self.gate[code]
                        at, key, c, index = at[ok], key[ok], c[ok], index[ok]
                if taken == len(self.sampled):
                    break
            at = at + self.moves[step][c]
        return mix(key), index

    def last(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the walks that start at ``at`` stand at the last sampled step."""
        for step in range(self.sampled[-1]):
            at = at + self.moves[step][x[at]]
        return at

    def learn(self, texts: list[bytes], steps: int) -> None:
        """Key tables of the items: every start whose walk stays in its item."""
        joined, starts, owner, base = [], [], [], 0
        for k, t in enumerate(texts):
            b = np.frombuffer(t, np.uint8)
            first = starts_of(b)
            starts.append(first + base)
            owner.append(np.stack((np.full(len(first), k), first), 1))
            joined += [b, np.zeros(steps + 1, np.uint8)]
            base += len(b) + steps + 1
        starts, owner, x = np.concatenate(starts), np.concatenate(owner), np.concatenate(joined)
        inside = x[self.last(x, starts)] > 0
        starts, owner = starts[inside], owner[inside]
        key, _ = self.keys(x, starts)
        self.gate = np.zeros(1 << (5 * self.early), bool)
        self.gate[self.codes] = True
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], owner[order]
        del self.codes


class Finder:
    """Items of one block, ready to be found in documents."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float = MAX_EDITS, repeats: int = REPEATS):
        items = [(i, t) for i, t in ((i, plain(t)) for i, t in items if t) if t]
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.raw = [t.encode() for t in self.texts]
        self.edits = [int(len(t) * max_edits) for t in self.texts]
        self.grams = [grams_of(t) for t in self.texts]
        size = np.array(list(map(len, self.raw)), int)
        self.whole = np.flatnonzero(size < SHORT).tolist()
        self.walks = []
        steps_of = np.array([steps_for(len(t), starts_of(np.frombuffer(t, np.uint8)), max_edits, repeats)
                             if len(t) >= SHORT else 0 for t in self.raw], int)
        for steps in STEPS:
            mine = np.flatnonzero(steps_of == steps)
            for r in range(repeats if len(mine) else 0):
                walk = Walk(steps, min(SAMPLED, steps // 2 + 1), 101 * steps + r)
                walk.learn([self.raw[k] for k in mine], steps)
                walk.owner[:, 0] = mine[walk.owner[:, 0]]
                self.walks.append(walk)

    def candidates(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (place in x where the item would begin, item)."""
        found = []
        for walk in self.walks:
            for lo in range(0, len(starts), TOGETHER):
                at = starts[lo:lo + TOGETHER]
                key, index = walk.keys(x, at)
                left, right = np.searchsorted(walk.key, key), np.searchsorted(walk.key, key, "right")
                count = right - left
                hit = np.repeat(np.arange(len(key)), count)
                entry = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
                owner = walk.owner[entry]
                found.append(np.stack((at[index[hit]] - owner[:, 1], owner[:, 0]), 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), int)

    def distance(self, k: int, window: str) -> int:
        """Edit distance of item k to the nearest part of the window, or its length where that is beyond its limit.

        An edit changes GRAM of the item's character 4-grams at most, so a window that lacks more than that needs no
        exact comparison.
        """
        have = set(grams_of(window))
        if sum(g not in have for g in self.grams[k]) > GRAM * self.edits[k]:
            return len(self.texts[k])
        return edit_distance_within(self.texts[k], window)[0]

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document number, item id, distance, item characters) of every item found in every document."""
        parts, bounds, at = [], [0], 0
        for k in range(len(offsets) - 1):
            part = normal_bytes(data[offsets[k]:offsets[k + 1]])
            parts += [part, np.zeros(1, np.uint8)]
            at += len(part) + 1
            bounds.append(at)
        x = np.concatenate([*parts, np.zeros(STEPS[0] + 1, np.uint8)])
        bounds = np.array(bounds)
        rows = self.candidates(x, starts_of(x))
        out = []
        if len(rows):
            size = np.array(list(map(len, self.raw)))
            middle = rows[:, 0] + size[rows[:, 1]] // 2
            doc = np.clip(np.searchsorted(bounds, np.maximum(middle, 0), "right") - 1, 0, len(bounds) - 2)
            order = np.lexsort((rows[:, 0], rows[:, 1], doc))
            doc, place, item = doc[order], rows[order, 0], rows[order, 1]
            slack = 4 * np.array(self.edits) + 4
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > slack[item[1:]])
            cut = np.append(np.flatnonzero(new), len(doc))
            best = {}
            for a, b in zip(cut[:-1], cut[1:]):
                d, k = int(doc[a]), int(item[a])
                lo = max(int(place[a]) - int(slack[k]), int(bounds[d]))
                hi = min(int(place[b - 1]) + int(size[k] + slack[k]), int(bounds[d + 1]) - 1)
                window = x[lo:hi].tobytes()
                if self.raw[k] in window:
                    far = 0
                else:
                    far = self.distance(k, window.decode("utf-8", "ignore"))
                if far <= self.edits[k]:
                    best[d, k] = min(far, best.get((d, k), far))
            out = [(d, self.ids[k], far, len(self.texts[k])) for (d, k), far in best.items()]
        if self.whole:
            for d in range(len(bounds) - 1):
                text = b" " + x[bounds[d]:bounds[d + 1] - 1].tobytes() + b" "
                out += [(d, self.ids[k], 0, len(self.texts[k])) for k in self.whole if b" " + self.raw[k] + b" " in text]
        return sorted(out)


def _hit_rows(finder: Finder, batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = arrow_text(batch.column(1))
        for lo, hi in row_slices(offsets):
            found = finder.hits(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            if found:
                doc, item, far, size = zip(*found)
                yield pa.record_batch([batch.column(0).take(pa.array([lo + d for d in doc])), pa.array(item, pa.int64()),
                                       pa.array(far, pa.int64()), pa.array(size, pa.int64())],
                                      names=["doc_id", "item_id", "distance", "item_chars"])


def _clean_rows(finder: Finder, text_at: int, batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = arrow_text(batch.column(text_at))
        for lo, hi in row_slices(offsets):
            found = finder.hits(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            keep = np.ones(hi - lo, bool)
            keep[[d for d, *_ in found]] = False
            yield batch.slice(lo, hi - lo).filter(pa.array(keep))


def _blocks(items: DataFrame, item_id: str, text: str):
    """Finders for blocks of items, each within BLOCK_CHARS (or a single item)."""
    items = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = 1 + 2 * total // BLOCK_CHARS
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()
        yield Finder(sorted((r[0], r[1]) for r in rows))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_chars): every item found in every document, with its smallest distance."""
    kind, out = docs.schema[doc_id].dataType.simpleString(), None
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    for finder in _blocks(items, item_id, item_text):
        found = docs.mapInArrow(partial(_hit_rows, finder),
                                f"doc_id {kind}, item_id long, distance long, item_chars long")
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                         item_text: str = "text") -> DataFrame:
    """The documents in which no item is found; all columns as they are."""
    for finder in _blocks(items, item_id, item_text):
        docs = docs.mapInArrow(partial(_clean_rows, finder, docs.columns.index(text)), docs.schema)
    return docs


def op1(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold an item of the benchmark go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))
