"""Containment of spans and dictionary surfaces in each other (T4, T5, J4) by Aho-Corasick automata.

Two tests on folded texts, each one pass in linear time:

* phrase: an automaton of the dictionary's surfaces reads every span; of the
  surfaces that it finds between word boundaries (as Python's ``re`` sees
  them) the longest counts, then the earliest;
* reverse: the roles are turned around, so that nothing is kept of a surface
  but its text: an automaton of the spans at hand (of at least ``min_len``
  characters) reads the surfaces, in the order in which they win, and the
  first in which a span is found is its best.

Automata are bounded: the dictionary is taken in blocks of about
``BLOCK_CHARS`` characters (one, for a common dictionary), the spans of a task
in parts of ``SPAN_CHARS``.  Spans never leave their partition; a block sends
each span's best hit.  A block of the dictionary is what goes through the
driver at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.session import scratch_path
from fieldmark.sources.dimensions import REVERSE_CONTAINMENT_MIN_LEN

#: Characters of the surfaces of one dictionary block, and of the spans of one reverse automaton.
BLOCK_CHARS, SPAN_CHARS = 1_000_000, 1_000_000
#: A dictionary of at most so many surfaces is read in one go.
BLOCK_ROWS = 50_000
HITS = "n string, len int, ord long, canonical string"


def dictionary_blocks(lookup: DataFrame, block_chars: int = BLOCK_CHARS, block_rows: int = BLOCK_ROWS):
    """Blocks of surfaces ``(surface, len, ord, canonical)``, winners first: longest, then earliest."""
    rows = lookup.select("surface", "len", F.col("ord").cast("long").alias("ord"), "canonical")

    def ordered(found):
        return sorted((tuple(r) for r in found), key=lambda r: (-r[1], r[2]))

    first = rows.limit(block_rows + 1).collect()
    if len(first) <= block_rows and sum(r["len"] for r in first) <= block_chars:
        if first:
            yield ordered(first)
        return
    rows = _written(rows, "dictionary")
    chars, n = rows.agg(F.sum("len"), F.count(F.lit(1))).first()
    blocks = 1 + 2 * max(chars // block_chars, n // block_rows)
    for b in range(blocks):
        found = rows.where(F.pmod(F.xxhash64("surface"), F.lit(blocks)) == b).collect()
        if found:
            yield ordered(found)


# The tasks are made inside functions so that they travel to Python workers by value.

def _phrase_task(block: list):
    def task(batches):
        import re

        import ahocorasick
        import pyarrow as pa

        edge = re.compile(r"\b")
        automaton = ahocorasick.Automaton()
        for rank, (surface, size, _, _) in enumerate(block):
            automaton.add_word(surface, (rank, size))
        automaton.make_automaton()
        for batch in batches:
            found = []
            for n in batch.column(0).to_pylist():
                if not n:
                    continue
                best, edges = len(block), None
                for end, (rank, size) in automaton.iter(n):
                    if rank < best:
                        edges = edges or {m.start() for m in edge.finditer(n)}
                        if end + 1 in edges and end + 1 - size in edges:
                            best = rank
                if best < len(block):
                    found.append((n, *block[best][1:]))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 4, kinds)],
                                             names=["n", "len", "ord", "canonical"])

    return task


def _reverse_task(block: list, min_len: int, span_chars: int):
    def task(batches):
        import ahocorasick
        import pyarrow as pa

        def hits(spans):
            automaton = ahocorasick.Automaton()
            for n in spans:
                automaton.add_word(n, n)
            automaton.make_automaton()
            found = {}
            for surface, *rest in block:
                for _, n in automaton.iter(surface):
                    if n not in found:
                        found[n] = rest
            rows = [(n, *rest) for n, rest in found.items()]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)],
                                              names=["n", "len", "ord", "canonical"])

        spans, chars = set(), 0
        for batch in batches:
            for n in batch.column(0).to_pylist():
                if n and min_len <= len(n) <= block[0][1] and n not in spans:
                    spans.add(n)
                    chars += len(n)
                    if chars >= span_chars:
                        yield hits(spans)
                        spans, chars = set(), 0
        if spans:
            yield hits(spans)

    return task


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hits(spans_n: DataFrame, blocks, tasks_of) -> DataFrame:
    """Hits of every block.  With more than one, each block's are written before the next one is read."""
    spans_n = spans_n.select("n")

    def found(block):
        out = None
        for task in tasks_of(block):
            part = spans_n.mapInArrow(task, HITS)
            out = part if out is None else out.unionByName(part)
        return out

    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spans_n.sparkSession.createDataFrame([], HITS)
    if second is None:
        return found(first)
    spans_n = _written(spans_n, "spans")
    out = _written(found(first), "hits").unionByName(_written(found(second), "hits"))
    del first, second
    for block in blocks:
        out = out.unionByName(_written(found(block), "hits"))
    return out


def phrase_hits(spans_n: DataFrame, lookup: DataFrame, **limits) -> DataFrame:
    """T4: the best surface of each dictionary block inside each span, ``(n, len, ord, canonical)``."""
    return _hits(spans_n, dictionary_blocks(lookup, **limits), lambda block: [_phrase_task(block)])


def reverse_hits(spans_n: DataFrame, lookup: DataFrame, min_len: int = REVERSE_CONTAINMENT_MIN_LEN,
                 span_chars: int = SPAN_CHARS, **limits) -> DataFrame:
    """T5: the best surface of each dictionary block that holds each span of ``min_len`` characters or more."""
    return _hits(spans_n, dictionary_blocks(lookup, **limits), lambda block: [_reverse_task(block, min_len, span_chars)])


def containment_hits(spans_n: DataFrame, lookup: DataFrame, min_len: int = REVERSE_CONTAINMENT_MIN_LEN,
                     span_chars: int = SPAN_CHARS, **limits) -> DataFrame:
    """T4 and T5 together, the dictionary read once."""
    return _hits(spans_n, dictionary_blocks(lookup, **limits),
                 lambda block: [_phrase_task(block), _reverse_task(block, min_len, span_chars)])
