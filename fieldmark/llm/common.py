"""Small helpers that the operators share: tables, written intermediate tables, vectorised text hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.session import scratch_path

#: Regular expression of a run of white space between words: space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]+"
#: The same characters, as a plain string.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The lineage ends there: an executor lost later costs no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, taken) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it (upper and lower case are one)."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(col: str = "text"):
    """The text, null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def arrow_text(array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column of an Arrow batch, and n + 1 offsets (a null is empty)."""
    import pyarrow as pa

    array = array.fill_null("") if array.null_count else array
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], kind, len(array) + 1, array.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Cache(dict):
    """A cache of one process: it travels to tasks empty."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply, a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash modulo 2 ** 64 of a byte array: n + 1 sums, see ``span_hash``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end) of each span, wherever it stands."""
    shift = powers(_UNBASE, len(sums))
    return mix((sums[end] - sums[start]) * shift[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def piece_hashes(data: np.ndarray, sizes: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """``span_hash`` of pieces that follow each other, some ``chunk`` bytes at a time."""
    ends = np.cumsum(sizes)
    out, k = [], 0
    while k < len(sizes):
        begin = int(ends[k] - sizes[k])
        last = max(k + 1, int(np.searchsorted(ends, begin + chunk, "right")))
        start = ends[k:last] - sizes[k:last] - begin
        out.append(span_hash(prefix_hash(data[begin:int(ends[last - 1])]), start, start + sizes[k:last]))
        k = last
    return np.concatenate(out) if out else np.empty(0, np.uint64)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word; words end at white space and at the document's end."""
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def row_slices(offsets: np.ndarray, max_bytes: int = 1 << 20):
    """Row ranges of about ``max_bytes`` of text each; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, chunk: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word (A-Z lower-cased), in order, in chunks that end between words."""
    hashes, docs, at = [], [], 0
    while at < len(data):
        end = min(at + chunk, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_IS_SPACE[data[at:end]])
            starts = offsets[(offsets > at) & (offsets <= end)]
            last = max(at + int(gaps[-1]) + 1 if len(gaps) else 0, int(starts[-1]) if len(starts) else 0)
            if last <= at:  # one word fills the chunk: go on to its end
                rest = np.flatnonzero(_IS_SPACE[data[end:]])
                after = offsets[offsets > end]
                last = min(end + int(rest[0]) + 1 if len(rest) else len(data), int(after[0]) if len(after) else len(data))
            end = last
        part = LOWER[data[at:end]]
        inner = offsets[(offsets > at) & (offsets < end)] - at
        own = np.concatenate(([0], inner, [end - at]))
        start, stop, _ = words(part, own)
        hashes.append(span_hash(prefix_hash(part), start, stop))
        docs.append(np.searchsorted(offsets, start + at, "right") - 1)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length of the array."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]))


def planes(values: np.ndarray) -> bytes:
    """The bytes of an integer array, most alike together, so that the shuffle's compression finds them."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components: (id, root) for every id in ``edges`` (a, b), root the smallest id reachable.

    Alternates the large-star and small-star steps on tables in the shared folder; both hang neighbours on
    the smallest one, so that a hub costs as many rows as it has edges.
    """
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), name)
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        new = written(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                      .union(low.select("a", F.col("m").alias("b"))).distinct(), name)
        # every node hangs on one root, and no root hangs on another: a forest of stars
        deep = new.groupBy("a").count().where("count > 1").limit(1).count() or (
            new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi").limit(1).count())
        pairs = new
        if not deep:
            return new.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
                new.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
