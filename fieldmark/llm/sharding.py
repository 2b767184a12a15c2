"""Shards by extendible hashing (native Spark expressions only).

Every row has a 60-bit hash.  The directory starts with one bucket; a bucket over the byte limit splits on the next
bit of the hash, and only that one, until each fits.  The splits follow from byte sums alone: rows are summed by
hash prefix over BITS bits at once, every prefix length gets its sum from those, and the buckets are the shortest
prefixes that fit.  Prefixes that are over the limit at the last of these bits go on alone with the next BITS
bits, so rounds grow with the depth of the directory and not with its size.

What 60 bits cannot part, rows of one hash, forms an overflow chain: its bytes are summed by slices of a second hash
of the row's number, the slices' totals are summed in order, and parts are cut from that running sum of the whole
chain.  So a key that holds a third of all rows is spread over many tasks and still fills its shards at least half.
A row of more than half the limit gets a shard of its own in that chain.

Edge cases: a null or empty text has 0 bytes and goes where its hash says; a null key hashes as the empty string; an
empty table has no shards; repeated rows share a hash and split only by the chain; other columns are not read by
``assign_shards``.  ``write_shards`` carries all columns and writes each row once, whatever its key; its folders are
named ``shard=...``, with underscores in front where the documents have a column of that name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import table, unused, written

#: Bytes of text that a shard may hold, in the registered query.
LIMIT = 1 << 20
#: Bits of the hash that one round looks at, and all bits.
BITS, ALL_BITS = 15, 60
#: Slices in which an overflow chain's bytes are summed.
SLICES = 1 << 17


def key_hash(key: str):
    """The first 60 bits of the key's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, ALL_BITS // 4),
                  16, 10).cast("long")


def _round(rows: DataFrame, limit: int, base: int) -> tuple[DataFrame, DataFrame]:
    """One look at BITS bits of the hash, for rows (h, n_bytes) whose first ``base`` bits are over the limit.

    Returns (p, depth, prefix) for each fine prefix p whose bucket is found, and the fine prefixes still over it.
    """
    fine = written(rows.groupBy(F.expr(f"shiftright(h, {ALL_BITS - base - BITS})").alias("p")).agg(
        F.sum("n_bytes").alias("n_bytes")), "fine")
    first = base + 1 if base else 0
    up = fine.select("p", "n_bytes", F.explode(F.sequence(F.lit(first), F.lit(base + BITS))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(p, {base + BITS} - depth)"))
    sums = up.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("n_bytes"))
    # the bucket of a fine prefix is the shortest prefix of it that fits
    fits = up.drop("n_bytes").join(sums.where(F.col("n_bytes") <= limit).drop("n_bytes"), ["depth", "prefix"])
    found = written(fits.groupBy("p").agg(F.min(F.struct("depth", "prefix")).alias("b")).select(
        "p", "b.depth", "b.prefix"), "directory")
    return found, fine.join(found, "p", "left_anti").select("p")


def assign_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, shard, depth) of every row: the shard is its bucket's bits, with -k for part k of a chain."""
    return _assign(docs.select(F.col(key).alias("key"), key_hash(key).alias("h"), _bytes(text)), limit).withColumnRenamed(
        "key", key)


def _bytes(text: str):
    return F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes")


def _assign(rows: DataFrame, limit: int) -> DataFrame:
    """(key, n_bytes, shard, depth) of rows (key, h, n_bytes)."""
    rows = written(rows, "sizes")
    out = []
    for base in range(0, ALL_BITS, BITS):
        rows = rows.withColumn("p", F.expr(f"shiftright(h, {ALL_BITS - base - BITS})"))
        found, over = _round(rows, limit, base)
        bits = F.when(F.col("depth") == 0, "").otherwise(
            F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth").cast("int"), F.lit("0")))
        out.append(rows.join(found, "p").select("key", "n_bytes", bits.alias("shard"), F.col("depth").cast("long").alias("depth")))
        if not over.limit(1).count():
            break
        rows = rows.join(over, "p", "left_semi")
    else:
        whole = F.lpad(F.conv(F.col("h").cast("string"), 10, 2), ALL_BITS, "0")
        out.append(_chain(rows.select("key", "n_bytes", whole.alias("shard"), F.lit(ALL_BITS).cast("long").alias("depth")), limit))
    return reduce(DataFrame.unionByName, out)


def _chain(rows: DataFrame, limit: int) -> DataFrame:
    """Parts of overflow chains, by the running sum of each chain's bytes over its slices and within them.

    A part holds the rows of at most half the limit whose running sum ends in one stretch of half the limit, so it fits
    and a chain of B such bytes has at most 2 * ceil(B / limit) parts; a larger row stands alone.
    """
    half = (limit + 1) // 2
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "slice", F.pmod(F.xxhash64("row"), F.lit(SLICES))), "chain")
    small = F.col("n_bytes") <= half
    slices = rows.groupBy("shard", "slice").agg(F.sum(F.when(small, F.col("n_bytes")).otherwise(0)).alias("own"))
    before = slices.select("shard", "slice", (F.sum("own").over(
        Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("before"))
    within = Window.partitionBy("shard", "slice").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.when(small, F.col("n_bytes")).otherwise(0)).over(within)).join(before, ["shard", "slice"])
    part = F.when(small, F.floor(F.greatest(F.col("before") + F.col("end") - 1, F.lit(0)) / F.lit(half)).cast("string")).otherwise(
        F.concat(F.lit("x"), F.col("row")))
    return rows.select("key", "n_bytes", F.concat("shard", F.lit("-"), part).alias("shard"), "depth")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write the documents as one folder per shard; keys may be null or repeated."""
    number, folder = unused("row_number", docs.columns), unused("shard", docs.columns)
    # numbers that stay the same when a task runs again
    docs = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    shards = _assign(docs.select(F.col(number).alias("key"), key_hash(key).alias("h"), _bytes(text)), limit)
    docs.join(shards.select(F.col("key").alias(number), F.col("shard").alias(folder)), number).drop(number).repartition(
        folder).write.partitionBy(folder).parquet(path)


def op3(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


#: Bits that the SQL looks at: more than any bucket of the tables needs that it runs on.
_SQL_BITS = 24
ORACLE = f"""WITH r AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h,
    coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
s AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS n
  FROM r, range(0, {_SQL_BITS + 1}) AS d(depth) GROUP BY ALL),
b AS (SELECT s.depth, s.prefix FROM s LEFT JOIN s p ON p.depth = s.depth - 1 AND p.prefix = s.prefix >> 1
  WHERE s.n <= {LIMIT} AND (s.depth = 0 OR p.n > {LIMIT}))
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INTEGER, '0') END AS shard,
  depth::BIGINT AS depth
FROM r JOIN b ON b.prefix = r.h >> (60 - b.depth)"""
