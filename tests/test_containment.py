"""Containment by automata against plain search, in one block of the dictionary and in many."""

import random
import re
import subprocess
import sys

from pyspark.sql import functions as F

from fieldmark.operators.containment import containment_hits, phrase_hits, reverse_hits
from fieldmark.operators.linking import _best


def lookup_of(spark, surfaces):
    rows = [(s, f"K{i % 5}", i, len(s)) for i, s in enumerate(surfaces)]
    return spark.createDataFrame(rows, "surface string, canonical string, ord int, len int")


def word(rng, letters="abcde"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(1, 5)))


def phrase(rng):
    return rng.choice([" ", "-", "'", "  "]).join(word(rng) for _ in range(rng.randint(1, 4)))


def plain(n, surfaces, phrases, reverse):
    for s, i in sorted(((s, i) for i, s in enumerate(surfaces)), key=lambda x: (-len(x[0]), x[1])):
        if phrases and re.search(r"\b" + re.escape(s) + r"\b", n) or reverse and len(n) >= 4 and n in s:
            return len(s), i, f"K{i % 5}"
    return None


def found(hits):
    return {r.n: (r._rank[0], -r._rank[1], r.canonical) for r in _best(hits, "n").collect()}


def test_against_plain_search(spark):
    rng = random.Random(4)
    surfaces = list(dict.fromkeys([phrase(rng) for _ in range(300)] + ["l'a_b", "été", "a+b", "%", "ab % cd", "中文 字"]))
    spans = list(dict.fromkeys([phrase(rng) for _ in range(400)] + [s[1:-1] for s in surfaces] + surfaces + [
        "", "x", "a l'a_b c", "l'été", "a+b+c", "50%", "ab % cd", "x" * 5000, "中文 字 x", "文 字"]))
    spans_n = spark.createDataFrame([(s,) for s in spans] + [(None,)], "n string")
    lookup = lookup_of(spark, surfaces)
    for limits in ({}, {"block_chars": 400, "block_rows": 50}):
        for hits, flags in ((phrase_hits, (True, False)), (containment_hits, (True, True))):
            want = {n: p for n in spans if (p := plain(n, surfaces, *flags)) and n}
            assert found(hits(spans_n, lookup, **limits)) == want, (hits, limits)
        want = {n: p for n in spans if (p := plain(n, surfaces, False, True))}
        assert found(reverse_hits(spans_n, lookup, span_chars=100, **limits)) == want, limits


def test_empty_sides(spark):
    some, none = lookup_of(spark, ["ab"]), lookup_of(spark, ["ab"]).limit(0)
    spans_n = spark.createDataFrame([("ab",)], "n string")
    assert containment_hits(spans_n, none).collect() == []
    assert containment_hits(spans_n.limit(0), some).collect() == []


def test_large_dictionary(spark):
    """200,000 surfaces in several blocks against search in the joined text."""
    def text(seed):
        part = F.substring(F.translate(F.md5(F.concat(F.col("id").cast("string"), F.lit(seed))), "0123456789", "ghijklmnop"), 1, 5)
        return part

    lookup = spark.range(200_000).select(F.concat_ws(" ", text("a"), text("b")).alias("surface"),
                                         F.concat(F.lit("K"), F.col("id") % 7).alias("canonical"),
                                         F.col("id").cast("int").alias("ord")).withColumn("len", F.length("surface"))
    surfaces = [(r.surface, r.ord) for r in lookup.orderBy("ord").collect()]
    joined, starts = "\n".join(s for s, _ in surfaces), []
    spans = [s[3:8] for s, _ in surfaces[::4000]] + [f"zz {s} zz" for s, _ in surfaces[7::4000]] + ["none", "zzzzz"]
    got = found(containment_hits(spark.createDataFrame([(s,) for s in spans], "n string"), lookup))
    at = 0
    for s, _ in surfaces:
        starts.append(at)
        at += len(s) + 1
    import bisect
    want = {}
    for n in spans:
        inside = n[3:-3] if n.startswith("zz ") else n
        k = joined.find(inside)  # all of one length: the earliest wins
        if k >= 0:
            i = bisect.bisect_right(starts, k) - 1
            want[n] = (11, i, f"K{i % 7}")
    assert got == want


def test_memory_of_a_block():
    """One block of surfaces, and one part of spans, stay within a bound, whatever the dictionary's size."""
    code = """
import resource, random, pyarrow as pa
from fieldmark.operators import containment as C
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20000)]
block, chars = [], 0
while chars < C.BLOCK_CHARS and len(block) < C.BLOCK_ROWS:
    s = f"{rng.choice(words)} {rng.choice(words)} {rng.choice(words)}"
    block.append((s, len(s), len(block), "k")); chars += len(s)
block.sort(key=lambda r: (-r[1], r[2]))
batch = pa.RecordBatch.from_arrays([pa.array([" ".join(rng.choice(words) for _ in range(9)) for _ in range(20000)])], names=["n"])
print(sum(b.num_rows for b in C._phrase_task(block)([batch])), sum(b.num_rows for b in C._reverse_task(block, 4, C.SPAN_CHARS)([batch])))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300,
                         cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) < 900, out.stdout
