import hashlib

from fieldmark.llm import sharding as S
from helpers import awkward, documents, prose


def extendible(rows, limit):
    """A directory grown by splitting, one bucket at a time."""
    bits = {i: f"{int(hashlib.md5(str('' if i is None else i).encode()).hexdigest()[:15], 16):060b}" for i, _ in rows}
    todo, done = [("", rows)], {}
    while todo:
        prefix, own = todo.pop()
        if sum(n for _, n in own) <= limit:
            done |= {i: prefix for i, _ in own}
        else:
            for b in "01":
                part = [(i, n) for i, n in own if bits[i][len(prefix)] == b]
                todo += [(prefix + b, part)] * bool(part)
    return done


def test_against_a_directory_that_splits(spark):
    texts = [t for t in awkward() if len(t or "") < 3000] + [prose(n, n) for n in range(3, 120)]
    for limit in (3000, 100_000):
        got = {r.doc_id: (r.shard, r.n_bytes, r.depth) for r in S.assign_shards(documents(spark, texts), limit).collect()}
        rows = [(i, len((t or "").encode())) for i, t in enumerate(texts)]
        want = extendible(rows, limit)
        assert got == {i: (want[i], n, len(want[i])) for i, n in rows}


def test_more_bits_than_one_round(spark, monkeypatch):
    monkeypatch.setattr(S, "BITS", 3)
    texts = [prose(n % 9 + 1, n) for n in range(150)]
    got = {r.doc_id: r.shard for r in S.assign_shards(documents(spark, texts), 90).collect()}
    assert got == extendible([(i, len(t)) for i, t in enumerate(texts)], 90)


def test_hot_key_large_rows_and_empty_table(spark):
    rows = [(7 if i % 3 == 0 else (None if i == 4 else i), None if i == 5 else "x" * (i % 50)) for i in range(600)] + [(9, "y" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = S.assign_shards(docs, 100).collect()
    size, count = {}, {}
    for r in out:
        size[r.shard], count[r.shard] = size.get(r.shard, 0) + r.n_bytes, count.get(r.shard, 0) + 1
    assert len(out) == len(rows) and all(n <= 100 or count[s] == 1 for s, n in size.items())
    assert S.assign_shards(docs.limit(0), 100).count() == 0


def test_written_shards(spark, tmp_path):
    docs = documents(spark, [prose(n, n) for n in range(3, 40)])
    S.write_shards(docs, str(tmp_path / "out"), 2000)
    back = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_chain_fills_its_shards(spark):
    limit = 25_001
    rows = [(7, "x" * (i % 90)) for i in range(3000)] + [(7, "y" * 20_000)] * 2 + [(8, "z" * 500)] * 60 + [(i, "w") for i in range(9, 40)]
    out = S.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in out) == sorted((i, len(t)) for i, t in rows)
    size = {}
    for r in out:
        size.setdefault((r.doc_id, r.shard), []).append(r.n_bytes)
    for key in (7, 8):
        own = [n for (i, _), n in size.items() if i == key]
        large = sum(n == 20_000 for part in own for n in part)
        total = sum(n for part in own for n in part if n < 20_000)
        assert len(own) <= 2 * -(-total // limit) + large and all(sum(part) <= limit for part in own)


def test_written_once_whatever_the_keys(spark, tmp_path):
    """Null and repeated keys, and columns named like the inner ones."""
    rows = [(None if i % 4 == 0 else 3, "t" * (i % 30), i, "s", "r", i) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, Shard string, key string, row_number long")
    S.write_shards(docs, str(tmp_path / "out"), 200)
    back = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert back.columns == docs.columns and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir() and not p.name.startswith("_shard=")] == []


def test_key_with_an_inner_name(spark):
    docs = spark.createDataFrame([(i, "t" * i, 0) for i in range(50)], "h long, text string, p long")
    out = S.assign_shards(docs, 100, key="h")
    assert out.columns == ["h", "n_bytes", "shard", "depth"] and sorted(r.h for r in out.collect()) == list(range(50))
