import hashlib

import numpy as np

from fieldmark.llm import suffix_dedup as S
from helpers import awkward, documents, prose


def brute(rows, match=S.MATCH):
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        mask = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - match + 1):
            if (s := raw[k:k + match]) in seen:
                mask[k] += 1
                mask[k + match] -= 1
            seen.add(s)
        gone = np.cumsum(mask)[:len(raw)] > 0
        out[i] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                  hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def check(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in S.remove_repeats(documents(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)))


def mixed(seed, n):
    rng, out = np.random.default_rng(seed), []
    base = ["".join(rng.choice(list("ab cé"), rng.integers(0, 700))) for _ in range(20)]
    for _ in range(n):
        x, y = base[rng.integers(0, 20)], base[rng.integers(0, 20)]
        c = int(rng.integers(0, len(x) + 1))
        out.append([x, x[:c] + y[c:], x + "Q" + y, y[c:] + x, "z" * int(rng.integers(0, 400)), (x[:50] * 5)][rng.integers(0, 6)])
    return out


def test_against_brute_force(spark):
    check(spark, awkward() + mixed(1, 80))


def test_hot_passages_and_small_ranges(spark, monkeypatch):
    for name, value in (("HOT", 2), ("FLUSH", 200), ("FLUSH_BYTES", 4000), ("RANGE", 100), ("RANGE_BYTES", 2000), ("PART", 700)):
        monkeypatch.setattr(S, name, value)
    passage = prose(40, 5)
    check(spark, mixed(2, 60) + [passage] * 15 + [prose(9, k) + passage + prose(9, 99 + k) for k in range(20)])


def test_null_ids_repeated_rows_and_kept_bytes(spark):
    text = prose(50, 1)
    rows = [(None, text), (3, text), (3, text), (4, None), (4, "short"), (5, "new " + text)]
    out = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_kept=True).collect()
    size = len(text)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_removed) for r in out) == [
        (False, 0, 0), (True, 3, size), (True, 3, size), (True, 4, 0), (True, 4, 0), (True, 5, size)]
    assert S.remove_repeats(documents(spark, ["a"]).limit(0)).count() == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 200).astype(np.uint64)
    for width in (1, 2, 7, 77):
        assert S.sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(len(x) - width + 1)]


def test_passage_in_ever_new_surroundings(spark, monkeypatch, tmp_path):
    real, largest = S._span_rows, {}
    for name, value in (("FLUSH_BYTES", 20_000), ("RANGE_BYTES", 20_000)):
        monkeypatch.setattr(S, name, value)
    passage = prose(30, 5)
    for n in (100, 500):
        seen = tmp_path / str(n)
        seen.mkdir()
        folder = str(seen)

        def recorded(bits, match, key, rows):
            import uuid

            with open(f"{folder}/{uuid.uuid4()}", "w") as f:
                f.write(str(sum(sum(len(x.as_py()) for x in rows[c]) for c in ("h", "doc", "th", "start", "size", "text"))))
            return real(bits, match, key, rows)

        monkeypatch.setattr(S, "_span_rows", recorded)
        check(spark, [prose(30, 3 * k, 3000) + passage + prose(30, 3 * k + 1, 3000) for k in range(n)] + mixed(3, 20))
        largest[n] = max(int(p.read_text()) for p in seen.iterdir())
    assert largest[500] <= 2 * largest[100]
