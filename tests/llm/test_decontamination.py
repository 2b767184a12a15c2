import numpy as np

from fieldmark.llm import decontamination as D
from helpers import awkward, documents, prose


def distance(item, text):
    """Edit distance of the whole item to the nearest part of the text, by the plain table."""
    row = np.zeros(len(text) + 1, int)
    chars = np.array([ord(c) for c in text])
    for i, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (chars != ord(c)), row[1:] + 1)
        new[1:] = np.minimum.accumulate(new[1:] - np.arange(1, len(new))) + np.arange(1, len(new))
        new[1:] = np.minimum(new[1:], new[0] + np.arange(1, len(new)))
        row = new
    return int(row.min())


def edited(text, rate, rng):
    z = list(text)
    for _ in range(int(len(text) * rate)):
        p, kind = int(rng.integers(0, len(z))), rng.integers(0, 3)
        if kind == 0:
            z[p] = chr(rng.integers(97, 123))
        elif kind == 1:
            z.insert(p, chr(rng.integers(97, 123)))
        else:
            del z[p]
    return "".join(z)


def items_of(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


ITEMS = [prose(30 + k, 1000 + k) for k in range(8)] + [None, "", " ", "short one here", "Éà", prose(30, 1000)]


def test_distance_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = "".join(rng.choice(list("abé "), rng.integers(1, 20)))
        b = "".join(rng.choice(list("abé "), rng.integers(0, 40)))
        assert D.edit_distance_within(a, b)[0] == distance(a, b)


def test_recall_and_precision_against_brute_force(spark):
    rng, texts, items = np.random.default_rng(1), awkward(), [D.plain(t or "") for t in ITEMS]
    for rate in (0, 0, 0.03, 0.05, 0.08, 0.1, 0.2, 0.4):
        texts += [prose(20, rng.integers(1 << 20)) + "  " + edited(items[k], rate, rng).upper() + "\n" + prose(9, k) for k in range(8)]
    texts += ["a short  ONE\there b", "ashort one here", "x éà y Éà", items[0][:len(items[0]) // 2]]
    got = {(r.doc_id, r.item_id): r.distance for r in D.contaminated(documents(spark, texts), items_of(spark, ITEMS)).collect()}
    want = {}
    for i, t in enumerate(texts):
        p = D.plain(t or "")
        for k, item in enumerate(items):
            if not item or len(p) > 20_000:
                continue
            if len(item.encode()) < D.SHORT:
                if f" {item} " in f" {p} ":
                    want[i, k] = 0
            elif (d := distance(item, p)) <= int(len(item) * D.MAX_EDITS):
                want[i, k] = d
    assert got.items() <= want.items()  # nothing but true ones, with their exact distance
    assert {x for x, d in want.items() if d == 0} <= got.keys()  # unchanged passages are certain
    assert len(got) >= 0.95 * len(want)


def test_stage_and_empty_tables(spark, tmp_path):
    items = items_of(spark, ITEMS)
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, awkward() + ["x " + ITEMS[2] + " y", prose(90, 4)])
    kept = D.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(awkward()) + 2)) - {len(awkward())}
    assert D.contaminated(docs, items.limit(0)).count() == 0
    assert D.contaminated(docs.limit(0), items).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    docs = documents(spark, [" ".join(x for x in ITEMS if x)])
    found = {r.item_id for r in D.contaminated(docs, items_of(spark, ITEMS)).collect()}
    assert found == {k for k, t in enumerate(ITEMS) if t and t.strip()}


def test_recall_of_changed_copies_by_length():
    for low, high in ((12, 16), (16, 24), (24, 40), (40, 57), (57, 70), (70, 90), (90, 150)):
        rng = np.random.default_rng(low)
        items = [D.plain(prose(60, 7000 + 100 * low + k)[:rng.integers(low, high)]) for k in range(60)]
        items = [t for t in items if len(t) >= low]
        finder = D.Finder(list(enumerate(items)))
        for rate in (0.05, 0.08, 0.1):
            texts, want = [], set()
            for k, item in enumerate(items):
                texts.append(D.plain(prose(8, k) + " " + edited(item, rate, rng) + " " + prose(8, 99 + k)))
                if 0 < distance(item, texts[-1]) <= int(len(item) * D.MAX_EDITS):
                    want.add((k, k))
            raw = [t.encode() for t in texts]
            offsets = np.concatenate(([0], np.cumsum(list(map(len, raw)))))
            got = {(d, i) for d, i, *_ in finder.hits(np.frombuffer(b"".join(raw), np.uint8), offsets)}
            assert len(want & got) >= 0.95 * len(want), (low, rate)


def test_items_with_few_word_starts():
    rng = np.random.default_rng(3)
    item = "".join(rng.choice(list("abcdefgh"), 90)) + " end"
    copy = item[:5] + "X" + item[6:25] + item[26:45] + "YY" + item[46:65] + item[66:]
    text = f"some words {copy} and more".encode()
    finder = D.Finder([(7, item)])
    assert [(d, i) for d, i, *_ in finder.hits(np.frombuffer(text, np.uint8), np.array([0, len(text)]))] == [(0, 7)]
