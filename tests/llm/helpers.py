"""Small tables with the awkward rows that every operator must handle."""

from __future__ import annotations

import re

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, id long"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def documents(spark, texts, first=0):
    """Rows with nulls in other columns, and columns whose names operators use inside."""
    rows = [(first + i, t, None if i % 5 == 0 else "en", None, None if t is None else len(t), "h", -i)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed, vocabulary=400):
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnop")
    vocab = ["".join(rng.choice(letters, rng.integers(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(vocab, n))


def awkward():
    """Null, empty, blank, accents, line breaks, one very long text, and repeated rows."""
    long = prose(30_000, 9, 5000)
    return [None, "", " \t\n", "é", "One.\nTwo words\n\nTwo words\x0bend", prose(200, 1), prose(200, 1), prose(60, 2),
            long, "x" * 5000, prose(60, 2) + " 　 tail"]
