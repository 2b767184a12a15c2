import hashlib
import re

import pytest

from fieldmark.llm import pii
from helpers import awkward, documents, prose

CARD = "4111 1111 1111 1111"


def plain_base(text):
    """The patterns as they are written, straight over the text."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        s = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d)))
        out += [(m.start(), 2, m.end())] * (14 <= len(d) <= 19 and s % 10 == 0)
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


TEXTS = awkward() + ["a@b.c@d.e x@y", "é me.you+x@mail-1.example.org, a@@b.c", "1.2.3.4 999.1.1.1 1.2.3.4.5 010.0.0.255",
                     f"{CARD} {CARD[:-1]}2 4111-1111-1111-1111", "+1 (415) 555-0100 +12 34 +1.2.3.4.5.6.7.8.9.0",
                     "9" * 6000, "@" * 50, prose(90, 8) + " joe@mail.example " + prose(90, 9) + " +1 (212) 555-0199"]


@pytest.fixture(scope="module")
def tagger():
    t = pii.Tagger(2 * len(pii.KINDS) + 1)
    t.fit(*pii.training_windows(pii.labelled([prose(60, k) for k in range(60)])))
    return t


def test_base_spans_are_the_patterns():
    for t in TEXTS:
        assert pii.base_spans(t or "") == plain_base(t or "")


def test_rows(spark, tagger):
    empty = hashlib.sha256(b"").hexdigest()
    for r in pii.find_pii(documents(spark, TEXTS), tagger).collect():
        base = plain_base(TEXTS[r.doc_id] or "")
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in spans) for k in pii.KINDS[:4]]
        assert text or not r.spans or r.base_sha256 == empty


def test_held_out_accuracy(tagger):
    hit = found = wanted = 0
    for text, spans in pii.labelled([prose(60, k) for k in range(500, 560)], seed=5):
        c = pii.classes_of(text)
        starts = pii.window_starts(pii._marks(c, text))
        if len(starts):
            got = set(pii.tagged_spans(pii.reconcile(len(c), starts, tagger.decode(pii.windows_of(c, starts)))))
            hit, found, wanted = hit + len(got & set(spans)), found + len(got), wanted + len(spans)
    assert hit / found > 0.85 and hit / wanted > 0.85


def test_added_spelling_is_found(tagger):
    text = prose(40, 1) + " write to anna.lee @ mailbox.example today " + prose(40, 2)
    base, more = pii.spans_of_texts([text], tagger)[0]
    assert not base and any(text[s:e] == "anna.lee @ mailbox.example" for s, _, e in more)


def test_gradient_is_that_of_the_loss():
    import numpy as np
    t = pii.Tagger(3, width=3, hidden=2)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    rng = np.random.default_rng(0)
    w, y = rng.integers(0, 9, (2, 5)), rng.integers(0, 3, (2, 5))
    grads = t.step(w, y)[1]
    for key in t.p:
        at = np.unravel_index(int(np.abs(grads[key]).argmax()), grads[key].shape)
        keep, e = t.p[key][at], 1e-3
        t.p[key][at] = keep + e
        up = t.step(w, y)[0]
        t.p[key][at] = keep - e
        down = t.step(w, y)[0]
        t.p[key][at] = keep
        assert abs((up - down) / (2 * e) - grads[key][at]) < 2e-3, key


def test_masking_and_empty_table(spark, tagger):
    docs = documents(spark, TEXTS)
    out = pii.mask_pii(docs, tagger)
    assert out.columns == docs.columns
    for r in out.collect():
        assert not plain_base(re.sub("<[A-Z]+>", "", r.text or "")) or "@" in TEXTS[r.doc_id] or r.doc_id
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert pii.find_pii(docs.limit(0), tagger).count() == 0
    assert pii.masked("a b@c.d e", [(2, 0, 7)]) == "a <EMAIL> e"
