"""Personal data in whole texts: fixed patterns, and spans that a character BiLSTM-CRF adds.

The patterns give the base spans.  The tagger is trained in numpy from labelled spans: windows of a bounded sample
of texts (SAMPLE_ROWS excerpts, labelled by the patterns) and the same excerpts with generated data written in (also
in spellings that the patterns miss, and secrets such as keys and passwords).  It decodes overlapping windows of a
text; where windows overlap, each character takes its tag from the window in which it stands most central, and the
spans are read off the whole text's tags.  A span that meets a base span is dropped, and one of the four base kinds
must hold what its kind needs (digits, check sum, parts), so the patterns' result always stays.

All kinds hold a digit or an ``@``; windows without either are not decoded, which loses nothing of these kinds.

Edge cases: a null or empty text has no spans; texts of any length are read whole; repeated rows get the same
spans; an empty table gives an empty result (the tagger then learns from generated data alone).
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.bilstm_crf import Tagger, classes_of
from fieldmark.llm.common import arrow_text, row_slices, table

KINDS = ("email", "ip", "card", "phone", "secret")
WIDTH, STRIDE = 64, 32
#: Excerpts that the tagger learns from, each of EXCERPT characters at most, out of LOOK times as many texts.
SAMPLE_ROWS, EXCERPT, LOOK = 400, 600, 25

# Patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|token|secret|api_?key)\s?[=:]\s?\"?[A-Za-z0-9_-]{12,}\"?")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def _small_parts(s: str) -> bool:
    return all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and non-overlapping per kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:  # the part before an @ is the run of its characters, but not what an earlier match took
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _small_parts(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def holds(kind: int, s: str) -> bool:
    """Whether a tagged span has what its kind needs."""
    d = digits_of(s)
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9]\s?@\s?[A-Za-z0-9-]+\s?\.\s?[A-Za-z]", s))
    if kind == 1:
        return bool(re.fullmatch(r"\d{1,3}(\s?\.\s?\d{1,3}){3}", s)) and _small_parts(re.sub(r"\s", "", s))
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == 3:
        return 10 <= len(d) <= 15 and bool(re.match(r"\+|00|\(", s))
    return len(s) >= 16 and bool(d)


def window_starts(marks: np.ndarray) -> np.ndarray:
    """Starts, on a grid, of the windows that hold a marked character."""
    cell = np.unique(marks // STRIDE)
    starts = np.unique(np.concatenate((cell, cell - 1))) * STRIDE
    return starts[starts >= 0]


def _marks(classes: np.ndarray, text: str) -> np.ndarray:
    return np.flatnonzero((classes == 4) | (classes == classes_of("@")[0]))


def windows_of(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate((classes, np.zeros(WIDTH, np.int64)))
    return padded[starts[:, None] + np.arange(WIDTH)]


def reconcile(n: int, starts: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """One tag per character: from the window in which it stands most central."""
    out = np.zeros(n + WIDTH, np.int64)
    offset = np.arange(WIDTH)
    for at in np.argsort(np.minimum(offset, WIDTH - 1 - offset), kind="stable"):  # later ones overwrite
        out[starts + at] = tags[:, at]
    return out[:n]


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    kind = (tags + 1) // 2
    change = np.flatnonzero((np.diff(kind, prepend=0) != 0) | (tags % 2 == 1))
    ends = np.append(change[1:], len(tags))
    return [(int(s), int(kind[s]) - 1, int(s + _until(kind, s, e))) for s, e in zip(change, ends) if kind[s]]


def _until(kind, s, e):
    stop = np.flatnonzero(kind[s:e] != kind[s])
    return stop[0] if len(stop) else e - s


def added_spans(text: str, tags: np.ndarray, base: list) -> list[tuple[int, int, int]]:
    out = []
    for start, kind, end in tagged_spans(tags):
        own = text[start:end]
        start, end = start + len(own) - len(own.lstrip()), end - (len(own) - len(own.rstrip()))
        if end > start and holds(kind, text[start:end]) and all(end <= s or e <= start for s, _, e in base):
            out.append((start, kind, end))
    return out


def spans_of_texts(texts: list[str], tagger: Tagger) -> list[tuple[list, list]]:
    """Base and added spans of each text; the windows of all texts are decoded together."""
    base, coded = [base_spans(t) for t in texts], [classes_of(t) for t in texts]
    starts = [window_starts(_marks(c, t)) for c, t in zip(coded, texts)]
    if not sum(map(len, starts)):
        return [(b, []) for b in base]
    tags = tagger.decode(np.concatenate([windows_of(c, s) for c, s in zip(coded, starts)]))
    out, at = [], 0
    for text, b, c, s in zip(texts, base, coded, starts):
        out.append((b, added_spans(text, reconcile(len(c), s, tags[at:at + len(s)]), b) if len(s) else []))
        at += len(s)
    return out


def _generated(rng: np.random.Generator) -> tuple[int, str]:
    """Kind and text of one made-up piece of personal data; about half in spellings that the patterns miss."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a, b: "".join(map(chr, rng.integers(97, 123, rng.integers(a, b))))
    kind, odd = int(rng.integers(0, 5)), bool(rng.integers(0, 2))
    if kind == 0:
        at = " @ " if odd else "@"
        return kind, f"{word(2, 9)}{rng.choice(['.', '_', ''])}{rng.choice([number(2), word(2, 7)])}{at}{word(3, 8)}{rng.choice(['', number(1)])}.{rng.choice(['example', 'com', 'org', 'net'])}"
    if kind == 1:
        return kind, (" . " if odd else ".").join(map(str, rng.integers(1, 256, 4)))
    if kind == 2:
        d = number(15)
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return kind, rng.choice([".", "/", "_"]).join(d[i:i + 4] for i in range(0, 16, 4)) if odd else rng.choice([d, "-".join(d[i:i + 4] for i in range(0, 16, 4))])
    if kind == 3:
        return kind, (f"00{number(2)} {number(3)} {number(3)} {number(4)}" if rng.integers(0, 2) else f"({number(3)}) {number(3)}-{number(4)}") if odd else f"+{rng.integers(1, 10)} ({number(3)}) {number(3)}-{number(4)}"
    key = "".join(rng.choice(list("0123456789abcdef"), rng.integers(16, 36)))
    return kind, rng.choice([f"password={key[:18]}", f'token = "{key}"', f"secret: {key}", f"api_key={key}"])


def _tags(text: str, spans) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for start, kind, end in spans:
        out[start:end] = 2 * kind + 2
        out[start] = 2 * kind + 1
    return out


def labelled(excerpts: list[str], seed: int = 11) -> list[tuple[str, list]]:
    """Texts with labelled spans: the excerpts as they are, and each with generated data written between words."""
    rng, out = np.random.default_rng(seed), []
    plain = [x for x in excerpts if x] or ["the quick brown fox jumps over a lazy dog and goes home again in 12 days "] * 40
    for text in plain:
        spans = [s for s in base_spans(text)]
        spans += [(m.start(), 4, m.end()) for m in _SECRET.finditer(text) if all(m.end() <= s or e <= m.start() for s, _, e in spans)]
        out.append((text, sorted(spans)))
    for k in range(max(300, len(plain))):
        text = plain[k % len(plain)]
        gaps = [i for i, c in enumerate(text) if c == " "] or [len(text)]
        parts, spans, at, size = [], [], 0, 0
        for cut in sorted({int(rng.choice(gaps)) for _ in range(2)}):
            kind, made = _generated(rng)
            lead = re.sub(r"[0-9@]", "x", text[at:cut]) + " "
            parts += [lead, made]
            spans.append((size + len(lead), kind, size + len(lead) + len(made)))
            size, at = size + len(lead) + len(made), cut
        out.append(("".join(parts) + re.sub(r"[0-9@]", "x", text[at:]), spans))
    return out


def training_windows(texts: list[tuple[str, list]]) -> tuple[np.ndarray, np.ndarray]:
    windows, tags = [], []
    for text, spans in texts:
        c = classes_of(text)
        starts = window_starts(_marks(c, text))
        if len(starts):
            windows.append(windows_of(c, starts))
            tags.append(windows_of(_tags(text, spans), starts))
    return np.concatenate(windows), np.concatenate(tags)


def sample_excerpts(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Excerpts around the first digit or @ of at most ``rows`` texts, out of about LOOK * ``rows`` by a hash."""
    steps = 1 << 30
    few = max(1, int(steps * min(1.0, LOOK * rows / max(1, docs.count()))))
    docs = docs.where(F.pmod(F.xxhash64(text), F.lit(steps)) < few)
    around = rf"(?s).{{0,{EXCERPT // 3}}}[0-9@].{{0,{EXCERPT // 3 * 2}}}"
    found = docs.select(F.col(text).alias("t")).where(F.col("t").rlike("[0-9@]")).select(
        F.regexp_extract("t", around, 0).alias("t"))
    return [r[0] for r in found.orderBy(F.xxhash64("t"), "t").limit(rows).collect()]


def train(docs: DataFrame, text: str = "text") -> Tagger:
    tagger = Tagger(2 * len(KINDS) + 1)
    tagger.fit(*training_windows(labelled(sample_excerpts(docs, text))))
    return tagger


def _marked_texts(batch, at: int):
    """Per slice of rows: texts, by row number, that hold a digit or an @."""
    data, offsets = arrow_text(batch.column(at))
    for lo, hi in row_slices(offsets):
        part = data[offsets[lo]:offsets[hi]]
        marks = np.flatnonzero((part == 64) | ((part >= 48) & (part <= 57)))
        rows = np.unique(np.searchsorted(offsets, marks + offsets[lo], "right") - 1).tolist()
        yield lo, hi, rows, [data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "surrogatepass") for r in rows]


def written_out(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _digests(tagger: Tagger, batches):
    import pyarrow as pa

    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for lo, hi, rows, texts in _marked_texts(batch, 1):
            counts = np.zeros((4, hi - lo), np.int64)
            sums, spans = [empty] * (hi - lo), [""] * (hi - lo)
            for r, (base, more) in zip(rows, spans_of_texts(texts, tagger)):
                for _, kind, _ in base + more:
                    if kind < 4:
                        counts[kind, r - lo] += 1
                sums[r - lo] = hashlib.sha256(written_out(base).encode()).hexdigest()
                spans[r - lo] = written_out(base + more)
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *map(pa.array, counts), pa.array(sums), pa.array(spans)],
                                  names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find_pii(docs: DataFrame, tagger: Tagger | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of spans per kind, hash of the base spans, and all spans as kind:start:end (code points)."""
    tagger = tagger or train(docs, text)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        partial(_digests, tagger), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_email long, n_ip long, "
        "n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans) -> str:
    """The text with each span as ``<KIND>``; of overlapping spans the first stands for all."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _masked_rows(tagger: Tagger, text_at: int, count_at: int | None, batches):
    import pyarrow as pa

    for batch in batches:
        for lo, hi, rows, texts in _marked_texts(batch, text_at):
            own = batch.slice(lo, hi - lo)
            changed = {r - lo: masked(t, base + more) for r, t, (base, more) in zip(rows, texts, spans_of_texts(texts, tagger))
                       if base or more}
            if changed:
                columns = own.columns
                text = columns[text_at].to_pylist()
                for r, t in changed.items():
                    text[r] = t
                columns[text_at] = pa.array(text, columns[text_at].type)
                if count_at is not None:
                    count = columns[count_at].to_pylist()
                    for r, t in changed.items():
                        count[r] = len(t)
                    columns[count_at] = pa.array(count, columns[count_at].type)
                own = pa.record_batch(columns, schema=own.schema)
            yield own


def mask_pii(docs: DataFrame, tagger: Tagger | None = None, text: str = "text", count: str = "n_chars") -> DataFrame:
    """The same rows and columns with the spans masked; ``count``, where there is such a column, follows the text."""
    tagger = tagger or train(docs, text)
    names = docs.columns
    return docs.mapInArrow(partial(_masked_rows, tagger, names.index(text), names.index(count) if count in names else None),
                           docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is masked."""
    return mask_pii(docs)
