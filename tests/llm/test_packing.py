import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldmark.llm import packing as P
from helpers import awkward, documents, prose

JSON, RANKS = (str(public_tokenizers.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
TOKENIZER, ENCODER = Tokenizer.from_file(JSON), P.Encoder(JSON, RANKS)


def ids_of(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1], np.uint32)


def encoded(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    ids, count = ENCODER.texts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])) | st.text("   　\u0085 a'stB1.é\n\t"), min_size=1, max_size=4))
def test_chunks_give_the_ids_of_the_whole_text(texts):
    texts = [t.replace("<|endoftext|>", "") for t in texts]
    assert encoded(texts) == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_restore_every_document(spark):
    texts = awkward() + [prose(n, n) for n in range(10, 400, 7)] + ["a <|endoftext|> b", prose(2500, 4)]
    rows = P.pack(documents(spark, texts)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, pieces in by_doc.items():
        ids, at = ids_of(texts[i]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= P.LENGTH and len(pieces) <= P.MAX_SEGMENTS
    total = sum(r.length for r in rows)
    assert len(by_sequence) * P.LENGTH - total < P.LENGTH  # one group: only its last sequence is padded


def test_limits_hold_at_once():
    sizes = np.random.default_rng(1).integers(1, 100, 500)
    for limits in ((100, 4, 99), (100, 50, 60), (100, 3, 70)):
        taken = defaultdict(int)
        for mine in P.fill_sequences(sizes, limits):
            length = [b - a for _, a, b in mine]
            assert sum(length) <= limits[0] and len(mine) <= limits[1] and sum(x - 1 for x in length) <= limits[2]
            for item, a, b in mine:
                taken[item] += b - a
        assert [taken[k] for k in range(500)] == sizes.tolist()


def test_limits_hold_with_prompts():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 400)
    lead = np.minimum(sizes, rng.integers(1, 60, 400))
    for limits in ((100, 4, 99), (100, 50, 20), (100, 8, 1)):
        taken = defaultdict(int)
        sequences = P.fill_sequences(sizes, limits, lead)
        for mine in sequences:
            bear = sum(max(0, b - max(a + 1, int(lead[i]))) for i, a, b in mine)
            assert mine and sum(b - a for _, a, b in mine) <= limits[0] and len(mine) <= limits[1] and bear <= limits[2]
            for item, a, b in mine:
                assert a == taken[item]
                taken[item] = b
        assert [taken[k] for k in range(400)] == sizes.tolist()


def test_loss_limit_binds_inside_pack(spark):
    """Whole documents of prompt and answer: each sequence's loss, counted token by token, is within the limit."""
    texts = [prose(n, n) for n in (5, 300, 2500, 900, 40, 700)] + [None, prose(1500, 8)]
    prompts = [None, 200, 1500, 0, 10_000, -3, 5, 1490]
    docs = documents(spark, texts)
    asked = spark.createDataFrame(list(enumerate(prompts)), "doc_id long, prompt int")
    rows = P.pack(docs.join(asked, "doc_id"), length=512, max_segments=6, max_loss=150, prompt="prompt").collect()
    bear, held, sums, number = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        lead = prompts[r.doc_id] or 0
        own = sum(at >= lead for at in range(r.start + 1, r.start + r.length))
        assert own == r.loss_tokens
        bear[r.sequence_id] += own
        held[r.sequence_id] += r.length
        number[r.sequence_id] += 1
        sums[r.doc_id] += r.length
    assert max(bear.values()) == 150 and max(held.values()) <= 512 and max(number.values()) <= 6
    assert [sums[k] for k in range(len(texts))] == [len(ids_of(t)) for t in texts]


def test_empty_table(spark):
    assert P.pack(documents(spark, ["a"]).limit(0)).count() == 0
