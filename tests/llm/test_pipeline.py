import itertools
import zlib

import numpy as np

import corpus_pipeline
from fieldmark.llm import packing, pii
from helpers import awkward, prose, words
from test_ngram_join import brute as groups
from test_packing import ids_of
from test_quality_rules import brute as measures
from test_quality_rules import rejected


def test_run_against_stages_by_hand(spark, tmp_path):
    items = [prose(30, 900), prose(40, 901)]
    texts = awkward() + [prose(60, k) for k in range(12)] + [prose(60, 3) + " tail words", prose(20, 50) + " " + items[0] + " " + prose(20, 51)]
    texts += [prose(50, 60) + " mail me.now@mail.example " + prose(50, 61), "a b c d e f g h " * 30, prose(60, 4)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(i, t) for i, t in enumerate(texts) if not rejected(measures(t))]
    left = [(i, t) for i, t in left if groups(left)[i][1] == i]
    left = [(i, t) for i, t in left if not any(x in " ".join(words(t)).lower() for x in items)]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in left}
    for i, t in left:
        masked = pii.masked(t, pii.base_spans(t))
        ids = ids_of(masked)
        for r in (r for r in rows if r.doc_id == i):
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        own = list(own)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
        assert sum(r.length for r in own) <= packing.LENGTH


def test_stages_keep_columns_of_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, prose(30, 1))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs, str(tmp_path)).count() == 0
