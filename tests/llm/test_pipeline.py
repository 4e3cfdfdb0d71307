"""The whole pipeline against plain versions of its stages, each on its own input."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
from pyspark import TaskContext

import corpus_pipeline
from ledgerlens.llm import token_output
from ledgerlens.llm.runtime import cut
from tests.conftest import SF001

from . import test_decontamination, test_language_id, test_mixing, test_token_output
from .corpora import plain_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_stages(rows, items):
    model = test_language_id.plain_model([r[:4] for r in rows])
    said = [test_language_id.plain_prediction(r[1], *model) for r in rows]
    rows = [r for r, (lang, score) in zip(rows, said) if lang != "und" and score >= 0.5]
    yield rows
    rows = [r for r, (doc_id, _, least) in zip(rows, plain_components(rows)) if doc_id == least]
    yield rows
    dirty = {doc_id for doc_id, _ in test_decontamination.plain(rows, items)}
    rows = [r for r in rows if r[0] not in dirty]
    yield rows
    copies = {key[0]: key[-1] for key in test_mixing.plain([r[:4] for r in rows])}
    rows = [r for r in rows for _ in range(copies.get(r[0], 0))]
    yield rows
    yield test_token_output.expected(rows)


def test_every_stage_equals_its_plain_version(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    rows = [tuple(r[c] for c in COLUMNS) for r in docs.collect()]
    whole = rows_of(corpus_pipeline.run(spark, SF001))
    for k, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, plain_stages(rows, items), strict=True)):
        docs = cut(stage(spark, docs, SF001), name)
        assert rows_of(docs) == sorted(expected, key=str), name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    assert whole == sorted(expected, key=str)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF001), name)
        assert docs.count() == 0


def test_repeated_rows_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs = docs.union(docs).selectExpr("*", "1 AS set_id", "2 AS row", "'x' AS found")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, cut(stage(spark, docs, SF001), name)
        assert docs.columns == columns
    ids = Counter(r.doc_id for r in docs.collect())
    assert max(ids.values()) <= 2


def test_a_tokenizing_worker_stays_small(spark, monkeypatch):
    called = {}
    monkeypatch.setattr(corpus_pipeline, "token_output", lambda spark, docs, **kw: called.update(kw))
    corpus_pipeline.tokens(spark, None, SF001)
    path, vocabulary = token_output.word_bpe()
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    r = random.Random(12)
    texts = [" ".join("".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(500)).encode() for _ in range(1500)]
    batches = [pa.record_batch([pa.array(range(500)), pa.array(texts[i:i + 500], pa.binary())], names=["doc_id", "text"])
               for i in range(0, 1500, 500)]
    write = token_output._blocks(path, token_output.bits_for(vocabulary), token_output.BLOCK_IDS,
                                 called["cache"], called.get("piece_bytes", 2 << 20))
    tracemalloc.start()
    n_ids = sum(block["n_ids"][0].as_py() for block in write(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n_ids > 750_000 and peak < 64e6
