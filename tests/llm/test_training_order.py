"""The permutation, the shards and the reader against the tokenizer library."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from agoraflow.llm import bpe
from agoraflow.llm import training_order as order
from agoraflow.llm.common import table
from agoraflow.llm.queries import QUERIES

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [None, "", " ", "   a  b ", "word " * 5000, "▁▁ x", "é漢🙂\x00\n\n", "same", "same", "tail  "]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_feistel_is_a_bijection(n):
    slots = order.feistel(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 64 or (slots != order.feistel(np.arange(n), n, 8)).any()


def test_feistel_mixes():
    slots = order.feistel(np.arange(50_000), 50_000, 1)
    assert abs(np.corrcoef(np.arange(50_000), slots)[0, 1]) < 0.02
    assert abs(np.corrcoef(slots[:-1], slots[1:])[0, 1]) < 0.02


@pytest.fixture(scope="module")
def encode():
    with open(FILE, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: library.encode_ordinary(text or "") + [50256]


def rebuild(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk)):
        out.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist())
    return out


def test_round_trip_and_reader(spark, tmp_path, encode):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, task int")
    path = str(tmp_path / "out")
    order.write_training_order(docs, path, FILE, PATTERN, sequence=16, stride=10)
    shards = spark.read.parquet(path)
    rows = order.records(shards).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert rebuild(rows) == {i: encode(t) for i, t in enumerate(TEXTS)}
    for r in shards.collect():
        assert r.first_slot == r.shard * 10 and len(r.data) == r.n_slots * r.record_bytes == r.n_slots * (16 + 32)
    part = order.read_slots(shards, 25, 30, stride=10).collect()
    assert [r.slot for r in part] == list(range(25, 55))
    whole = {r.slot: r for r in rows}
    assert all(whole[r.slot] == r for r in part)


def test_query(spark, sf_dir, encode):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op1_training_order"](spark, sf_dir).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        assert (r.shard, r.byte_offset) == (r.slot // order.STRIDE, r.slot % order.STRIDE * (16 + 2 * order.SEQUENCE))
    assert got == {d: len(encode(t)) for d, t in texts.items()}


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [r.doc_id for r in order.records(order.training_order(docs, FILE, PATTERN)).collect()] == [-1]
    assert order.training_order(docs.limit(0), FILE, PATTERN).count() == 0
