"""Shards: whole, even, gapless, repeatable and shuffled."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from agoraflow.llm import sharding
from agoraflow.llm.common import table
from agoraflow.llm.queries import QUERIES


def check_law(rows, shards, n):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(rows) == n and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op5_external_shuffle"](spark, sf_dir).collect()
    check_law(rows, 8, len(docs))
    for r in rows:
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)


def test_order_does_not_depend_on_the_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(docs, 8).collect()}
    two = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(docs.repartition(17), 8).collect()}
    other = {(r.doc_id, r.shard, r.slot) for r in sharding.assign_shards(docs, 8, seed=8).collect()}
    assert one == two != other


def test_places_are_uniform(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    shuffled, n = sharding.shuffle_rows(docs)
    rows = shuffled.collect()
    assert sorted(r.position for r in rows) == list(range(n))
    place = np.array([r.position for r in sorted(rows, key=lambda r: r.doc_id)])
    assert abs(np.corrcoef(np.arange(n), place)[0, 1]) < 0.06
    assert abs(np.corrcoef(place[:-1], place[1:])[0, 1]) < 0.06


@pytest.mark.parametrize("bucket_bytes", [8 << 20, 40])
def test_odd_rows(spark, bucket_bytes):
    rows = [(1, "a"), (None, "b"), (2, None), (3, ""), (3, ""), (4, "x" * 50_000)] + [(9, "same")] * 300
    docs = spark.createDataFrame([(d, t, "own", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, shard string, other int")
    got = sharding.assign_shards(docs, 4, bucket_bytes=bucket_bytes)
    assert got.columns == ["doc_id", "text", "other", "shard", "slot"]
    out = got.collect()
    check_law(out, 4, len(rows))
    assert sorted(r.other for r in out) == list(range(len(rows)))


def test_fewer_rows_than_shards_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    check_law(sharding.assign_shards(docs, 8).collect(), 8, 2)
    assert sharding.assign_shards(docs.limit(0), 8).count() == 0


def test_write(spark, tmp_path):
    docs = spark.range(100).selectExpr("id as doc_id", "repeat('t', 10) as text")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {r.shard for r in back.collect()} == {0, 1, 2}
