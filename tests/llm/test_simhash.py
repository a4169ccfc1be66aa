"""SimHash classes against all pairs, and against rows with nulls, ties and repeats."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from agoraflow.llm import simhash
from agoraflow.llm.common import table
from agoraflow.llm.queries import QUERIES


def slow_fingerprint(text, width=3):
    if text is None:
        return 0
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[root(i)] = min(d, first.get(root(i), d))
    return sorted(((d, f"{fps[i]:016x}", first.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = sorted(map(tuple, QUERIES["op2_simhash_anchors"](spark, sf_dir).collect()), key=str)
    assert got == slow_classes(rows)


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    y = x.copy()
    for k in range(3):
        flip = np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
        y = (y.view(np.uint64) ^ np.where(rng.random(len(x)) < 0.8, flip, np.uint64(0))).view(np.int64)

    def met(v):
        index, anchor = simhash.anchors_of(v)
        out = [set() for _ in v]
        for i, a in zip(index, anchor):
            out[i].add(a)
        return out

    assert all(a & b for a, b in zip(met(x), met(y)))


CASES = [
    (1, "a b c d e f g h"),
    (2, "A B c d e f g H"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "one"),
    (6, "one"),
    (None, "a b c d e f g h"),
    (None, "alone here"),
    (7, "é " * 5000 + "x"),
    (8, "é " * 5001 + "x"),
]


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(d, t, "x", 1) for d, t in CASES], "doc_id long, text string, fingerprint string, component_id int"
    )
    got = sorted(
        ((r.doc_id, f"{r.fingerprint & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicate_classes(docs).collect()),
        key=str,
    )
    assert got == slow_classes(CASES)
    kept = simhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id is not null").collect()) == [
        (1, "a b c d e f g h"),
        (3, None),
        (6, "one"),
        (7, "é " * 5000 + "x"),
    ]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_classes(docs).count() == 0
    assert simhash.keep_one_per_class(docs).count() == 0


def test_large_anchor_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))}
    fps = [f - 2**64 if f >= 2**63 else f for f in fps]
    marked = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fingerprint long")
    found = {r.fingerprint: r.component_id for r in simhash.classes(marked, "doc_id").collect()}
    arr = np.array(fps, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None]) <= 3
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        label = np.where(near, label[None], len(fps)).min(axis=1)
    assert [found[f] for f in fps] == label.tolist()


def test_threshold_is_checked(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fingerprint long"), 4)


def test_anchors_are_not_broadcast(spark):
    """The rows of an anchor are 33 times the fingerprints, which the planner does not see: they are merged at any size."""
    distinct = spark.range(2000).selectExpr("xxhash64(id) as fingerprint").union(spark.sql("select xxhash64(7L) + 1 as fingerprint"))
    found = simhash.links(distinct)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    seven = spark.sql("select xxhash64(7L)").first()[0]
    assert {frozenset(r) for r in found.collect()} == {frozenset((seven, seven + 1))}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
