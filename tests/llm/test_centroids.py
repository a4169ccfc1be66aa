"""Centroid clustering by lookup tables against plain integer arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from agoraflow.llm import centroids


def brute(rows, k, rounds, scale):
    """Python integers, one distance at a time."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((x - c) ** 2 for x, c in zip(v, m)) for m in middle]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(middle)):
            mine = [v for (_, v), (a, _) in zip(kept, found) if a == c]
            if mine:
                middle[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, c, d) for (i, _), (c, d) in zip(kept, assign())], middle


@pytest.mark.parametrize("spread", [1.0, 60_000.0])
def test_against_brute_force(spark, spread):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.4) * spread / 5.0 for _ in range(6)]) for i in range(300)]
    rows += [(7, rows[7][1]), (301, rows[0][1]), (302, rows[0][1])]  # repeated rows, equal vectors
    rows = [(i, [max(-spread, min(spread, x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got, middle = centroids.cluster(df, k=7, rounds=4, dims=6, scale=1024)
    want, want_middle = brute(rows, 7, 4, 1024)
    out = got.collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in out) == sorted(want)
    assert middle.tolist() == want_middle
    total = sum(d for _, _, d in want)
    for r in out:
        assert r.inertia == total and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want_middle[r.cluster])).encode()).hexdigest()


def test_tables_give_distances():
    rng = np.random.default_rng(1)
    for span in (10, 10_000_000):
        ints = rng.integers(-span, span, (500, 9))
        middle = rng.integers(-span, span, (6, 9))
        plain = ((ints[:, None, :] - middle[None]) ** 2).sum(axis=2)
        best, distance = centroids.nearest(ints, middle)
        assert (best == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
        values, codes = centroids.occurring(ints[:, 0])
        assert (values[codes] == ints[:, 0]).all() and set(values) == set(ints[:, 0])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [5.0, 5.0]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [1.0, None]), (7, [1.0]),
            (8, []), (9, None), (2, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, cluster string, `a.b` int")
    got, middle = centroids.cluster(df, k=3, rounds=2, dims=2)
    assert got.columns == ["vec_id", "embedding", "a.b", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    out = got.collect()
    assert sorted((r.vec_id or 0, list(r.embedding)) for r in out) == [(0, [5.0, 5.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    assert len(middle) == 3
    # equal first centroids: the smaller number takes the vectors, the other stays where it is
    same = df.filter("vec_id = 2")
    got, middle = centroids.cluster(same, k=8, rounds=2, dims=2)
    assert middle.tolist() == [[1024, 1024]] * 2 and {r.cluster for r in got.collect()} == {0}


def test_none_kept(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    got, middle = centroids.cluster(df, dims=2)
    assert got.count() == 0 and middle.shape == (0, 2)
    assert got.columns == ["vec_id", "embedding", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_beyond_the_limit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(df, dims=1)
