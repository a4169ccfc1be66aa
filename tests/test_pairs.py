"""Pairs by blocks: directions bounded by pivots, communities of one large cluster."""

from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agoraflow.functions.vectors import l2_normalise
from agoraflow.operators import graph, similarity


def directions(n, d=16, clusters=12, spread=0.15, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (clusters, d))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    v = middle[rng.integers(0, clusters, n)] + rng.normal(0, spread / np.sqrt(d), (n, d))
    return v * rng.uniform(0.5, 2, (n, 1))


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.5])
def test_cosine_pairs_equal_all_pairs(spark, threshold):
    v = directions(300)
    v[:40] = v[0]  # copies: a ring that is dealt into pieces
    v[41] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "v": v.tolist()}))
    got = {(r.a_id, r.b_id): r.similarity for r in similarity.cosine_pairs(df, threshold, ["id"], "v", block_rows=16).collect()}
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    cos = unit @ unit.T
    sure = {(i, j) for i, j in combinations(range(300), 2) if cos[i, j] >= threshold + 1e-9}
    maybe = {(i, j) for i, j in combinations(range(300), 2) if cos[i, j] >= threshold - 1e-9}
    with_zero = {(i, j) for i, j in maybe if 41 in (i, j)}  # a zero vector has no direction: either answer will do
    assert sure - with_zero <= set(got) | with_zero and set(got) <= maybe
    assert all(abs(got[p] - cos[p]) < 1e-9 for p in got)


def test_far_blocks_are_not_paired(spark):
    v = directions(2000)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "v": v.tolist()}))
    rows = df.select("id", l2_normalise(F.col("v")).alias("_unit"))
    blocked, pairs = similarity.block_pairs(rows, 0.9, ["id"], 64)
    blocks = blocked.select("_block").distinct().count()
    assert blocks >= 2000 / 64 and blocked.groupBy("_block").count().agg(F.max("count")).first()[0] < 200
    assert pairs.count() < 0.35 * blocks * (blocks + 1) / 2
    assert pairs.distinct().count() == pairs.count()


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert similarity.cosine_pairs(df, 0.5, ["id"], "v").count() == 0


def test_shared_groups_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"m{rng.randrange(120)}", rng.randrange(25)) for _ in range(900)] + [(None, 1), ("m1", None), ("alone", 99)]
    sets = spark.createDataFrame(rows, "who string, what long")
    by = {}
    for who, what in rows:
        if who is not None and what is not None:
            by.setdefault(what, set()).add(who)
    want = Counter(p for members in by.values() for p in combinations(sorted(members), 2))
    for block in (13, 2048):
        got = graph.shared_group_counts(sets, "who", "what", block).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.n for r in got} == want


def test_one_cluster_with_thousands_of_communities(spark):
    sets = spark.range(5000).selectExpr("concat('c', id) as subreddit", "0 as cluster_id")
    none = spark.createDataFrame([], "subreddit_1 string, subreddit_2 string")
    counts = graph.shared_group_counts(sets, "subreddit", "cluster_id", 500)
    assert counts.agg(F.count("*"), F.min("n"), F.max("n")).first() == (5000 * 4999 // 2, 1, 1)
    # the cluster is worked on by many tasks
    assert counts.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4
    assert graph.community_pairs(none, sets.limit(300)).count() == 300 * 299 // 2


def test_rows_are_sent_once_per_tile(spark):
    """Directions all alike, so every pair of small blocks is multiplied: what is shuffled must not grow with their number."""
    v = np.random.default_rng(3).normal(0, 1, (1500, 16))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1500), "v": v.tolist()}))
    blocked, near = similarity.block_pairs(df.select("id", l2_normalise(F.col("v")).alias("_unit")), 0.3, ["id"], 16)
    tiles = similarity._tiles(blocked)
    names = {r._block: r._tile for r in tiles.collect()}
    blocks = blocked.select("_block").distinct().count()
    busy = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
    assert len(names) == blocks > 90 and busy - 1 <= len(set(names.values())) <= busy + 1
    pairs = similarity.cosine_pairs(df, 0.3, ["id"], "v", block_rows=16)
    assert near.count() > blocks * (blocks + 1) / 4
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert pairs.select("a_id", "b_id").distinct().count() == pairs.count() == int(np.triu(unit @ unit.T >= 0.3, 1).sum())
