"""Invariants on generated and on skewed data, and the stages end to end."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agoraflow.catalog.fixtures import LINK_THRESHOLD, STOP_WORDS, Tables
from agoraflow.functions import vectors as vec
from agoraflow.operators import aggregates, filters, graph, projection, sampling, similarity
from agoraflow.plans import analysis, stages, topic_models
from agoraflow.sources import stores

few = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@few
@given(st.lists(st.lists(st.floats(-5, 5), min_size=3, max_size=3), min_size=2, max_size=6))
def test_cosine_is_symmetric_and_bounded(spark, rows):
    df = spark.createDataFrame([(a, b) for a in rows for b in rows], "a array<double>, b array<double>")
    for r in df.select(vec.cosine(F.col("a"), F.col("b")).alias("x"), vec.cosine(F.col("b"), F.col("a")).alias("y")).collect():
        assert r["x"] == pytest.approx(r["y"], abs=1e-12) and -1 - 1e-9 <= r["x"] <= 1 + 1e-9


@few
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("abcd")), min_size=1, max_size=30))
def test_diversity_is_normalised_entropy(spark, rows):
    got = {r["cluster_id"]: r["diversity"] for r in aggregates.cluster_diversity(spark.createDataFrame(rows, "cluster_id int, subreddit string")).collect()}
    for c in {c for c, _ in rows}:
        counts = Counter(s for x, s in rows if x == c)
        n = sum(counts.values())
        h = -sum(v / n * math.log2(v / n) for v in counts.values())
        assert got[c] == pytest.approx(h / math.log2(len(counts)) if len(counts) > 1 else 0.0, abs=1e-9)
        assert -1e-9 <= got[c] <= 1 + 1e-9


def test_edges_shrink_with_the_threshold(spark, sf_dir):
    t = Tables(spark, sf_dir)
    counts = [similarity.cosine_edges(t.centroids, x).count() for x in (0.1, 0.2, 0.3)]
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1]


def test_projection_keeps_rows_and_distances(spark):
    rng = np.random.default_rng(4)
    flat = np.zeros((60, 6))
    flat[:, :3] = rng.normal(size=(60, 3))  # three dimensions are enough
    df = spark.createDataFrame([("post", str(i), v.tolist()) for i, v in enumerate(flat)], "type string, id string, vector array<double>")
    got = projection.project_all(projection.fit_projection(df), df).toPandas().set_index("id")
    assert len(got) == 60
    p = got.loc[[str(i) for i in range(60)], ["x", "y", "z"]].to_numpy()
    u = flat / np.linalg.norm(flat, axis=1, keepdims=True)
    gap = lambda m: np.linalg.norm(m[:, None] - m[None], axis=2)
    assert np.allclose(gap(p), gap(u), atol=1e-9)


# ---- one key holds a third of all rows ----


@pytest.fixture(scope="module")
def skewed(spark):
    n = 30_000
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 997)).alias("subreddit"),
        F.when(hot, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").alias("retrieved_on"),
        (F.col("id") % 7).cast("int").alias("cluster_id"),
    )


def test_skewed_dedup_and_limits(skewed):
    rows = stores.dedup_by_id(skewed).groupBy().agg(F.count("*"), F.max(F.when(F.col("id") == "copy", F.col("retrieved_on")))).first()
    assert tuple(rows) == (20_001, 29_997)
    top = sampling.top_per_group(skewed, 3, ["subreddit"], [F.desc("retrieved_on")]).filter("subreddit = 'hot'").collect()
    assert sorted(r["retrieved_on"] for r in top) == [29_991, 29_994, 29_997]


def test_skewed_groups_and_counts(skewed):
    kept = filters.min_group_size(skewed, ["subreddit"], 100)
    assert kept.count() == 10_000 and kept.select("subreddit").distinct().count() == 1
    dominant = {r["subreddit"]: tuple(r)[1:] for r in aggregates.dominant_clusters(aggregates.cluster_community_counts(skewed)).collect()}
    pdf = pd.Series([i % 7 for i in range(0, 30_000, 3)]).value_counts()
    best = min(pdf[pdf == pdf.max()].index)
    assert dominant["hot"] == (best, pdf.max(), 10_000)


# ---- stages ----


@pytest.fixture(scope="module")
def modelled(spark, sf_dir):
    from agoraflow.catalog.spatial import _blob_documents

    docs, vectors = _blob_documents(Tables(spark, sf_dir))
    docs = docs.cache()
    models = topic_models.scope_models(docs, vectors, 2, 2, min_docs=50, min_cluster_size=10, min_samples=5, stop_words=STOP_WORDS)
    return docs, models


def test_scope_models_are_consistent(modelled):
    docs, models = modelled
    sizes = {(r["scope_type"], r["scope_value"], r["topic_id"]): r["count"] for r in models.membership.groupBy("scope_type", "scope_value", "topic_id").count().collect()}
    topics_found = {k for k in sizes if k[2] != -1}
    assert Counter(scope for scope, _ in {k[:2] for k in topics_found}) == {"cluster": 2, "subreddit": 2}
    # the vectors have five far directions, so every scope splits into several topics
    assert all(sum(k[:2] == s for k in topics_found) >= 3 for s in {k[:2] for k in topics_found})
    assert all(sizes[k] >= 10 for k in topics_found)
    centroids = {(r["scope_type"], r["scope_value"], r["topic_id"]): r for r in models.centroids.collect()}
    assert set(centroids) == topics_found
    assert all(r["n_docs"] == sizes[k] and abs(np.linalg.norm(r["centroid"]) - 1) < 1e-9 for k, r in centroids.items())
    table = topic_models.cluster_centroid_table(models, docs).collect()
    assert all(1 <= len(r["top_subreddits"]) <= 5 and str(r["cluster_id"]) == r["scope_value"] for r in table)


def test_analysis_reports(spark, modelled, tmp_path):
    docs, models = modelled
    reports = analysis.analysis_reports(docs, models, 3)
    analysis.write_reports(reports, str(tmp_path))
    back = {n: spark.read.option("header", True).csv(str(tmp_path / n)) for n in reports}
    assert back["summary_statistics"].count() == 1
    assert back["topic_overlap_matrix"].count() == 4
    assert back["cluster_subreddit_distribution"].count() == 6
    assert back["subreddit_dominant_topics"].count() == 2
    assert sum(int(r["n"]) for r in back["cluster_subreddit_distribution"].collect()) == docs.count()


def test_network_reports(spark, sf_dir):
    t = Tables(spark, sf_dir)
    reports = stages.network_reports(t.edges, 0.15, LINK_THRESHOLD)
    ranked = [r["n_communities"] for r in reports["bridge_topics_ranked"].collect()]
    assert ranked == sorted(ranked, reverse=True) and ranked[-1] >= 3
    assert all(r["n"] >= 5 for r in reports["community_affinity_network"].collect())
    assert graph.node_degree(reports["community_affinity_network"]).count() > 0


def test_tokenized_stage_keeps_every_document(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = stages.tokenized(t.posts.select("type", "id", "score"), t.content)
    assert rows.count() == t.posts.count() and rows.filter("size(tokens) > 512").count() > 0
