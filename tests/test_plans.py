"""The physical plans: no nested loops, filters in the scan, group limits below the shuffle."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from agoraflow.catalog.fixtures import TERMS, WINDOW, Tables
from agoraflow.functions import scale
from agoraflow.operators import aggregates, combine, density, filters, graph, ranking, sampling, similarity, tokens, topics
from agoraflow.sources import stores


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


def no_loops(df) -> str:
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    return text


def test_time_range_reaches_the_scan(spark, t, tmp_path):
    path = str(tmp_path / "posts")
    t.posts.write.parquet(path)
    text = plan(filters.event_time_range(spark.read.parquet(path), *WINDOW).select("id"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(created_utc,1751328000\).*LessThan\(created_utc", text)
    assert "ReadSchema: struct<id:string,created_utc:bigint>" in text


def test_keyword_filter_is_one_scan_without_shuffle(spark, t, tmp_path):
    path = str(tmp_path / "posts")
    t.posts.write.parquet(path)
    text = no_loops(filters.keyword_filter(spark.read.parquet(path), TERMS, "posts"))
    assert "Exchange" not in text and text.count("FileScan") == 1
    assert text.index("Contains(") < text.index("RLIKE")
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_spread_only_where_a_scan_is_too_narrow(spark, t):
    assert scale.spread(t.raw("documents"), "doc_id").rdd.getNumPartitions() == 8
    wide = spark.range(0, 100, 1, 16)
    assert scale.spread(wide, "id") is wide


def test_whitelist_is_broadcast(t):
    names = t.posts.select("subreddit").distinct()
    assert "BroadcastHashJoin" in no_loops(combine.whitelist_join(t.posts, names))


def test_top_per_group_limits_before_the_shuffle(t):
    rows = sampling.top_per_group(t.posts, 3, ["subreddit"], [F.desc("score"), F.col("id")])
    text = plan(rows)
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert "WindowGroupLimit" in plan(stores.dedup_by_id(t.posts.withColumn("retrieved_on", F.col("score"))))


def test_no_nested_loops_in_pair_operators(t):
    words = t.community_words
    no_loops(similarity.cosine_edges(t.centroids, 0.1))
    no_loops(similarity.shared_topics(words, 0.3))
    no_loops(similarity.shared_topic_counts(words, 0.3))
    no_loops(graph.edge_endpoints(t.edges, t.centroids.withColumns({c: F.lit(0.0) for c in "xyz"})))
    no_loops(graph.topic_overlap_directed(t.edges, 0.2))
    no_loops(aggregates.cluster_community_matrix(t.combined, aggregates.top_clusters(t.combined, 5), aggregates.top_subreddits(t.combined, 5)))
    no_loops(aggregates.summary_statistics(t.combined, t.membership))


def test_no_nested_loops_in_density(t):
    no_loops(density.density_at_eps(t.blob_points, 0.15))
    no_loops(density.knn_core_distance(t.blob_points, 10))


def test_sample_orders_only_what_it_takes(t):
    text = no_loops(sampling.sample_n(t.content.select("type", "id"), 100, ["type", "id"]))
    assert "TakeOrderedAndProject" not in text
    # one task adds up the bucket counts, at most 65,536 rows; rows stay in their bucket
    before_quota = text.split("Exchange SinglePartition")
    assert len(before_quota) == 2 and "HashAggregate(keys=[_bucket" in before_quota[1].split("Exchange")[0]


def test_ranks_have_no_single_partition_sort(t):
    text = no_loops(ranking.frequency_rank(t.posts))
    # the only single-task window adds up one row per range partition
    for window in re.findall(r"Window \[.*", text):
        assert "_part" in window


def test_vector_mean_combines_before_the_shuffle(t):
    text = plan(aggregates.topic_centroids(t.membership))
    assert "partial_" in text and "Generate" not in text


def test_topic_weights_have_no_window_over_a_topic(t):
    counts = scale.materialize(tokens.ngram_counts(t.topic_texts, stop_words=["the"]))
    assert "Window" not in plan(topics.class_tfidf(counts))


@pytest.mark.parametrize("make", [tokens.ngram_counts, tokens.document_terms])
def test_terms_are_computed_once(t, make):
    """No filter on the number of terms computes pattern, stop words and n-grams again below the generator."""
    docs = t.posts.select(F.lit("s").alias("scope_type"), F.lit("v").alias("scope_value"), F.lit(1).alias("topic_id"), F.lit("post").alias("type"), "id", F.col("title").alias("text"))
    text = make(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all(") == 1 and text.count("UDF(") == 3
