"""Schemas of the stage inputs and outputs; readers never infer."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)

COMMENTS = (
    StructType()
    .add("id", StringType())
    .add("subreddit", StringType())
    .add("body", StringType())
    .add("link_id", StringType())
    .add("parent_id", StringType())
    .add("created_utc", LongType())
    .add("score", LongType())
    .add("author", StringType())
    .add("subreddit_id", StringType())
    .add("retrieved_on", LongType())
)

POSTS = (
    StructType()
    .add("id", StringType())
    .add("subreddit", StringType())
    .add("title", StringType())
    .add("selftext", StringType())
    .add("url", StringType())
    .add("created_utc", LongType())
    .add("num_comments", LongType())
    .add("score", LongType())
    .add("author", StringType())
    .add("subreddit_id", StringType())
    .add("over_18", BooleanType())
    .add("retrieved_on", LongType())
)

INGEST_STATE = (
    StructType()
    .add("filepath", StringType(), False)
    .add("last_line", LongType())
    .add("status", StringType())
    .add("updated_at", TimestampType())
)

WHITELIST = StructType().add("subreddit", StringType())
TERMS = StructType().add("term", StringType()).add("pattern", StringType())

VECTORS = (
    StructType()
    .add("id", StringType())
    .add("type", StringType())
    .add("vector", ArrayType(FloatType()))
)

POINTS_3D = (
    StructType()
    .add("id", StringType())
    .add("x", FloatType())
    .add("y", FloatType())
    .add("z", FloatType())
    .add("type", StringType())
)

CLUSTER_ASSIGNMENTS = (
    StructType().add("id", StringType()).add("type", StringType()).add("cluster_id", IntegerType())
)

COMBINED = (
    StructType()
    .add("id", StringType())
    .add("type", StringType())
    .add("x", DoubleType())
    .add("y", DoubleType())
    .add("z", DoubleType())
    .add("cluster_id", IntegerType())
    .add("subreddit", StringType())
    .add("text", StringType())
)

SUBREDDIT_CENTROIDS = (
    StructType()
    .add("scope_type", StringType())
    .add("scope_value", StringType())
    .add("topic_id", IntegerType())
    .add("n_docs", LongType())
    .add("centroid", ArrayType(DoubleType()))
)

CLUSTER_CENTROIDS = (
    StructType(list(SUBREDDIT_CENTROIDS.fields))
    .add("cluster_id", IntegerType())
    .add("top_subreddits", ArrayType(StringType()))
)

EDGES = (
    StructType()
    .add("source_scope", StringType())
    .add("source_value", StringType())
    .add("source_topic", IntegerType())
    .add("target_scope", StringType())
    .add("target_value", StringType())
    .add("target_topic", IntegerType())
    .add("similarity", DoubleType())
)

TOPIC_WORDS = (
    StructType()
    .add("scope_type", StringType())
    .add("scope_value", StringType())
    .add("topic_id", IntegerType())
    .add("rank", IntegerType())
    .add("word", StringType())
    .add("weight", DoubleType())
)

PAIR_SIMILARITY = (
    StructType()
    .add("subreddit_1", StringType())
    .add("subreddit_2", StringType())
    .add("combined_score", DoubleType())
    .add("shared_topics", LongType())
    .add("shared_clusters", LongType())
)

TOPIC_DETAILS = (
    StructType()
    .add("model_type", StringType())
    .add("model_name", StringType())
    .add("topic_id", IntegerType())
    .add("document_count", LongType())
    .add("top_words", StringType())
)

BY_KIND = {"comments": COMMENTS, "posts": POSTS}


def with_tokens(schema: StructType) -> StructType:
    """The tokenized form of a content schema: same columns plus ``tokens``."""
    return StructType(list(schema.fields)).add("tokens", ArrayType(IntegerType()))
