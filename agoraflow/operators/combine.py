"""Joins that bring coordinates, labels, text, communities and vectors together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraflow.functions.scale import broadcast_checked
from agoraflow.functions.text import comment_text, post_text
from agoraflow.operators.filters import drop_blank_text, fill_unknown
from agoraflow.operators.sampling import sample_n

KEY = ("type", "id")


def whitelist_join(df: DataFrame, whitelist: DataFrame, col: str = "subreddit", list_col: str = "subreddit") -> DataFrame:
    """Keep rows whose lower-cased community is listed; repeated lines do not repeat rows."""
    listed = whitelist.select(F.col(list_col).alias("_listed")).distinct()
    return df.join(
        broadcast_checked(listed), F.lower(F.col(col)) == F.col("_listed"), "left_semi"
    )


def with_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("type", F.lit(kind))


def union_content(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts and comments as one frame of (type, id, subreddit, text)."""
    return posts.select(
        F.lit("post").alias("type"), "id", "subreddit", post_text().alias("text")
    ).unionByName(
        comments.select(F.lit("comment").alias("type"), "id", "subreddit", comment_text().alias("text"))
    )


def coords_with_clusters(coords: DataFrame, assignments: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return coords.join(assignments, list(keys))


def with_community(df: DataFrame, labels: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Left join of community names; rows without one are labelled Unknown."""
    return fill_unknown(df.join(labels.select(*keys, "subreddit"), list(keys), "left"))


def with_text(df: DataFrame, content: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return df.join(content, list(keys))


def fetch_vectors(docs: DataFrame, vectors: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Documents with their vector; documents without one drop out."""
    return docs.join(vectors.select(*keys, "vector"), list(keys))


def combined_dataset(
    coords: DataFrame,
    assignments: DataFrame,
    posts: DataFrame,
    comments: DataFrame,
    sample_size: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """id, type, x, y, z, cluster_id, subreddit, text of every document that has all of them."""
    placed = coords_with_clusters(coords, assignments)
    if sample_size:
        placed = sample_n(placed, sample_size, KEY, seed=seed)
    texts = drop_blank_text(union_content(posts, comments))
    return fill_unknown(with_text(placed, texts)).select(
        "id", "type", "x", "y", "z", "cluster_id", "subreddit", "text"
    )
