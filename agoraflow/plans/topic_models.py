"""Topics of clusters and communities, all scopes in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraflow.functions.scale import materialize
from agoraflow.operators import aggregates as agg
from agoraflow.operators import topics
from agoraflow.operators.combine import fetch_vectors
from agoraflow.operators.hierarchy import density_cluster
from agoraflow.operators.filters import exclude_noise, min_group_size
from agoraflow.operators.projection import fit_projection, project_all
from agoraflow.operators.tokens import ngram_counts

SCOPE = ("scope_type", "scope_value")

# fixed values: documents a scope needs, dimensions topics are found in
MIN_DOCS = 100
TOPIC_DIMENSIONS = 5


@dataclass
class TopicModels:
    """Tables of one modelling run, each keyed by (scope_type, scope_value, topic_id)."""

    membership: DataFrame
    centroids: DataFrame
    words: DataFrame
    info: DataFrame


def scoped_documents(
    docs: DataFrame, n_clusters: int | None = None, n_communities: int | None = None, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Documents of clusters and communities, one row per scope they belong to.

    Every scope of ``min_docs`` documents or more, noise left out; ``n_clusters`` and
    ``n_communities`` keep only the largest ones.
    """
    columns = ["type", "id", "cluster_id", "subreddit", "text"]
    clustered = exclude_noise(docs)
    if n_clusters is not None:
        clustered = clustered.join(agg.top_clusters(docs, n_clusters).select("cluster_id"), "cluster_id", "left_semi")
    placed = docs
    if n_communities is not None:
        placed = docs.join(agg.top_subreddits(docs, n_communities).select("subreddit"), "subreddit", "left_semi")
    by_cluster = clustered.select(
        F.lit("cluster").alias("scope_type"), F.col("cluster_id").cast("string").alias("scope_value"), *columns
    )
    by_community = placed.select(
        F.lit("subreddit").alias("scope_type"), F.col("subreddit").alias("scope_value"), *columns
    )
    return min_group_size(by_cluster.unionByName(by_community), SCOPE, min_docs)


def assign_topics(
    scoped: DataFrame,
    dims: int = TOPIC_DIMENSIONS,
    min_cluster_size: int = 20,
    min_samples: int = 10,
) -> DataFrame:
    """Add ``topic_id`` to scoped documents with vectors; -1 is noise.

    One projection serves all scopes; the density clusters are found per scope
    with the scope as an extra key.
    """
    axes = [f"p{i}" for i in range(dims)]
    model = fit_projection(scoped, dims, keys=(*SCOPE, "type", "id"), balance_by=None)
    placed = project_all(model, scoped, axes=axes, keep=[*SCOPE, "type", "id"])
    placed = placed.withColumn("key", F.concat_ws(":", "type", "id"))
    labelled = density_cluster(
        placed, min_cluster_size, min_samples, axes, SCOPE, "key", out="topic_id"
    ).select(*SCOPE, "type", "id", "topic_id")
    return scoped.join(labelled, [*SCOPE, "type", "id"])


def scope_models(
    docs: DataFrame,
    vectors: DataFrame,
    n_clusters: int | None = None,
    n_communities: int | None = None,
    min_docs: int = MIN_DOCS,
    min_cluster_size: int = 20,
    min_samples: int = 10,
    stop_words: Sequence[str] | None = None,
    top_n: int = topics.TOP_WORDS,
) -> TopicModels:
    """Model every selected scope that has enough documents and enough vectors."""
    scoped = scoped_documents(docs, n_clusters, n_communities, min_docs)
    with_vectors = materialize(min_group_size(fetch_vectors(scoped, vectors), SCOPE, min_docs))
    members = materialize(
        assign_topics(with_vectors, min_cluster_size=min_cluster_size, min_samples=min_samples)
    )
    weights = topics.class_tfidf(materialize(ngram_counts(members, stop_words=stop_words)))
    words = materialize(topics.top_words(weights, top_n))
    membership = members.drop("vector", "text")
    return TopicModels(
        membership=membership,
        centroids=agg.topic_centroids(members),
        words=words,
        info=topics.topic_info(membership, words),
    )


def cluster_centroid_table(models: TopicModels, docs: DataFrame) -> DataFrame:
    """Centroids of cluster topics with the cluster id and its five largest communities."""
    top = agg.top_communities_per_cluster(docs)
    rows = models.centroids.filter("scope_type = 'cluster'").withColumn(
        "cluster_id", F.col("scope_value").cast("int")
    )
    return rows.join(top, "cluster_id", "left")
