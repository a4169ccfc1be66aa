"""Counts, means and distributions over documents, clusters and communities.

Every aggregate here combines map-side; nothing collects the rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraflow.functions.vectors import l2_normalise
from agoraflow.operators.sampling import head_counts, top_per_group

NOISE = -1


def row_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def cluster_centroids_3d(df: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Mean x, y, z per cluster without noise."""
    return (
        df.filter(F.col(cluster_col) != NOISE)
        .groupBy(cluster_col)
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    )


def cluster_report(df: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Number of clusters, noise rows and their share in percent (one decimal)."""
    noise = F.count_if(F.col(cluster_col) == NOISE)
    return df.agg(
        (F.max(cluster_col) + 1).cast("long").alias("n_clusters"),
        noise.alias("n_noise"),
        F.bround(noise * F.lit(100.0) / F.count("*"), 1).alias("noise_pct"),
    )


def top_clusters(df: DataFrame, n: int = 20, exclude_noise: bool = True, col: str = "cluster_id") -> DataFrame:
    return head_counts(df, col, n, [NOISE] if exclude_noise else [])


def top_subreddits(df: DataFrame, n: int = 50, col: str = "subreddit") -> DataFrame:
    return head_counts(df, col, n, ["Unknown"])


def top_communities_per_cluster(
    df: DataFrame, n: int = 5, cluster_col: str = "cluster_id", community_col: str = "subreddit"
) -> DataFrame:
    """The ``n`` most frequent communities of each cluster as an ordered array."""
    counts = df.groupBy(cluster_col, community_col).agg(F.count("*").alias("_c"))
    ranked = top_per_group(counts, n, [cluster_col], [F.desc("_c"), F.col(community_col)], "_r")
    ordered = F.array_sort(F.collect_list(F.struct("_r", community_col)))
    return ranked.groupBy(cluster_col).agg(
        F.transform(ordered, lambda s: s[community_col]).alias("top_subreddits")
    )


def mean_vector(df: DataFrame, by: Sequence[str], vector_col: str = "vector", out: str = "mean") -> DataFrame:
    """Element-wise mean of an array column per group plus the row count.

    The mean is a mergeable aggregate: map tasks send one partial vector per group.
    """
    return df.groupBy(*by).agg(
        F.count("*").alias("n_docs"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector_col)))).alias(out),
    )


def topic_centroids(
    df: DataFrame, vector_col: str = "vector", scope: Sequence[str] = ("scope_type", "scope_value"), topic_col: str = "topic_id"
) -> DataFrame:
    """Unit-length mean vector and size of each topic; topic -1 is left out."""
    means = mean_vector(df.filter(F.col(topic_col) != NOISE), [*scope, topic_col], vector_col)
    return means.select(*scope, topic_col, "n_docs", l2_normalise(F.col("mean")).alias("centroid"))


def group_totals(df: DataFrame, by: Sequence[str], value: str, out: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(out))


def cluster_community_counts(df: DataFrame) -> DataFrame:
    """Long form of the cluster by community table: only pairs that occur."""
    return df.groupBy("cluster_id", "subreddit").agg(F.count("*").alias("n"))


def dominant_clusters(counts: DataFrame) -> DataFrame:
    """Per community: the cluster with most of its documents, that count, and the total.

    Takes the long form; ties go to the smaller cluster id.
    """
    best = F.max(F.struct(F.col("n"), (-F.col("cluster_id")).alias("neg"))).alias("best")
    return (
        counts.groupBy("subreddit")
        .agg(best, F.sum("n").alias("total_docs"))
        .select(
            "subreddit",
            (-F.col("best.neg")).alias("dominant_cluster"),
            F.col("best.n").alias("cluster_docs"),
            "total_docs",
        )
    )


def cluster_diversity(df: DataFrame, exclude_noise: bool = True) -> DataFrame:
    """Shannon entropy of the community mix of each cluster over its maximum.

    With counts c, sum N and k communities the entropy is
    log2(N) - sum(c log2 c) / N, so two plain group-bys are enough. One community
    gives 0.
    """
    rows = df.filter(F.col("cluster_id") != NOISE) if exclude_noise else df
    counts = cluster_community_counts(rows)
    sums = counts.groupBy("cluster_id").agg(
        F.sum("n").alias("_total"),
        F.sum(F.col("n") * F.log2(F.col("n"))).alias("_nlogn"),
        F.count("*").alias("_k"),
    )
    entropy = F.log2(F.col("_total")) - F.col("_nlogn") / F.col("_total")
    score = F.when(F.col("_k") > 1, entropy / F.log2(F.col("_k"))).otherwise(F.lit(0.0))
    return sums.select("cluster_id", score.alias("diversity"))


def cluster_community_matrix(df: DataFrame, clusters: DataFrame, communities: DataFrame) -> DataFrame:
    """Counts of selected clusters with selected communities, for the pairs that occur.

    Documents are counted first; the selections then only filter the counts. A pair
    without a row is a zero.
    """
    return (
        cluster_community_counts(df)
        .join(clusters.select("cluster_id"), "cluster_id", "left_semi")
        .join(communities.select("subreddit"), "subreddit", "left_semi")
        .select("cluster_id", "subreddit", "n")
    )


def widen_matrix(long: DataFrame, communities: Sequence[str]) -> DataFrame:
    """Wide form of the matrix with one column per selected community."""
    return long.groupBy("cluster_id").pivot("subreddit", list(communities)).agg(F.sum("n")).fillna(0)


def subreddit_cluster_distribution(df: DataFrame) -> DataFrame:
    """Documents of each community per cluster."""
    return df.groupBy("subreddit", "cluster_id").agg(F.count("*").alias("n"))


def cluster_subreddit_distribution(df: DataFrame) -> DataFrame:
    """Documents of each cluster per community, noise included."""
    return cluster_community_counts(df)


def top_columns_by_total(long: DataFrame, n: int = 15) -> DataFrame:
    """The communities with the largest column totals of a matrix."""
    return (
        long.groupBy("subreddit")
        .agg(F.sum("n").alias("total"))
        .orderBy(F.desc("total"), "subreddit")
        .limit(n)
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    """Distinct clusters (without noise), communities and kinds."""
    return df.agg(
        F.countDistinct(F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))).alias("unique_clusters"),
        F.countDistinct("subreddit").alias("unique_subreddits"),
        F.countDistinct("type").alias("unique_types"),
    )


def topics_per_model(topics: DataFrame, scope: Sequence[str] = ("scope_type", "scope_value")) -> DataFrame:
    """Number of topics of each scope without the noise topic."""
    return (
        topics.filter(F.col("topic_id") != NOISE)
        .groupBy(*scope)
        .agg(F.countDistinct("topic_id").alias("n_topics"))
    )


SUMMARY_COLUMNS = (
    "total_documents",
    "unique_clusters",
    "unique_subreddits",
    "clusters_modeled",
    "subreddits_modeled",
    "topics_from_clusters",
    "topics_from_subreddits",
    "total_topics",
    "noise_points",
)


def summary_statistics(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """Nine metrics in one row: one pass over documents and one over topics."""
    of_docs = docs.agg(
        F.count("*").alias("total_documents"),
        F.countDistinct(F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))).alias("unique_clusters"),
        F.countDistinct("subreddit").alias("unique_subreddits"),
        F.count_if(F.col("cluster_id") == NOISE).alias("noise_points"),
    )
    per_model = topics_per_model(topics)
    is_cluster = F.col("scope_type") == "cluster"
    of_topics = per_model.agg(
        F.count_if(is_cluster).alias("clusters_modeled"),
        F.count_if(~is_cluster).alias("subreddits_modeled"),
        F.coalesce(F.sum(F.when(is_cluster, F.col("n_topics"))), F.lit(0)).alias("topics_from_clusters"),
        F.coalesce(F.sum(F.when(~is_cluster, F.col("n_topics"))), F.lit(0)).alias("topics_from_subreddits"),
        F.coalesce(F.sum("n_topics"), F.lit(0)).alias("total_topics"),
    )
    both = of_docs.unionByName(of_topics, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in SUMMARY_COLUMNS])


def dominant_topics(details: DataFrame) -> DataFrame:
    """Per community model: the topic with most documents, and its share of the total."""
    from agoraflow.functions.text import drop_first_prefix

    rows = details.filter(F.col("model_type") == "subreddit").withColumn(
        "subreddit", drop_first_prefix(F.col("model_name"))
    )
    best = F.max(
        F.struct(
            F.col("document_count"),
            (-F.col("topic_id")).alias("neg"),
            F.col("top_words"),
        )
    ).alias("best")
    return (
        rows.groupBy("subreddit")
        .agg(best, F.sum("document_count").alias("subreddit_total_docs"))
        .select(
            "subreddit",
            (-F.col("best.neg")).alias("dominant_topic_id"),
            F.col("best.document_count").alias("topic_doc_count"),
            "subreddit_total_docs",
            F.bround(
                F.col("best.document_count") / F.col("subreddit_total_docs") * 100, 1
            ).alias("pct_of_subreddit"),
            F.col("best.top_words").alias("top_words"),
        )
    )
