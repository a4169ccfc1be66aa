"""Reports over the similarity graph of topics and communities.

All are group-bys over the edge list. Edges are credited to both ends by a union
of the swapped columns, and reduced to distinct (topic, community) rows before
any per-topic step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoraflow.functions.display import percent
from agoraflow.functions.scale import materialize
from agoraflow.operators.filters import cross_scope, min_similarity, within_scope
from agoraflow.operators.sampling import top_per_group
from agoraflow.operators.similarity import MOST_TASKS, cosine_edges

# fixed value: communities named in a reach row
REACH_NAMES = 10


def symmetrise(edges: DataFrame) -> DataFrame:
    """Each edge once per end: scope, value, topic and the other_* columns."""
    parts = ("scope", "value", "topic")
    sides = []
    for near, far in (("source", "target"), ("target", "source")):
        sides.append(
            edges.select(
                *[F.col(f"{near}_{p}").alias(p) for p in parts],
                *[F.col(f"{far}_{p}").alias(f"other_{p}") for p in parts],
                "similarity",
            )
        )
    return sides[0].unionByName(sides[1])


def orient_cross_edges(edges: DataFrame) -> DataFrame:
    """Cluster and community of each cross-scope edge, whichever end is which."""
    cluster_first = F.col("source_scope") == "cluster"
    return cross_scope(edges).select(
        F.when(cluster_first, F.col("source_value")).otherwise(F.col("target_value")).alias("cluster"),
        F.when(cluster_first, F.col("target_value")).otherwise(F.col("source_value")).alias("subreddit"),
        "similarity",
    )


def cross_scope_summary(edges: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Connections between each cluster and community: count, mean and maximum similarity."""
    return (
        orient_cross_edges(min_similarity(edges, threshold))
        .groupBy("cluster", "subreddit")
        .agg(
            F.count("*").alias("n_connections"),
            F.avg("similarity").alias("avg_similarity"),
            F.max("similarity").alias("max_similarity"),
        )
    )


def bridge_topics(edges: DataFrame, min_communities: int = 3, threshold: float = 0.7) -> DataFrame:
    """Community topics linked to at least ``min_communities`` communities, their own included.

    Links are reduced to distinct (topic, community) rows before the names are put
    together, so the list is as long as the report row and no longer.
    """
    links = symmetrise(min_similarity(within_scope(edges), threshold))
    own = links.select("value", "topic", F.col("value").alias("community"))
    linked = (
        links.select("value", "topic", F.col("other_value").alias("community")).unionByName(own).distinct()
    )
    return (
        linked.groupBy("value", "topic")
        .agg(F.count("*").alias("n_communities"), F.collect_list("community").alias("_names"))
        .filter(F.col("n_communities") >= min_communities)
        .select(
            F.col("value").alias("subreddit"),
            F.col("topic").alias("topic_id"),
            "n_communities",
            F.concat_ws(", ", F.sort_array("_names")).alias("connected_subreddits"),
        )
    )


def topic_reach(edges: DataFrame, threshold: float = 0.7, names: int = REACH_NAMES) -> DataFrame:
    """Distinct scopes each topic is linked to, and the first ``names`` of them in order."""
    reached = (
        symmetrise(min_similarity(edges, threshold))
        .select("scope", "value", "topic", F.concat_ws(":", "other_scope", "other_value").alias("community"))
        .distinct()
    )
    key = ["scope", "value", "topic"]
    counts = reached.groupBy(*key).agg(F.count("*").alias("reach"))
    first = (
        top_per_group(reached, names, key, [F.col("community")])
        .groupBy(*key)
        .agg(F.concat_ws(", ", F.sort_array(F.collect_list("community"))).alias("communities"))
    )
    return counts.join(first, key).select(
        F.col("scope").alias("scope_type"),
        F.col("value").alias("scope_value"),
        F.col("topic").alias("topic_id"),
        "reach",
        "communities",
    )


def affinity_network(edges: DataFrame, threshold: float = 0.7, min_connections: int = 5, drop_self: bool = True) -> DataFrame:
    """Undirected community graph: pairs with at least ``min_connections`` strong topic links.

    Both directions of a pair are counted together.
    """
    pairs = min_similarity(within_scope(edges), threshold).select(
        F.least("source_value", "target_value").alias("source"),
        F.greatest("source_value", "target_value").alias("target"),
        "similarity",
    )
    if drop_self:
        pairs = pairs.filter(F.col("source") != F.col("target"))
    return (
        pairs.groupBy("source", "target")
        .agg(F.count("*").alias("n"), F.avg("similarity").alias("avg_sim"))
        .filter(F.col("n") >= min_connections)
    )


def similarity_network(pairs: DataFrame, min_score: float = 0.1) -> DataFrame:
    """Undirected community graph from scored pairs; missing shared counts are 0."""
    shared = [
        F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in pairs.columns else F.lit(0).cast("long").alias(c)
        for c in ("shared_topics", "shared_clusters")
    ]
    return min_similarity(pairs, min_score, "combined_score").select(
        F.least("subreddit_1", "subreddit_2").alias("source"),
        F.greatest("subreddit_1", "subreddit_2").alias("target"),
        F.col("combined_score").alias("weight"),
        *shared,
    )


def neighbours(edges: DataFrame, source: str = "source", target: str = "target", keep: Sequence[str] = ()) -> DataFrame:
    """Both directions of an undirected edge list: node, neighbour."""
    one = edges.select(F.col(source).alias("node"), F.col(target).alias("neighbour"), *keep)
    two = edges.select(F.col(target).alias("node"), F.col(source).alias("neighbour"), *keep)
    return one.unionByName(two)


def node_degree(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Edge ends per node; a self loop counts 2, isolated nodes do not appear."""
    return neighbours(edges, source, target).groupBy("node").agg(F.count("*").alias("degree"))


def strongest_edges(edges: DataFrame, threshold: float = 0.85, n: int = 5000) -> DataFrame:
    """The ``n`` most similar edges above the threshold, for display."""
    key = [F.col(c) for c in edges.columns if c != "similarity"]
    return min_similarity(edges, threshold).orderBy(F.desc("similarity"), *key).limit(n)


def edge_endpoints(edges: DataFrame, centroids: DataFrame) -> DataFrame:
    """Coordinates of both ends of each edge; edges with an unknown end drop out."""
    at = centroids.select("scope_type", "scope_value", "topic_id", "x", "y", "z")

    def end(side: str) -> DataFrame:
        return at.select(
            F.col("scope_type").alias(f"{side}_scope"),
            F.col("scope_value").alias(f"{side}_value"),
            F.col("topic_id").alias(f"{side}_topic"),
            *[F.col(c).alias(f"{side}_{c}") for c in ("x", "y", "z")],
        )

    joined = edges
    for side in ("source", "target"):
        joined = joined.join(end(side), [f"{side}_scope", f"{side}_value", f"{side}_topic"])
    return joined


def topic_overlap_directed(edges: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Number of A's topics with at least one match in B, for ordered pairs that have any."""
    links = symmetrise(min_similarity(within_scope(edges), threshold)).filter(
        F.col("value") != F.col("other_value")
    )
    return (
        links.groupBy(F.col("value").alias("source"), F.col("other_value").alias("target"))
        .agg(F.countDistinct("topic").alias("n_topics"))
    )


# members of one side of a block product: 2048 x 2048 counts are 16 MB
MEMBER_BLOCK = 2048


def _shared_counts(names: pa.Schema):
    """Counts of common groups of two blocks of members: an outer product for each group, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        own = table.column("_block").to_numpy() == table.column("_low").to_numpy()
        one_block = table.column("_low")[0].as_py() == table.column("_high")[0].as_py()
        group = table.column("_group").combine_chunks().dictionary_encode().indices.to_numpy()
        sides = []
        for rows in (own, own if one_block else ~own):
            part = table.filter(pa.array(rows)).column("_member").combine_chunks().dictionary_encode()
            sides.append((part.dictionary, part.indices.to_numpy(), group[rows]))
        (left, i, gi), (right, j, gj) = sides
        counts = np.zeros((len(left), len(right)), dtype=np.int32)
        order_i, order_j = np.argsort(gi, kind="stable"), np.argsort(gj, kind="stable")
        for g in np.intersect1d(gi, gj):
            a = order_i[np.searchsorted(gi[order_i], g) : np.searchsorted(gi[order_i], g, side="right")]
            b = order_j[np.searchsorted(gj[order_j], g) : np.searchsorted(gj[order_j], g, side="right")]
            counts[np.ix_(i[a], j[b])] += 1
        for first in range(0, len(left), 256):
            part = counts[first : first + 256]
            x, y = np.nonzero(np.triu(part, 1 + first) if one_block else part)
            n = pa.array(part[x, y].astype(np.int64))
            yield pa.RecordBatch.from_arrays([left.take(pa.array(x + first)), right.take(pa.array(y)), n], schema=names)

    return run


def shared_group_counts(sets: DataFrame, member: str, group: str, block_members: int = MEMBER_BLOCK) -> DataFrame:
    """a < b and ``n``: for members that have groups in common, how many.

    Members are dealt into blocks; a task multiplies the memberships of two blocks, so a group of any size
    is worked on by many tasks, no pair is shuffled and every pair leaves one task once with its whole count. Repeated
    rows count once; rows with a null are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = sets.select(F.col(member).alias("_member"), F.col(group).alias("_group")).dropna().distinct()
    rows = materialize(rows)
    blocks = max(1, -(-rows.select("_member").distinct().count() // block_members))
    paired = (
        rows.withColumn("_block", F.pmod(F.xxhash64("_member"), F.lit(blocks)).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("_member", "_group", "_block", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"))
    )
    kind = rows.schema["_member"].dataType
    schema = StructType().add("_x", kind).add("_y", kind).add("n", "long")
    # block pairs are small but heavy: they are not merged into fewer tasks
    spread = paired.repartition(min(blocks * (blocks + 1) // 2, MOST_TASKS), "_low", "_high")
    found = spread.groupBy("_low", "_high").applyInArrow(_shared_counts(to_arrow_schema(schema)), schema)
    return found.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "n")


def community_pairs(words_shared: DataFrame, cluster_sets: DataFrame, block_members: int = MEMBER_BLOCK) -> DataFrame:
    """Pairs a < b of communities that share a similar topic or a cluster.

    ``words_shared`` has subreddit_1, subreddit_2; ``cluster_sets`` subreddit, cluster_id. Pairs
    without either are not made: a reader takes them as zero.
    """
    shared = shared_group_counts(cluster_sets, "subreddit", "cluster_id", block_members)
    by_cluster = shared.select(F.col("a").alias("subreddit_1"), F.col("b").alias("subreddit_2"))
    return by_cluster.unionByName(words_shared.select("subreddit_1", "subreddit_2")).distinct()


def capped_overlap(overlap: DataFrame, topic_counts: DataFrame) -> DataFrame:
    """Overlap limited to the neighbour's topic count, and its share of the own topics."""
    own = topic_counts.select(F.col("subreddit").alias("source"), F.col("n_topics").alias("own_topics"))
    other = topic_counts.select(F.col("subreddit").alias("target"), F.col("n_topics").alias("other_topics"))
    capped = F.least("n_topics", "other_topics")
    return (
        overlap.join(own, "source")
        .join(other, "target")
        .select(
            "source",
            "target",
            F.col("n_topics").alias("raw_overlap"),
            capped.alias("overlap"),
            "own_topics",
            (capped / F.greatest("own_topics", F.lit(1))).alias("share"),
        )
    )


def top_neighbours(network: DataFrame, capped: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` neighbours of each node with the largest capped overlap share."""
    links = neighbours(network, keep=["shared_clusters"])
    scored = links.join(
        capped.select(
            F.col("source").alias("node"), F.col("target").alias("neighbour"), "overlap", "share"
        ),
        ["node", "neighbour"],
        "left",
    ).fillna({"overlap": 0, "share": 0.0})
    return top_per_group(scored, n, ["node"], [F.desc("share"), F.col("neighbour")], "rank")


def node_report(
    network: DataFrame, dominant: DataFrame, topic_counts: DataFrame, capped: DataFrame, n: int = 10
) -> DataFrame:
    """One row per network node: dominant cluster, shares, topics, degree, size and best neighbours."""
    listed = top_neighbours(network, capped, n).groupBy("node").agg(
        F.concat_ws(
            ", ",
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda s: s["neighbour"]
            ),
        ).alias("neighbours")
    )
    return (
        node_degree(network)
        .join(dominant.withColumnRenamed("subreddit", "node"), "node", "left")
        .join(topic_counts.withColumnRenamed("subreddit", "node"), "node", "left")
        .join(listed, "node", "left")
        .select(
            F.col("node").alias("subreddit"),
            "dominant_cluster",
            F.coalesce("cluster_docs", F.lit(0)).alias("cluster_docs"),
            F.coalesce("total_docs", F.lit(1)).alias("total_docs"),
            percent(
                F.coalesce("cluster_docs", F.lit(0)),
                F.greatest(F.coalesce("total_docs", F.lit(1)), F.lit(1)),
            ).alias("pct"),
            F.coalesce("n_topics", F.lit(0)).alias("n_topics"),
            "degree",
            (F.col("degree") * 0.5 + 5).alias("size"),
            "neighbours",
        )
    )


def similarity_graph(centroids: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The edge list of all centroids, written once because every report reads it."""
    return materialize(cosine_edges(centroids, threshold))


def _canonical(edges: DataFrame, by: Sequence[str], src: Column, dst: Column) -> DataFrame:
    return edges.select(*by, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u != v")


def _is_star_forest(state: DataFrame, by: Sequence[str]) -> bool:
    """True when every node points to one node that points nowhere."""
    ends = state.select(*by, F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        state.select(*by, F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    loose = (
        ends.groupBy(*by, "node")
        .agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        .filter((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))
    )
    return loose.limit(1).count() == 0


def connected_components(
    edges: DataFrame, by: Sequence[str] = (), src: str = "source", dst: str = "target", max_rounds: int = 100
) -> DataFrame:
    """Smallest node of the component of every node that has an edge: by..., node, component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). A round
    takes the minimum neighbour per node as a combined aggregate and joins it back;
    it never gathers a neighbourhood, and adaptive execution splits the rows of a
    hub. Each round is written to the checkpoint folder. ``by`` runs many graphs
    at once.
    """
    by = list(by)
    state = materialize(_canonical(edges, by, F.col(src), F.col(dst)).distinct())
    for _ in range(max_rounds):
        if _is_star_forest(state, by):
            break
        # large star: neighbours above a node move to the smallest around it
        both = state.unionByName(state.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(lowest, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        ).filter("u != v")
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, [*by, "u"])
            .select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select(*by, "u", F.col("m").alias("v")))
            .filter("u != v")
            .distinct()
        )
        state = materialize(small)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = state.select(*by, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = state.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
