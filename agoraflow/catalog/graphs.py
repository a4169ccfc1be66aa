"""Queries of the similarity and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoraflow.catalog.filtering import _EDGE_COLS, _EDGE_OUT, _edges_out
from agoraflow.catalog.fixtures import (
    CROSS_THRESHOLD,
    DISPLAY_THRESHOLD,
    EDGE_THRESHOLD,
    LINK_THRESHOLD,
    Tables,
    placed,
    placed_sql,
)
from agoraflow.functions import vectors as vec
from agoraflow.operators import aggregates as agg
from agoraflow.operators import graph, similarity
from agoraflow.registry import query

_COMMUNITY = "source_scope = 'subreddit' AND target_scope = 'subreddit'"


@query("cosine_edges", f"SELECT {_EDGE_OUT} FROM edges")
def _(t: Tables):
    return _edges_out(similarity.cosine_edges(t.centroids, EDGE_THRESHOLD))


@query(
    "cosine_pairs_vectors",
    """SELECT a.vec_id AS a_vec_id, b.vec_id AS b_vec_id, round(list_dot_product(a.vector, b.vector)
      / sqrt(list_dot_product(a.vector, a.vector)) / sqrt(list_dot_product(b.vector, b.vector)), 6) AS similarity
    FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id
    WHERE list_dot_product(a.vector, b.vector)
      / sqrt(list_dot_product(a.vector, a.vector)) / sqrt(list_dot_product(b.vector, b.vector)) >= 0.3""",
)
def _(t: Tables):
    # small blocks, so that the block pairing itself is exercised
    pairs = similarity.cosine_pairs(t.vectors, 0.3, ["vec_id"], "vector", block_rows=256)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("similarity_graph", f"SELECT {_EDGE_OUT} FROM edges WHERE similarity >= {LINK_THRESHOLD}")
def _(t: Tables):
    return _edges_out(graph.similarity_graph(t.centroids, LINK_THRESHOLD))


@query(
    "l2_normalise",
    """SELECT vec_id, round(vector[1] / sqrt(list_dot_product(vector, vector)), 6) AS first,
      round(vector[64] / sqrt(list_dot_product(vector, vector)), 6) AS last FROM
      (SELECT vec_id, list_transform(vector, lambda x: x * (vec_id + 1)) AS vector FROM vectors)""",
)
def _(t: Tables):
    grown = F.transform("vector", lambda x: x * (F.col("vec_id") + 1))
    unit = t.vectors.select("vec_id", vec.l2_normalise(grown).alias("u"))
    return unit.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query(
    "cosine_similarity",
    """SELECT c.scope_type, c.scope_value, c.topic_id, m.id,
      round(list_dot_product(c.centroid, m.vector) / sqrt(list_dot_product(m.vector, m.vector)), 6) AS score
    FROM centroids c JOIN membership m USING (scope_type, scope_value, topic_id)""",
)
def _(t: Tables):
    key = ["scope_type", "scope_value", "topic_id"]
    rows = t.membership.join(t.centroids.select(*key, "centroid"), key)
    return rows.select(*key, "id", F.round(vec.cosine(F.col("centroid"), F.col("vector")), 6).alias("score"))


@query("symmetrise", "SELECT scope, value, topic, count(*) AS n, round(sum(similarity), 6) AS s FROM ends GROUP BY ALL")
def _(t: Tables):
    both = graph.symmetrise(t.edges)
    return both.groupBy("scope", "value", "topic").agg(
        F.count("*").alias("n"), F.round(F.sum("similarity"), 6).alias("s")
    )


_CROSS = f"""SELECT CASE WHEN source_scope = 'cluster' THEN source_value ELSE target_value END AS cluster,
      CASE WHEN source_scope = 'cluster' THEN target_value ELSE source_value END AS subreddit,
      count(*) AS n_connections, round(avg(similarity), 6) AS avg_similarity, round(max(similarity), 6) AS max_similarity
    FROM edges WHERE source_scope <> target_scope AND similarity >= %s GROUP BY 1, 2"""


def _cross(t: Tables, threshold: float):
    rows = graph.cross_scope_summary(t.edges, threshold)
    for c in ("avg_similarity", "max_similarity"):
        rows = rows.withColumn(c, F.round(c, 6))
    return rows


@query("cross_scope_summary", _CROSS % CROSS_THRESHOLD)
def _(t: Tables):
    return _cross(t, CROSS_THRESHOLD)


@query("cross_scope_links", _CROSS % LINK_THRESHOLD)
def _(t: Tables):
    return _cross(t, LINK_THRESHOLD)


@query(
    "sort_reports",
    _CROSS % CROSS_THRESHOLD + " ORDER BY n_connections DESC, cluster, subreddit",
)
def _(t: Tables):
    return _cross(t, CROSS_THRESHOLD).orderBy(F.desc("n_connections"), "cluster", "subreddit")


@query(
    "bridge_topics",
    f"""SELECT value AS subreddit, topic AS topic_id, count(*) AS n_communities,
      string_agg(c, ', ' ORDER BY c) AS connected_subreddits FROM (
        SELECT value, topic, other_value AS c FROM ends WHERE scope = 'subreddit' AND other_scope = 'subreddit'
          AND similarity >= {LINK_THRESHOLD}
        UNION SELECT value, topic, value FROM ends WHERE scope = 'subreddit' AND other_scope = 'subreddit'
          AND similarity >= {LINK_THRESHOLD})
    GROUP BY value, topic HAVING count(*) >= 3""",
)
def _(t: Tables):
    return graph.bridge_topics(t.edges, 3, LINK_THRESHOLD)


@query(
    "topic_reach",
    f"""SELECT scope AS scope_type, value AS scope_value, topic AS topic_id, any_value(total) AS reach,
      string_agg(c, ', ' ORDER BY c) FILTER (rn <= 10) AS communities FROM (
        SELECT *, row_number() OVER (PARTITION BY scope, value, topic ORDER BY c) AS rn,
          count(*) OVER (PARTITION BY scope, value, topic) AS total FROM (
          SELECT DISTINCT scope, value, topic, other_scope || ':' || other_value AS c FROM ends
          WHERE similarity >= {LINK_THRESHOLD}))
    GROUP BY scope, value, topic""",
)
def _(t: Tables):
    return graph.topic_reach(t.edges, LINK_THRESHOLD)


_AFFINITY = f"""SELECT least(source_value, target_value) AS source, greatest(source_value, target_value) AS target,
      count(*) AS n, round(avg(similarity), 6) AS avg_sim FROM edges
    WHERE {_COMMUNITY} AND similarity >= {LINK_THRESHOLD} %s GROUP BY 1, 2 HAVING count(*) >= 5"""


@query("affinity_pairs", _AFFINITY % "")
def _(t: Tables):
    rows = graph.affinity_network(t.edges, LINK_THRESHOLD, 5, drop_self=False)
    return rows.withColumn("avg_sim", F.round("avg_sim", 6))


@query("affinity_network", _AFFINITY % "AND source_value <> target_value")
def _(t: Tables):
    rows = graph.affinity_network(t.edges, LINK_THRESHOLD, 5)
    return rows.withColumn("avg_sim", F.round("avg_sim", 6))


_PAIRS = f"""SELECT DISTINCT least(source_value, target_value) AS source, greatest(source_value, target_value) AS target
    FROM edges WHERE {_COMMUNITY} AND similarity >= {LINK_THRESHOLD}"""


def _network(t: Tables):
    return graph.affinity_network(t.edges, LINK_THRESHOLD, 1, drop_self=False)


@query(
    "node_degree",
    f"""SELECT node, count(*) AS degree, count(*) * 100.0::DOUBLE + 100 AS size FROM (
      SELECT source AS node FROM ({_PAIRS}) UNION ALL SELECT target FROM ({_PAIRS})) GROUP BY node""",
)
def _(t: Tables):
    from agoraflow.functions.display import degree_size

    rows = graph.node_degree(_network(t))
    return rows.withColumn("size", degree_size(F.col("degree"), 100.0, 100.0))


@query(
    "neighbours",
    f"SELECT source AS node, target AS neighbour FROM ({_PAIRS}) UNION ALL SELECT target, source FROM ({_PAIRS})",
)
def _(t: Tables):
    return graph.neighbours(_network(t))


@query(
    "strongest_edges",
    f"""SELECT {_EDGE_OUT} FROM edges WHERE similarity >= {DISPLAY_THRESHOLD}
    ORDER BY edges.similarity DESC, source_scope, source_value, source_topic, target_scope, target_value, target_topic LIMIT 50""",
)
def _(t: Tables):
    return _edges_out(graph.strongest_edges(t.edges, DISPLAY_THRESHOLD, 50))


@query(
    "edge_endpoints",
    f"""SELECT {', '.join('e.' + c for c in _EDGE_COLS)},
      round(a.x, 6) AS source_x, round(a.y, 6) AS source_y, round(a.z, 6) AS source_z,
      round(b.x, 6) AS target_x, round(b.y, 6) AS target_y, round(b.z, 6) AS target_z
    FROM edges e
    JOIN (SELECT *, {placed_sql('centroid')} FROM centroids) a ON a.scope_type = e.source_scope AND a.scope_value = e.source_value AND a.topic_id = e.source_topic
    JOIN (SELECT *, {placed_sql('centroid')} FROM centroids) b ON b.scope_type = e.target_scope AND b.scope_value = e.target_value AND b.topic_id = e.target_topic
    WHERE a.topic_id <> 0 AND b.topic_id <> 0""",
)
def _(t: Tables):
    places = t.centroids.filter("topic_id <> 0").select(
        "scope_type", "scope_value", "topic_id", *placed(F.col("centroid"))
    )
    ends = graph.edge_endpoints(t.edges, places)
    coords = [f"{s}_{a}" for s in ("source", "target") for a in "xyz"]
    return ends.select(*_EDGE_COLS, *[F.round(x, 6).alias(x) for x in coords])


_OVERLAP = f"""SELECT value AS source, other_value AS target, count(DISTINCT topic) AS n_topics FROM ends
    WHERE scope = 'subreddit' AND other_scope = 'subreddit' AND value <> other_value
      AND similarity >= {LINK_THRESHOLD} GROUP BY 1, 2"""


def _topic_counts(t: Tables):
    rows = agg.topics_per_model(t.membership).filter("scope_type = 'subreddit'")
    return rows.select(F.col("scope_value").alias("subreddit"), "n_topics")


@query(
    "topic_overlap_directed",
    f"SELECT source, target, n_topics FROM ({_OVERLAP})",
)
def _(t: Tables):
    return graph.topic_overlap_directed(t.edges, LINK_THRESHOLD)


@query(
    "community_pairs",
    """SELECT DISTINCT a.subreddit AS subreddit_1, b.subreddit AS subreddit_2 FROM combined a JOIN combined b
      ON a.cluster_id = b.cluster_id AND a.subreddit < b.subreddit WHERE a.cluster_id <> -1
    UNION SELECT subreddit_1, subreddit_2 FROM topic_jaccard WHERE jaccard >= 0.3""",
)
def _(t: Tables):
    shared = similarity.shared_topic_counts(t.community_words, 0.3)
    return graph.community_pairs(shared, t.combined.filter("cluster_id <> -1"))


_TOPIC_COUNTS = """SELECT scope_value AS subreddit, count(DISTINCT topic_id) AS n_topics FROM membership
    WHERE scope_type = 'subreddit' GROUP BY 1"""
_CAPPED = f"""SELECT o.source, o.target, o.n_topics AS raw_overlap, least(o.n_topics, b.n_topics) AS overlap,
      a.n_topics AS own_topics, least(o.n_topics, b.n_topics) / greatest(a.n_topics, 1)::DOUBLE AS share
    FROM ({_OVERLAP}) o JOIN ({_TOPIC_COUNTS}) a ON a.subreddit = o.source
    JOIN ({_TOPIC_COUNTS}) b ON b.subreddit = o.target"""


def _capped(t: Tables):
    return graph.capped_overlap(graph.topic_overlap_directed(t.edges, LINK_THRESHOLD), _topic_counts(t))


@query("capped_overlap", f"SELECT source, target, raw_overlap, overlap, own_topics, round(share, 6) AS share FROM ({_CAPPED})")
def _(t: Tables):
    return _capped(t).withColumn("share", F.round("share", 6))


def _scored(t: Tables):
    """Pair scores of the linked communities, the shape similarity_network reads."""
    pairs = graph.affinity_network(t.edges, LINK_THRESHOLD, 1)
    return pairs.select(
        F.col("target").alias("subreddit_1"),
        F.col("source").alias("subreddit_2"),
        (F.col("n") / 10).alias("combined_score"),
        F.when(F.col("n") > 1, F.col("n")).alias("shared_topics"),
    )


_SCORED = f"""SELECT least(source_value, target_value) AS source, greatest(source_value, target_value) AS target,
      count(*) / 10::DOUBLE AS weight, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS shared_topics, 0::BIGINT AS shared_clusters
    FROM edges WHERE {_COMMUNITY} AND similarity >= {LINK_THRESHOLD} AND source_value <> target_value GROUP BY 1, 2
    HAVING count(*) / 10::DOUBLE >= 0.2"""


@query("similarity_network", _SCORED)
def _(t: Tables):
    return graph.similarity_network(_scored(t), 0.2)


_NEAR = f"""SELECT node, neighbour, overlap, share, rank FROM (
      SELECT n.node, n.neighbour, coalesce(c.overlap, 0) AS overlap, coalesce(c.share, 0) AS share,
        row_number() OVER (PARTITION BY n.node ORDER BY coalesce(c.share, 0) DESC, n.neighbour) AS rank
      FROM (SELECT source AS node, target AS neighbour FROM ({_SCORED}) UNION ALL SELECT target, source FROM ({_SCORED})) n
      LEFT JOIN ({_CAPPED}) c ON c.source = n.node AND c.target = n.neighbour) WHERE rank <= 3"""


@query("top10_neighbours", f"SELECT node, neighbour, overlap, round(share, 6) AS share, CAST(rank AS INTEGER) AS rank FROM ({_NEAR})")
def _(t: Tables):
    network = graph.similarity_network(_scored(t), 0.2)
    rows = graph.top_neighbours(network, _capped(t), 3)
    return rows.select("node", "neighbour", "overlap", F.round("share", 6).alias("share"), "rank")


@query(
    "node_report",
    f"""WITH d AS (SELECT * FROM (SELECT subreddit, cluster_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY subreddit) AS total,
        row_number() OVER (PARTITION BY subreddit ORDER BY count(*) DESC, cluster_id) AS rn
      FROM combined WHERE cluster_id <> -1 GROUP BY subreddit, cluster_id) WHERE rn = 1),
    g AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM ({_SCORED}) UNION ALL SELECT target FROM ({_SCORED})) GROUP BY node),
    near AS (SELECT node, string_agg(neighbour, ', ' ORDER BY rank) AS neighbours FROM ({_NEAR}) GROUP BY node)
    SELECT g.node AS subreddit, d.cluster_id AS dominant_cluster, coalesce(d.n, 0) AS cluster_docs,
      CAST(coalesce(d.total, 1) AS BIGINT) AS total_docs,
      round_even(coalesce(d.n, 0) * 100.0::DOUBLE / greatest(coalesce(d.total, 1), 1), 1) AS pct,
      coalesce(c.n_topics, 0) AS n_topics, g.degree, g.degree * 0.5::DOUBLE + 5 AS size, near.neighbours
    FROM g LEFT JOIN d ON d.subreddit = g.node LEFT JOIN ({_TOPIC_COUNTS}) c ON c.subreddit = g.node
    LEFT JOIN near ON near.node = g.node""",
)
def _(t: Tables):
    network = graph.similarity_network(_scored(t), 0.2)
    dominant = agg.dominant_clusters(agg.cluster_community_counts(t.combined.filter("cluster_id <> -1")))
    return graph.node_report(network, dominant, _topic_counts(t), _capped(t), 3)


_TOPIC_NODES = """SELECT source_scope || ':' || source_value || ':' || source_topic AS a,
      target_scope || ':' || target_value || ':' || target_topic AS b FROM edges WHERE similarity >= 0.25"""


@query(
    "community_components",
    f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_TOPIC_NODES}) UNION SELECT b, a FROM ({_TOPIC_NODES})),
    r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
    SELECT node, min(seen) AS component FROM r GROUP BY node""",
)
def _(t: Tables):
    def node(side):
        return F.concat_ws(":", f"{side}_scope", f"{side}_value", f"{side}_topic")

    strong = t.edges.filter("similarity >= 0.25").select(node("source").alias("source"), node("target").alias("target"))
    return graph.connected_components(strong)


@query(
    "drop_isolates",
    f"SELECT source AS subreddit FROM ({_SCORED}) UNION SELECT target FROM ({_SCORED})",
)
def _(t: Tables):
    # nodes come from the edge list, so a community without an edge is not there
    network = graph.similarity_network(_scored(t), 0.2)
    return graph.neighbours(network).select(F.col("node").alias("subreddit")).distinct()


@query(
    "row_position",
    """SELECT source_scope, target_scope, count(*) AS n, min(source_value || ':' || source_topic) AS first_source FROM edges GROUP BY 1, 2""",
)
def _(t: Tables):
    first = F.min(F.concat_ws(":", "source_value", "source_topic")).alias("first_source")
    return t.edges.groupBy("source_scope", "target_scope").agg(F.count("*").alias("n"), first)


@query(
    "topic_space",
    """SELECT scope_type, scope_value, topic_id, n_docs, CASE scope_type WHEN 'cluster' THEN 0 ELSE 1 END AS code,
      (SELECT count(*) FROM ends e WHERE e.scope = c.scope_type AND e.value = c.scope_value AND e.topic = c.topic_id
        AND e.similarity >= 0.25) AS degree FROM centroids c""",
)
def _(t: Tables):
    from agoraflow.functions.display import scope_code

    strong = graph.symmetrise(graph.strongest_edges(t.edges, DISPLAY_THRESHOLD))
    degree = strong.groupBy(
        F.col("scope").alias("scope_type"), F.col("value").alias("scope_value"), F.col("topic").alias("topic_id")
    ).agg(F.count("*").alias("degree"))
    key = ["scope_type", "scope_value", "topic_id"]
    return t.centroids.join(degree, key, "left").select(
        *key, "n_docs", scope_code(F.col("scope_type")).alias("code"), F.coalesce("degree", F.lit(0)).alias("degree")
    )
