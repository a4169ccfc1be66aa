"""Queries of the filter and join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoraflow.catalog.fixtures import (
    CROSS_THRESHOLD,
    LINK_THRESHOLD,
    TERMS,
    WHITELIST,
    WINDOW,
    Tables,
)
from agoraflow.functions.text import comment_text, post_text
from agoraflow.operators import combine, filters, graph
from agoraflow.operators.ranking import community_ranks, frequency_rank
from agoraflow.registry import query

_PATTERN = r"(^|[^0-9A-Za-z_])(" + "|".join(TERMS) + r")([^0-9A-Za-z_]|$)"
_LIKE = " OR ".join(
    f"lower({c}) LIKE '%{t}%'" for t in TERMS for c in ("subreddit", "title", "selftext")
)
_MATCH = f"regexp_matches(lower(title), '{_PATTERN}')"


@query("keyword_filter", f"SELECT id, subreddit, score FROM posts WHERE {_MATCH}")
def _(t: Tables):
    return filters.keyword_filter(t.posts, TERMS, "posts").select("id", "subreddit", "score")


@query(
    "keyword_filter_comments",
    f"SELECT id, subreddit, author FROM comments WHERE regexp_matches(lower(body), '{_PATTERN}')",
)
def _(t: Tables):
    return filters.keyword_filter(t.comments, TERMS, "comments").select("id", "subreddit", "author")


@query(
    "keyword_rank",
    f"""SELECT subreddit, n, row_number() OVER (ORDER BY n DESC, subreddit) AS sub_rank
    FROM (SELECT subreddit, count(*) AS n FROM posts WHERE {_MATCH} GROUP BY subreddit)""",
)
def _(t: Tables):
    return community_ranks(filters.keyword_filter(t.posts, TERMS, "posts"))


@query("like_prefilter", f"SELECT id FROM posts WHERE {_LIKE}")
def _(t: Tables):
    return t.posts.filter(filters.contains_any(TERMS, filters.PREFILTER_COLUMNS["posts"])).select("id")


@query("term_regex_match", f"SELECT id FROM posts WHERE {_MATCH}")
def _(t: Tables):
    return t.posts.filter(filters.matches_any_term(TERMS, ["title"])).select("id")


@query("term_semi_join", f"SELECT id FROM posts WHERE {_MATCH}")
def _(t: Tables):
    rows = ", ".join(f"('{x}', '{x}')" for x in TERMS)
    terms = t.spark.sql(f"SELECT * FROM VALUES {rows} AS v(term, pattern)")
    return filters.match_terms_by_join(t.posts, terms, ["title"]).select("id")


@query(
    "event_time_range",
    f"SELECT id, created_utc FROM posts WHERE created_utc >= {WINDOW[0]} AND created_utc < {WINDOW[1]}",
)
def _(t: Tables):
    return filters.event_time_range(t.posts, *WINDOW).select("id", "created_utc")


@query(
    "drop_empty_tokens",
    """SELECT id, len(tokens) AS n_tokens FROM (
      SELECT id, list_filter(regexp_split_to_array(lower(body), '[^a-z]+'), lambda x: length(x) > 12) AS tokens
      FROM comments) WHERE len(tokens) > 0""",
)
def _(t: Tables):
    tokens = F.filter(F.split(F.lower("body"), "[^a-z]+"), lambda w: F.length(w) > 12)
    rows = t.comments.select("id", tokens.alias("tokens"))
    return filters.drop_empty_tokens(rows).select("id", F.size("tokens").cast("long").alias("n_tokens"))


@query(
    "build_text",
    """SELECT id, md5(coalesce(title, '') || ' ' || coalesce(selftext, '')) AS digest FROM posts
    UNION ALL SELECT id, md5(coalesce(body, '')) FROM comments""",
)
def _(t: Tables):
    posts = t.posts.select("id", F.md5(post_text()).alias("digest"))
    return posts.unionByName(t.comments.select("id", F.md5(comment_text()).alias("digest")))


@query(
    "drop_blank_text",
    r"""SELECT id, length(s) AS n_chars, md5(s) AS digest FROM (
      SELECT id, regexp_replace(CASE WHEN num_comments % 10 = 0 THEN repeat(' ', 3) ELSE ' ' || title || ' ' END,
        '^\s+|\s+$', '', 'g') AS s FROM posts) WHERE s <> ''""",
)
def _(t: Tables):
    text = F.when(F.col("num_comments") % 10 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit(" "), F.col("title"), F.lit(" "))
    )
    rows = filters.drop_blank_text(t.posts.select("id", text.alias("text")))
    return rows.select("id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("filter_by_cluster", "SELECT id, type, cluster_id FROM clusters WHERE cluster_id = 3")
def _(t: Tables):
    return filters.filter_by_cluster(t.clusters, 3)


@query("filter_by_subreddit", "SELECT id, score FROM posts WHERE subreddit = 'src3'")
def _(t: Tables):
    return filters.filter_by_subreddit(t.posts, "src3").select("id", "score")


@query("exclude_noise", "SELECT id, type, cluster_id FROM clusters WHERE cluster_id <> -1")
def _(t: Tables):
    return filters.exclude_noise(t.clusters)


@query(
    "fill_unknown",
    "SELECT id, coalesce(nullif(subreddit, 'src0'), 'Unknown') AS subreddit FROM posts",
)
def _(t: Tables):
    named = F.when(F.col("subreddit") != "src0", F.col("subreddit"))
    return filters.fill_unknown(t.posts.select("id", named.alias("subreddit")))


_EDGE_OUT = """source_scope, source_value, source_topic, target_scope, target_value, target_topic,
    round(similarity, 6) AS similarity"""
_EDGE_COLS = [
    "source_scope", "source_value", "source_topic", "target_scope", "target_value", "target_topic",
]


def _edges_out(df):
    return df.select(*_EDGE_COLS, F.round("similarity", 6).alias("similarity"))


@query("min_similarity", f"SELECT {_EDGE_OUT} FROM edges WHERE similarity >= {LINK_THRESHOLD}")
def _(t: Tables):
    return _edges_out(filters.min_similarity(t.edges, LINK_THRESHOLD))


@query(
    "scope_predicates",
    """SELECT 'cross' AS kind, count(*) AS n FROM edges WHERE source_scope <> target_scope
    UNION ALL SELECT 'community', count(*) FROM edges WHERE source_scope = 'subreddit' AND target_scope = 'subreddit'
    UNION ALL SELECT 'cluster', count(*) FROM edges WHERE source_scope = 'cluster' AND target_scope = 'cluster'""",
)
def _(t: Tables):
    def n(df, kind):
        return df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")

    return (
        n(filters.cross_scope(t.edges), "cross")
        .unionByName(n(filters.within_scope(t.edges, "subreddit"), "community"))
        .unionByName(n(filters.within_scope(t.edges, "cluster"), "cluster"))
    )


@query(
    "id_in_list",
    "SELECT id, subreddit FROM posts WHERE (type, id) IN (SELECT type, id FROM clusters WHERE cluster_id = 2)",
)
def _(t: Tables):
    ids = filters.filter_by_cluster(t.clusters, 2)
    return filters.id_in_list(t.posts, ids).select("id", "subreddit")


@query(
    "orient_cross_edge",
    f"""SELECT CASE WHEN source_scope = 'cluster' THEN source_value ELSE target_value END AS cluster,
      CASE WHEN source_scope = 'cluster' THEN target_value ELSE source_value END AS subreddit,
      round(similarity, 6) AS similarity FROM edges
    WHERE source_scope <> target_scope AND similarity >= {CROSS_THRESHOLD}""",
)
def _(t: Tables):
    rows = graph.orient_cross_edges(filters.min_similarity(t.edges, CROSS_THRESHOLD))
    return rows.withColumn("similarity", F.round("similarity", 6))


@query(
    "min_group_size",
    """SELECT id, subreddit FROM posts WHERE subreddit IN
    (SELECT subreddit FROM posts GROUP BY subreddit HAVING count(*) >= 40)""",
)
def _(t: Tables):
    return filters.min_group_size(t.posts, ["subreddit"], 40).select("id", "subreddit")


@query(
    "visible_rank_filter",
    """SELECT p.id, r.sub_rank FROM posts p JOIN (
      SELECT subreddit, row_number() OVER (ORDER BY count(*) DESC, subreddit) AS sub_rank
      FROM posts GROUP BY subreddit) r USING (subreddit) WHERE r.sub_rank BETWEEN 1 AND 5""",
)
def _(t: Tables):
    return filters.visible_ranks(frequency_rank(t.posts), 5).select("id", "sub_rank")


@query(
    "align_present",
    "SELECT p.id, p.subreddit, len(v.vector) AS dims FROM posts p JOIN vectors v USING (type, id)",
)
def _(t: Tables):
    return combine.fetch_vectors(t.posts, t.vectors).select(
        "id", "subreddit", F.size("vector").cast("long").alias("dims")
    )


def _whitelist(t: Tables):
    return t.spark.sql(
        "SELECT * FROM VALUES " + ", ".join(f"('{w}')" for w in WHITELIST) + " AS v(subreddit)"
    )


@query(
    "whitelist_join",
    "SELECT id, subreddit FROM posts WHERE lower(subreddit) IN (SELECT subreddit FROM whitelist)",
)
def _(t: Tables):
    return combine.whitelist_join(t.posts, _whitelist(t)).select("id", "subreddit")


@query(
    "coords_with_clusters",
    "SELECT id, type, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, cluster_id FROM points JOIN clusters USING (type, id)",
)
def _(t: Tables):
    return combine.coords_with_clusters(t.points, t.clusters).select(
        "id", "type", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")], "cluster_id"
    )


@query(
    "community_labels",
    """SELECT v.id, coalesce(p.subreddit, 'Unknown') AS subreddit FROM vectors v
    LEFT JOIN (SELECT * FROM posts WHERE num_comments >= 20) p USING (type, id)""",
)
def _(t: Tables):
    labels = t.posts.filter("num_comments >= 20")
    return combine.with_community(t.vectors.select("type", "id"), labels).select("id", "subreddit")


@query(
    "with_text",
    "SELECT v.id, t.subreddit, length(t.text) AS n_chars FROM vectors v JOIN content t USING (type, id)",
)
def _(t: Tables):
    return combine.with_text(t.vectors.select("type", "id"), t.content).select(
        "id", "subreddit", F.length("text").cast("long").alias("n_chars")
    )


@query(
    "fetch_vectors",
    """SELECT c.id, c.type, round(v.vector[1], 6) AS first, round(v.vector[64], 6) AS last
    FROM content c JOIN vectors v USING (type, id)""",
)
def _(t: Tables):
    v = F.col("vector")
    return combine.fetch_vectors(t.content, t.vectors).select(
        "id", "type", F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last")
    )


@query(
    "anti_join_by_scope",
    """SELECT scope_type, scope_value, topic_id, n_docs FROM centroids c WHERE NOT EXISTS
    (SELECT 1 FROM centroids d WHERE d.scope_type = c.scope_type AND d.scope_value = c.scope_value AND d.topic_id = 8)""",
)
def _(t: Tables):
    scopes = t.centroids.filter("topic_id = 8").select("scope_type", "scope_value").distinct()
    return t.centroids.join(scopes, ["scope_type", "scope_value"], "left_anti").select(
        "scope_type", "scope_value", "topic_id", "n_docs"
    )


@query(
    "combined_dataset",
    """SELECT id, type, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, cluster_id, subreddit,
    md5(text) AS digest FROM combined""",
)
def _(t: Tables):
    return t.combined.select(
        "id", "type", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")], "cluster_id", "subreddit",
        F.md5("text").alias("digest"),
    )
