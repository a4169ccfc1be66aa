"""Queries of the aggregate, ranking, sampling and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoraflow.catalog.fixtures import Tables
from agoraflow.functions import display
from agoraflow.functions.text import drop_first_prefix, safe_name, split_topic_key
from agoraflow.operators import aggregates as agg
from agoraflow.operators import ranking, sampling
from agoraflow.registry import query

# ---- counts and means ----


@query("row_counts", "SELECT type, count(*) AS n FROM content GROUP BY type")
def _(t: Tables):
    return agg.row_counts(t.content, ["type"])


@query(
    "cluster_centroids_3d",
    """SELECT cluster_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z
    FROM points JOIN clusters USING (type, id) WHERE cluster_id <> -1 GROUP BY cluster_id""",
)
def _(t: Tables):
    means = agg.cluster_centroids_3d(t.points.join(t.clusters, ["type", "id"]))
    return means.select("cluster_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


@query(
    "cluster_report",
    """SELECT CAST(max(cluster_id) + 1 AS BIGINT) AS n_clusters, count(*) FILTER (cluster_id = -1) AS n_noise,
    round_even(count(*) FILTER (cluster_id = -1) * 100.0::DOUBLE / count(*), 1) AS noise_pct FROM clusters""",
)
def _(t: Tables):
    return agg.cluster_report(t.clusters)


@query(
    "top_clusters",
    """SELECT cluster_id, count(*) AS n FROM clusters WHERE cluster_id <> -1 GROUP BY cluster_id
    ORDER BY n DESC, cluster_id LIMIT 5""",
)
def _(t: Tables):
    return agg.top_clusters(t.clusters, 5)


@query(
    "top_subreddits",
    """SELECT subreddit, count(*) AS n FROM content WHERE subreddit <> 'Unknown' GROUP BY subreddit
    ORDER BY n DESC, subreddit LIMIT 10""",
)
def _(t: Tables):
    return agg.top_subreddits(t.content, 10)


@query(
    "top5_per_cluster",
    """SELECT cluster_id, string_agg(subreddit, ',' ORDER BY rn) AS top_subreddits FROM (
      SELECT cluster_id, subreddit, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, subreddit) AS rn
      FROM combined GROUP BY cluster_id, subreddit) WHERE rn <= 5 GROUP BY cluster_id""",
)
def _(t: Tables):
    top = agg.top_communities_per_cluster(t.combined, 5)
    return top.select("cluster_id", F.concat_ws(",", "top_subreddits").alias("top_subreddits"))


@query(
    "topic_centroids",
    """SELECT u.scope_type, u.scope_value, u.topic_id, c.n_docs, u.pos, round(u.value, 6) AS value
    FROM centroid_units u JOIN centroids c USING (scope_type, scope_value, topic_id)""",
)
def _(t: Tables):
    return t.centroids.select(
        "scope_type", "scope_value", "topic_id", "n_docs", F.posexplode("centroid").alias("p", "v")
    ).select(
        "scope_type", "scope_value", "topic_id", "n_docs",
        (F.col("p") + 1).cast("long").alias("pos"), F.round("v", 6).alias("value"),
    )


@query(
    "group_totals",
    "SELECT subreddit, CAST(sum(score) AS BIGINT) AS total FROM posts GROUP BY subreddit",
)
def _(t: Tables):
    return agg.group_totals(t.posts, ["subreddit"], "score")


@query(
    "pct_of_group",
    """SELECT subreddit, author, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY subreddit), 1) AS pct
    FROM posts GROUP BY subreddit, author""",
)
def _(t: Tables):
    counts = t.posts.groupBy("subreddit", "author").agg(F.count("*").alias("n"))
    totals = agg.group_totals(counts, ["subreddit"], "n")
    return counts.join(totals, "subreddit").select(
        "subreddit", "author", display.percent(F.col("n"), F.col("total")).alias("pct")
    )


@query(
    "dominant_cluster",
    """SELECT subreddit, cluster_id AS dominant_cluster, n AS cluster_docs, CAST(total AS BIGINT) AS total_docs FROM (
      SELECT subreddit, cluster_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY subreddit) AS total,
        row_number() OVER (PARTITION BY subreddit ORDER BY count(*) DESC, cluster_id) AS rn
      FROM combined WHERE cluster_id <> -1 GROUP BY subreddit, cluster_id) WHERE rn = 1""",
)
def _(t: Tables):
    return agg.dominant_clusters(agg.cluster_community_counts(t.combined.filter("cluster_id <> -1")))


@query(
    "first_per_group",
    """SELECT subreddit, id, score FROM (SELECT subreddit, id, score,
      row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, id) AS rn FROM posts) WHERE rn = 1""",
)
def _(t: Tables):
    return sampling.top_per_group(
        t.posts.select("subreddit", "id", "score"), 1, ["subreddit"], [F.desc("score"), F.col("id")]
    )


@query(
    "cluster_diversity",
    """SELECT cluster_id, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) + 0.0 AS diversity
    FROM (SELECT cluster_id, subreddit, count(*) / CAST(sum(count(*)) OVER (PARTITION BY cluster_id) AS DOUBLE) AS p
          FROM combined WHERE cluster_id <> -1 GROUP BY cluster_id, subreddit) GROUP BY cluster_id""",
)
def _(t: Tables):
    scores = agg.cluster_diversity(t.combined)
    return scores.select("cluster_id", F.round("diversity", 6).alias("diversity"))


_TOP = """tc AS (SELECT cluster_id FROM combined WHERE cluster_id <> -1 GROUP BY cluster_id
    ORDER BY count(*) DESC, cluster_id LIMIT 6),
  ts AS (SELECT subreddit FROM combined GROUP BY subreddit ORDER BY count(*) DESC, subreddit LIMIT 8)"""


@query(
    "cluster_community_matrix",
    f"""WITH {_TOP} SELECT cluster_id, subreddit, count(*) AS n FROM combined
    WHERE cluster_id IN (FROM tc) AND subreddit IN (FROM ts) GROUP BY ALL""",
)
def _(t: Tables):
    docs = t.combined
    return agg.cluster_community_matrix(docs, agg.top_clusters(docs, 6), agg.top_subreddits(docs, 8))


@query(
    "cluster_community_matrix_wide",
    "WITH ts AS (SELECT subreddit, row_number() OVER (ORDER BY count(*) DESC, subreddit) AS nth FROM combined GROUP BY subreddit) "
    + "SELECT cluster_id, "
    + ", ".join(f"count(*) FILTER (nth = {i}) AS top_{i}" for i in range(1, 9))
    + " FROM combined LEFT JOIN ts USING (subreddit) WHERE cluster_id <> -1 GROUP BY cluster_id HAVING count(*) FILTER (nth <= 8) > 0",
)
def _(t: Tables):
    # one column for each of the eight largest communities of the data, in their order
    docs = t.combined
    top = [r["subreddit"] for r in agg.top_subreddits(docs, 8).orderBy(F.desc("n"), "subreddit").collect()]
    kept = docs.filter("cluster_id <> -1")
    long = agg.cluster_community_matrix(kept, kept.select("cluster_id").distinct(), agg.top_subreddits(docs, 8))
    wide = agg.widen_matrix(long, top)
    count = [F.col(f"`{name}`") for name in top] + [F.lit(0).cast("long")] * (8 - len(top))
    return wide.select("cluster_id", *[c.alias(f"top_{i + 1}") for i, c in enumerate(count)])


@query(
    "subreddit_cluster_distribution",
    "SELECT subreddit, cluster_id, count(*) AS n FROM combined GROUP BY subreddit, cluster_id",
)
def _(t: Tables):
    return agg.subreddit_cluster_distribution(t.combined)


@query(
    "cluster_subreddit_distribution",
    "SELECT cluster_id, subreddit, count(*) AS n FROM combined GROUP BY cluster_id, subreddit",
)
def _(t: Tables):
    return agg.cluster_subreddit_distribution(t.combined)


@query(
    "top_columns_by_total",
    """SELECT subreddit, count(*) AS total FROM combined WHERE cluster_id <> -1 GROUP BY subreddit
    ORDER BY total DESC, subreddit LIMIT 15""",
)
def _(t: Tables):
    return agg.top_columns_by_total(agg.cluster_community_counts(t.combined.filter("cluster_id <> -1")), 15)


@query(
    "distinct_counts",
    """SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS unique_clusters,
    count(DISTINCT subreddit) AS unique_subreddits, count(DISTINCT type) AS unique_types FROM combined""",
)
def _(t: Tables):
    return agg.distinct_counts(t.combined)


@query(
    "summary_statistics",
    """SELECT d.*, p.*, n.noise_points FROM
      (SELECT count(*) AS total_documents, count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS unique_clusters,
        count(DISTINCT subreddit) AS unique_subreddits FROM combined) d,
      (SELECT count(*) FILTER (scope_type = 'cluster') AS clusters_modeled,
        count(*) FILTER (scope_type <> 'cluster') AS subreddits_modeled,
        CAST(sum(n) FILTER (scope_type = 'cluster') AS BIGINT) AS topics_from_clusters,
        CAST(sum(n) FILTER (scope_type <> 'cluster') AS BIGINT) AS topics_from_subreddits,
        CAST(sum(n) AS BIGINT) AS total_topics
       FROM (SELECT scope_type, scope_value, count(DISTINCT topic_id) AS n FROM membership GROUP BY ALL)) p,
      (SELECT count(*) AS noise_points FROM combined WHERE cluster_id = -1) n""",
)
def _(t: Tables):
    return agg.summary_statistics(t.combined, t.membership)


@query(
    "topics_per_model",
    "SELECT scope_type, scope_value, count(DISTINCT topic_id) AS n_topics FROM membership GROUP BY ALL",
)
def _(t: Tables):
    return agg.topics_per_model(t.membership)


# ---- ranks ----

_RANKS = """(SELECT subreddit, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, subreddit) AS sub_rank
    FROM combined WHERE subreddit <> 'src0' GROUP BY subreddit)"""


def _without_src0(t: Tables):
    """The combined documents with one community unknown."""
    name = F.when(F.col("subreddit") != "src0", F.col("subreddit")).otherwise("Unknown")
    return t.combined.withColumn("subreddit", name)


@query(
    "frequency_rank",
    f"""SELECT c.id, coalesce(r.sub_rank, 999999) AS sub_rank FROM combined c LEFT JOIN {_RANKS} r USING (subreddit)""",
)
def _(t: Tables):
    return ranking.frequency_rank(_without_src0(t)).select("id", "sub_rank")


@query(
    "cumulative_reveal",
    f"""SELECT subreddit, n, sub_rank, CAST(sum(n) OVER (ORDER BY sub_rank) AS BIGINT) AS visible
    FROM {_RANKS} WHERE sub_rank <= 12""",
)
def _(t: Tables):
    return ranking.cumulative_reveal(ranking.community_ranks(_without_src0(t)), 12)


@query(
    "frame_reveal",
    f"""SELECT f.frame, f.n_shown, (SELECT CAST(sum(n) AS BIGINT) FROM {_RANKS} WHERE sub_rank <= f.n_shown) AS visible
    FROM (SELECT i AS frame, greatest(1, least(100, CAST(floor(CASE WHEN i <= 375 THEN 1 + 99 * (i / 375.0::DOUBLE)
      ELSE 100 - 99 * ((i - 375) / 375.0::DOUBLE) END) AS INTEGER))) AS n_shown FROM range(750) r(i)) f""",
)
def _(t: Tables):
    return ranking.frame_reveal(ranking.community_ranks(_without_src0(t)), 750)


@query(
    "category_index",
    """SELECT p.id, p.subreddit, d.r AS category FROM posts p JOIN
    (SELECT subreddit, (row_number() OVER (ORDER BY subreddit) - 1) % 20 AS r FROM (SELECT DISTINCT subreddit FROM posts)) d
    USING (subreddit)""",
)
def _(t: Tables):
    return ranking.category_index(t.posts.select("id", "subreddit"), "subreddit", modulo=20)


@query(
    "dimension_lookups",
    """SELECT c.id, m.n_topics, t.total FROM combined c
    JOIN (SELECT scope_value AS subreddit, count(DISTINCT topic_id) AS n_topics FROM membership
          WHERE scope_type = 'subreddit' GROUP BY scope_value) m USING (subreddit)
    JOIN (SELECT subreddit, count(*) AS total FROM combined GROUP BY subreddit) t USING (subreddit)""",
)
def _(t: Tables):
    models = agg.topics_per_model(t.membership).filter("scope_type = 'subreddit'")
    models = models.select(F.col("scope_value").alias("subreddit"), "n_topics")
    totals = t.combined.groupBy("subreddit").agg(F.count("*").alias("total"))
    return t.combined.join(models, "subreddit").join(totals, "subreddit").select("id", "n_topics", "total")


# ---- samples and limits ----

_ORDER = "md5(type || '|' || id || '|42')"


@query(
    "sample_n",
    f"SELECT type, id, subreddit FROM content ORDER BY {_ORDER}, type, id LIMIT 300",
)
def _(t: Tables):
    return sampling.sample_n(t.content.select("type", "id", "subreddit"), 300, ["type", "id"])


@query(
    "balanced_sample",
    f"""SELECT type, id FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY {_ORDER}, id) AS rn
    FROM content) WHERE rn <= 200""",
)
def _(t: Tables):
    return sampling.balanced_sample(t.content.select("type", "id"), 400)


@query(
    "head_counts",
    "SELECT author, count(*) AS n FROM posts GROUP BY author ORDER BY n DESC, author LIMIT 2",
)
def _(t: Tables):
    return sampling.head_counts(t.posts, "author", 2)


@query(
    "text_preview",
    "SELECT id, substr(text, 1, 60) AS preview FROM content",
)
def _(t: Tables):
    return t.content.select("id", display.preview(F.col("text")).alias("preview"))


@query(
    "paged_scan",
    "SELECT id, score, (row_number() OVER (ORDER BY id) - 1) // 50 AS page FROM posts",
)
def _(t: Tables):
    return sampling.paged(t.posts.select("id", "score"), ["id"], 50)


# ---- sets and scalar functions ----


@query("union_content", "SELECT type, id, subreddit, length(text) AS n_chars FROM content")
def _(t: Tables):
    return t.content.select("type", "id", "subreddit", F.length("text").cast("long").alias("n_chars"))


@query(
    "union_centroids",
    """SELECT scope_type, scope_value, topic_id, n_docs, CASE WHEN scope_type = 'cluster' THEN CAST(scope_value AS INTEGER) END AS cluster_id
    FROM centroids""",
)
def _(t: Tables):
    from agoraflow.sources.stores import union_centroids

    narrow = t.centroids.drop("centroid")
    clusters = narrow.filter("scope_type = 'cluster'").withColumn("cluster_id", F.col("scope_value").cast("int"))
    return union_centroids([clusters, narrow.filter("scope_type = 'subreddit'")])


@query(
    "scalar_text_functions",
    r"""SELECT doc_id, translate('r/' || source || '\' || lang, '/\', '__') AS safe,
      regexp_replace('subreddit_' || source || '_subreddit_x', '^(.*?)subreddit_', '\1') AS bare,
      upper(lang) || '-' || lower(source) AS label, substr(text, 1, 10) AS head, length(text) AS n,
      source AS scope, CAST(doc_id % 7 AS INTEGER) AS topic FROM documents""",
)
def _(t: Tables):
    d = t.raw("documents")
    key = F.concat("source", F.lit("_topic"), F.col("doc_id") % 7)
    scope, topic = split_topic_key(key)
    return d.select(
        "doc_id",
        safe_name(F.concat(F.lit("r/"), "source", F.lit("\\"), "lang")).alias("safe"),
        drop_first_prefix(F.concat(F.lit("subreddit_"), "source", F.lit("_subreddit_x"))).alias("bare"),
        F.concat(F.upper("lang"), F.lit("-"), F.lower("source")).alias("label"),
        F.substring("text", 1, 10).alias("head"),
        F.length("text").cast("long").alias("n"),
        scope.alias("scope"),
        topic.alias("topic"),
    )


@query(
    "marker_columns",
    """SELECT scope_type, scope_value, topic_id, CASE scope_type WHEN 'cluster' THEN 0 ELSE 1 END AS code,
      round(greatest(least(ln(1 + n_docs) * 2 + 3, 15), 3), 6) AS size,
      round(greatest(least(ln(1 + n_docs) * 2 + 4, 18), 4), 6) AS wide_size,
      upper(scope_type[1]) || scope_type[2:] || ': ' || scope_value AS label,
      format('{:,}', n_docs) AS docs FROM centroids""",
)
def _(t: Tables):
    n = F.col("n_docs")
    return t.centroids.select(
        "scope_type", "scope_value", "topic_id",
        display.scope_code(F.col("scope_type")).alias("code"),
        F.round(display.marker_size(n), 6).alias("size"),
        F.round(display.marker_size(n, 4.0, 4.0, 18.0), 6).alias("wide_size"),
        display.scope_label(F.col("scope_type"), F.col("scope_value")).alias("label"),
        display.thousands(n).alias("docs"),
    )


@query(
    "scalar_number_functions",
    """SELECT doc_id, round(log2(n_chars), 6) AS bits, round_even(n_chars / 7::DOUBLE, 1) AS tenth,
      round(greatest(least(ln(1 + n_chars) * 2 + 3, 15), 3), 6) AS size, n_chars * 0.5::DOUBLE + 5 AS width,
      doc_id % 20 AS colour, CAST(n_chars AS VARCHAR) AS as_text, len(string_split(text, ' ')) AS n_words,
      greatest(least(n_chars, 500), 1) AS capped FROM documents""",
)
def _(t: Tables):
    n = F.col("n_chars")
    return t.raw("documents").select(
        "doc_id",
        F.round(F.log2(n), 6).alias("bits"),
        F.bround(n / 7, 1).alias("tenth"),
        F.round(display.marker_size(n), 6).alias("size"),
        display.degree_size(n, 0.5, 5.0).alias("width"),
        display.palette_index(F.col("doc_id")).alias("colour"),
        n.cast("string").alias("as_text"),
        F.size(F.split("text", " ")).cast("long").alias("n_words"),
        F.greatest(F.least(n, F.lit(500)), F.lit(1)).alias("capped"),
    )


@query(
    "report_columns",
    "SELECT subreddit AS community, id AS document, score AS topic_doc_count FROM posts",
)
def _(t: Tables):
    return t.posts.select(
        F.col("subreddit").alias("community"), F.col("id").alias("document"), F.col("score").alias("topic_doc_count")
    )
