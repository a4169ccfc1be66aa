"""The forum-shaped tables the queries read, derived from the given Parquet tables.

Each fixture has two forms with the same meaning: a DataFrame (a property of
``Tables``) and a SQL common table expression (``SQL``) for the oracle.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.functions.scale import materialize, spread
from agoraflow.functions.vectors import dot
from agoraflow.operators.aggregates import topic_centroids
from agoraflow.operators.sampling import top_per_group
from agoraflow.operators.similarity import cosine_edges

# fixed values of the fixtures
EPOCH = 1_751_328_000
WINDOW = (1_751_328_000, 1_754_006_400)
WHITELIST = [f"src{i}" for i in range(15)]
# 40 terms: some common, most rare, and more than the first 20 in order have hits of their own
TERMS = [
    "nicht", "avec", "thon", "dans", "aber", "auch", "aux", "bis", "chez", "como", "cuando", "dass", "eanst", "edsh", "eron",
    "esth", "haber", "heaan", "inoren", "lyre", "mais", "ndea", "onre", "oust", "pero", "porque", "reou", "sans", "sein",
    "shan", "sobre", "sous", "stst", "thhe", "tionon", "trop", "unter", "werden", "zwischen", "über",
]
EDGE_THRESHOLD = 0.10
CROSS_THRESHOLD = 0.15
LINK_THRESHOLD = 0.20
DISPLAY_THRESHOLD = 0.25
WORDS_PER_TOPIC = 10
# a fixed linear map of all 64 numbers of a vector to x, y, z: three cosine waves of unit norm
AXES = [[round(math.sqrt(2 / 64) * math.cos(math.pi * (i + 0.5) * (j + 1) / 64), 6) for i in range(64)] for j in range(3)]
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "that", "this", "with", "from", "for", "on"]


def placed(vector):
    """x, y, z of a vector."""
    return [dot(vector, F.array(*map(F.lit, axis))).alias(name) for name, axis in zip("xyz", AXES)]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def posts(self) -> DataFrame:
        d = spread(self.raw("documents"), "doc_id")
        return d.select(
            F.concat(F.lit("p"), F.col("doc_id")).alias("id"),
            F.lit("post").alias("type"),
            F.col("source").alias("subreddit"),
            F.col("text").alias("title"),
            F.concat_ws(" ", "source", "lang").alias("selftext"),
            (F.lit(EPOCH) + 3600 * F.col("doc_id")).alias("created_utc"),
            (F.col("n_chars") % 100).alias("num_comments"),
            F.col("n_chars").alias("score"),
            F.col("lang").alias("author"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        c = spread(self.raw("conversations"), "conv_id")
        return c.select(
            F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("id"),
            F.lit("comment").alias("type"),
            F.concat(F.lit("src"), F.col("conv_id") % 20).alias("subreddit"),
            F.col("text").alias("body"),
            (F.lit(EPOCH) + 7200 * F.col("conv_id") + 60 * F.col("turn")).alias("created_utc"),
            F.col("role").alias("author"),
        )

    @cached_property
    def content(self) -> DataFrame:
        """type, id, subreddit, text of posts and comments."""
        from agoraflow.operators.combine import union_content

        return union_content(self.posts, self.comments)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.concat(F.lit("p"), F.col("vec_id")).alias("id"),
            F.lit("post").alias("type"),
            F.col("embedding").cast("array<double>").alias("vector"),
            F.col("vec_id"),
            F.col("label"),
        )

    @cached_property
    def points(self) -> DataFrame:
        return self.vectors.select("id", "type", *placed(F.col("vector")))

    @cached_property
    def blob_points(self) -> DataFrame:
        x, y, z = placed(F.col("vector"))
        return self.vectors.select("id", "type", (x + 2 * (F.col("label") % 5)).alias("x"), y, z)

    @cached_property
    def clusters(self) -> DataFrame:
        label = F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label"))
        return self.vectors.select("id", "type", label.alias("cluster_id"))

    @cached_property
    def combined(self) -> DataFrame:
        from agoraflow.operators.combine import combined_dataset

        return combined_dataset(self.points, self.clusters, self.posts, self.comments)

    @cached_property
    def membership(self) -> DataFrame:
        """Topic of each vector in its community and, for three quarters, in its cluster."""
        v = self.vectors.filter("label > 0")
        community = v.select(
            F.lit("subreddit").alias("scope_type"),
            F.concat(F.lit("src"), F.col("vec_id") % 6).alias("scope_value"),
            (F.col("label") - 1).alias("topic_id"),
            "type",
            "id",
            "vector",
        )
        cluster = v.filter("vec_id % 4 > 0").select(
            F.lit("cluster").alias("scope_type"),
            F.col("label").cast("string").alias("scope_value"),
            (F.col("vec_id") % 4 - 1).cast("int").alias("topic_id"),
            "type",
            "id",
            "vector",
        )
        return cluster.unionByName(community)

    @cached_property
    def topic_texts(self) -> DataFrame:
        """Texts of the topic members that have one."""
        texts = self.content.select("type", "id", "text")
        return self.membership.drop("vector").join(texts, ["type", "id"])

    @cached_property
    def centroids(self) -> DataFrame:
        return topic_centroids(self.membership)

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(cosine_edges(self.centroids, EDGE_THRESHOLD))

    @cached_property
    def topic_words(self) -> DataFrame:
        """The ten most frequent words of each topic: rank, word, n."""
        key = ["scope_type", "scope_value", "topic_id"]
        words = self.topic_texts.select(
            *key, F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")
        ).filter("word != ''")
        counts = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
        return top_per_group(counts, WORDS_PER_TOPIC, key, [F.desc("n"), F.col("word")], "rank")

    @cached_property
    def community_words(self) -> DataFrame:
        return self.topic_words.filter("scope_type = 'subreddit'")


_LIST = ", ".join(f"'{w}'" for w in WHITELIST)


def placed_sql(vector: str) -> str:
    return ", ".join(f"list_dot_product({vector}, CAST({axis} AS DOUBLE[])) AS {name}" for name, axis in zip("xyz", AXES))



# name -> definition
SQL: dict[str, str] = {
    "posts": f"""SELECT 'p' || doc_id AS id, 'post' AS type, source AS subreddit,
        text AS title, concat_ws(' ', source, lang) AS selftext, {EPOCH} + 3600 * doc_id AS created_utc,
        n_chars % 100 AS num_comments, n_chars AS score, lang AS author FROM documents""",
    "comments": f"""SELECT 'c' || conv_id || '_' || turn AS id, 'comment' AS type,
        'src' || (conv_id % 20) AS subreddit, text AS body,
        {EPOCH} + 7200 * conv_id + 60 * turn AS created_utc, role AS author FROM conversations""",
    "content": """SELECT type, id, subreddit, coalesce(title, '') || ' ' || coalesce(selftext, '') AS text FROM posts
        UNION ALL SELECT type, id, subreddit, coalesce(body, '') FROM comments""",
    "vectors": """SELECT 'p' || vec_id AS id, 'post' AS type, CAST(embedding AS DOUBLE[]) AS vector,
        vec_id, label FROM embeddings""",
    "points": f"SELECT id, type, {placed_sql('vector')} FROM vectors",
    "blob_points": """SELECT p.id, p.type, p.x + 2 * (v.label % 5) AS x, p.y, p.z FROM points p JOIN vectors v USING (id)""",
    "clusters": "SELECT id, type, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster_id FROM vectors",
    "combined": r"""SELECT p.id, p.type, p.x, p.y, p.z, c.cluster_id,
        coalesce(t.subreddit, 'Unknown') AS subreddit, regexp_replace(t.text, '^\s+|\s+$', '', 'g') AS text
        FROM points p JOIN clusters c USING (type, id) JOIN content t USING (type, id)
        WHERE regexp_replace(t.text, '^\s+|\s+$', '', 'g') <> ''""",
    "membership": """SELECT 'cluster' AS scope_type, CAST(label AS VARCHAR) AS scope_value,
        CAST(vec_id % 4 - 1 AS INTEGER) AS topic_id, type, id, vector
        FROM vectors WHERE label > 0 AND vec_id % 4 > 0
        UNION ALL SELECT 'subreddit', 'src' || (vec_id % 6), label - 1, type, id, vector
        FROM vectors WHERE label > 0""",
    "topic_texts": """SELECT m.scope_type, m.scope_value, m.topic_id, m.type, m.id, c.text
        FROM membership m JOIN content c USING (type, id)""",
    "centroid_values": """SELECT scope_type, scope_value, topic_id, pos, avg(v) AS value
        FROM (SELECT scope_type, scope_value, topic_id, unnest(vector) AS v,
              generate_subscripts(vector, 1) AS pos FROM membership)
        GROUP BY ALL""",
    "centroid_units": """SELECT scope_type, scope_value, topic_id, pos,
        value / sqrt(sum(value * value) OVER (PARTITION BY scope_type, scope_value, topic_id)) AS value
        FROM centroid_values""",
    "centroids": """SELECT u.scope_type, u.scope_value, u.topic_id, list(u.value ORDER BY u.pos) AS centroid,
        any_value(n.n_docs) AS n_docs
        FROM centroid_units u JOIN (SELECT scope_type, scope_value, topic_id, count(*) AS n_docs
          FROM membership GROUP BY ALL) n USING (scope_type, scope_value, topic_id)
        GROUP BY u.scope_type, u.scope_value, u.topic_id""",
    "edges": f"""SELECT a.scope_type AS source_scope, a.scope_value AS source_value, a.topic_id AS source_topic,
        b.scope_type AS target_scope, b.scope_value AS target_value, b.topic_id AS target_topic,
        list_dot_product(a.centroid, b.centroid) AS similarity
        FROM centroids a JOIN centroids b
          ON (a.scope_type, a.scope_value, a.topic_id) < (b.scope_type, b.scope_value, b.topic_id)
        WHERE list_dot_product(a.centroid, b.centroid) >= {EDGE_THRESHOLD}""",
    "ends": """SELECT source_scope AS scope, source_value AS value, source_topic AS topic,
        target_scope AS other_scope, target_value AS other_value, target_topic AS other_topic, similarity FROM edges
        UNION ALL SELECT target_scope, target_value, target_topic,
        source_scope, source_value, source_topic, similarity FROM edges""",
    "topic_words": f"""SELECT * FROM (
        SELECT scope_type, scope_value, topic_id, word, n, row_number() OVER (
          PARTITION BY scope_type, scope_value, topic_id ORDER BY n DESC, word) AS rank
        FROM (SELECT scope_type, scope_value, topic_id, word, count(*) AS n
              FROM (SELECT scope_type, scope_value, topic_id,
                    unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM topic_texts)
              WHERE word <> '' GROUP BY ALL))
        WHERE rank <= {WORDS_PER_TOPIC}""",
    "community_words": "SELECT * FROM topic_words WHERE scope_type = 'subreddit'",
    "community_sets": """SELECT scope_value AS subreddit, topic_id, list(DISTINCT word) AS words
        FROM community_words GROUP BY ALL""",
    "topic_jaccard": """SELECT a.subreddit AS subreddit_1, a.topic_id AS topic_1, b.subreddit AS subreddit_2,
        b.topic_id AS topic_2, len(list_intersect(a.words, b.words))
          / CAST(len(list_distinct(list_concat(a.words, b.words))) AS DOUBLE) AS jaccard
        FROM community_sets a JOIN community_sets b ON a.subreddit < b.subreddit""",
    "terms": "SELECT unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) AS term",
    "whitelist": f"SELECT unnest([{_LIST}]) AS subreddit",
}


def with_fixtures(sql: str) -> str:
    """Put the definitions of every fixture that ``sql`` reads in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|IN)\s+\(?{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"
