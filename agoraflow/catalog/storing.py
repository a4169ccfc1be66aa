"""Queries of the source and store operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from agoraflow.catalog.filtering import _MATCH
from agoraflow.catalog.fixtures import EPOCH, TERMS, WHITELIST, Tables
from agoraflow.functions.scale import scratch_path, storage_of
from agoraflow.plans import stages
from agoraflow.registry import query
from agoraflow.sources import archives, frames, lists, stores


@query(
    "project_posts",
    f"""SELECT id, subreddit, title, md5(selftext) AS selftext, 'doc/' || substr(id, 2) AS url, created_utc, num_comments, score,
    author, 't5_' || subreddit AS subreddit_id, score % 2 = 0 AS over_18, created_utc + 100 AS retrieved_on FROM posts""",
)
def _(t: Tables):
    # every value as text, the way a dump line may hold it
    raw = t.posts.select(
        "id", "subreddit", "title", "selftext",
        F.concat(F.lit("doc/"), F.expr("substr(id, 2)")).alias("url"),
        *[F.col(c).cast("string").alias(c) for c in ("created_utc", "num_comments", "score")],
        "author",
        F.concat(F.lit("t5_"), "subreddit").alias("subreddit_id"),
        (F.col("score") % 2 == 0).cast("string").alias("over_18"),
        (F.col("created_utc") + 100).cast("string").alias("retrieved_on"),
    )
    return archives.project(raw, "posts").withColumn("selftext", F.md5("selftext"))


@query(
    "project_comments",
    f"""SELECT id, subreddit, md5(body) AS body, 'l' || substr(id, 2) AS link_id, 'p' || substr(id, 2) AS parent_id, created_utc,
    CAST(length(body) AS BIGINT) AS score, author, 't5_' || subreddit AS subreddit_id, created_utc - {EPOCH} AS retrieved_on
    FROM comments""",
)
def _(t: Tables):
    raw = t.comments.select(
        "id", "subreddit", "body",
        F.concat(F.lit("l"), F.expr("substr(id, 2)")).alias("link_id"),
        F.concat(F.lit("p"), F.expr("substr(id, 2)")).alias("parent_id"),
        F.col("created_utc").cast("string").alias("created_utc"),
        F.length("body").cast("string").alias("score"),
        "author",
        F.concat(F.lit("t5_"), "subreddit").alias("subreddit_id"),
        (F.col("created_utc") - EPOCH).cast("string").alias("retrieved_on"),
    )
    return archives.project(raw, "comments").withColumn("body", F.md5("body"))


@query(
    "discover_archives",
    r"""SELECT url, regexp_extract(name, '(?i)RC_(\d{4})-(\d{2})\.zst$', 1) AS year FROM (
      SELECT url, (CASE page_id % 3 WHEN 0 THEN 'RC_' WHEN 1 THEN 'rc_' ELSE 'RS_' END) || (2023 + page_id % 4) || '-07.zst' AS name
      FROM pages) WHERE regexp_extract(name, '(?i)RC_(\d{4})-(\d{2})\.zst$', 1) IN ('2024', '2025')""",
)
def _(t: Tables):
    k = F.col("page_id") % 3
    prefix = F.when(k == 0, "RC_").when(k == 1, "rc_").otherwise("RS_")
    name = F.concat(prefix, (F.lit(2023) + F.col("page_id") % 4).cast("string"), F.lit("-07.zst"))
    named = t.raw("pages").select("url", name.alias("name"))
    return named.filter(archives.is_archive(F.col("name"), "comments", [2024, 2025])).select(
        "url", F.regexp_extract("name", archives.archive_pattern("comments"), 1).alias("year")
    )


@query(
    "load_whitelist",
    r"""SELECT DISTINCT lower(trim(line)) AS subreddit FROM (
      SELECT CASE WHEN doc_id % 50 = 0 THEN '   ' ELSE '  ' || upper(source) || ' ' END AS line FROM documents)
    WHERE trim(line) <> ''""",
)
def _(t: Tables):
    line = F.when(F.col("doc_id") % 50 == 0, "   ").otherwise(F.concat(F.lit("  "), F.upper("source"), F.lit(" ")))
    return lists.clean_whitelist(t.raw("documents").select(line.alias("value")))


@query(
    "load_terms",
    r"""SELECT DISTINCT term, regexp_replace(term, '([()\[\]{}?*+\-|^$\\.&~# ])', '\\\1', 'g') AS pattern FROM (
      SELECT lower(p_type) AS term FROM part UNION ALL
      SELECT unnest(string_split(lower(p_type || ' ai ' || p_brand), ' ')) FROM part)
    WHERE length(term) >= 3 OR term = 'ai'""",
)
def _(t: Tables):
    part = t.raw("part")
    words = part.select(
        F.explode(F.split(F.concat("p_type", F.lit(" ai "), "p_brand"), " ")).alias("value")
    )
    return lists.clean_terms(part.select(F.concat(F.lit(" "), "p_type").alias("value")).unionByName(words))


@query(
    "ingest_state",
    """SELECT filepath, last_line, status FROM (
      SELECT event_type || '/' || user_id AS filepath, event_id AS last_line,
        CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'in_progress' END AS status,
        row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC,
          CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'in_progress' END) AS rn FROM events) WHERE rn = 1""",
)
def _(t: Tables):
    changes = t.raw("events").select(
        F.concat_ws("/", "event_type", "user_id").alias("filepath"),
        F.col("event_id").alias("last_line"),
        F.when(F.col("event_id") % 2 == 0, "done").otherwise("in_progress").alias("status"),
        F.col("ts").alias("updated_at"),
    )
    return stores.latest_state(changes).drop("updated_at")


@query(
    "dedup_by_id",
    """SELECT id, retrieved_on, event_id FROM (
      SELECT user_id AS id, event_id // 10 AS retrieved_on, event_id,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id // 10 DESC, event_id) AS rn
      FROM events) WHERE rn = 1""",
)
def _(t: Tables):
    rows = t.raw("events").select(
        F.col("user_id").alias("id"), F.expr("event_id div 10").alias("retrieved_on"), "event_id"
    )
    return stores.dedup_by_id(rows)


@query(
    "duplicate_keys",
    "SELECT user_id AS id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1",
)
def _(t: Tables):
    return stores.duplicate_keys(t.raw("events").select(F.col("user_id").alias("id")))


@query(
    "replace_scope",
    """SELECT scope_type, scope_value, topic_id, n_docs FROM centroids
      WHERE NOT (scope_type = 'subreddit' AND scope_value IN ('src1', 'src2'))
    UNION ALL SELECT scope_type, scope_value, topic_id + 100, n_docs FROM centroids
      WHERE scope_type = 'subreddit' AND scope_value IN ('src1', 'src2') AND topic_id < 4""",
)
def _(t: Tables):
    old = t.centroids.drop("centroid")
    new = old.filter("scope_type = 'subreddit' AND scope_value IN ('src1', 'src2') AND topic_id < 4")
    return stores.replace_scope(old, new.withColumn("topic_id", F.col("topic_id") + 100))


@query(
    "load_optional_union",
    """SELECT scope_type, scope_value, topic_id, n_docs,
      CASE WHEN scope_type = 'cluster' THEN CAST(scope_value AS INTEGER) END AS cluster_id FROM centroids""",
)
def _(t: Tables):
    narrow = t.centroids.drop("centroid")
    clusters = narrow.filter("scope_type = 'cluster'").select(
        F.col("scope_value").cast("int").alias("cluster_id"), "topic_id", "n_docs"
    )
    return stores.union_centroids([clusters, narrow.filter("scope_type = 'subreddit'")])


# ---- round trips through files ----


@query(
    "read_archive",
    """SELECT id, subreddit, created_utc, md5(title) AS title, md5(selftext) AS selftext, num_comments,
    'archive' AS source_dir FROM posts""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "archive")
    lines = t.posts.select(F.to_json(F.struct("id", "subreddit", "created_utc", "title", "selftext", "num_comments")).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    rows = archives.read_archives(t.spark, [path], "posts")
    return rows.select(
        "id", "subreddit", "created_utc", F.md5("title").alias("title"), F.md5("selftext").alias("selftext"),
        "num_comments", F.when(F.col("source_file").endswith(".txt.gz"), "archive").alias("source_dir"),
    )


@query(
    "ingest_stage",
    f"SELECT id, subreddit, created_utc FROM posts WHERE lower(subreddit) IN (SELECT subreddit FROM whitelist) AND {_MATCH}",
)
def _(t: Tables):
    # archives in, listed communities and matching rows out, repeats of an id left out
    path = scratch_path(t.spark, "ingest")
    lines = t.posts.select(F.to_json(F.struct("id", "subreddit", "created_utc", "title", "selftext", "num_comments")).alias("value"))
    lines.unionByName(lines).write.option("compression", "gzip").text(path)
    names = t.spark.createDataFrame([(w,) for w in WHITELIST], "subreddit string")
    return stages.ingest(t.spark, [path], "posts", names, TERMS).select("id", "subreddit", "created_utc")


def write_frames(folder: str, name: str):
    """Write the lines of a task as one archive ``name``-MM.zst of several frames whose borders lie inside lines.

    Each task has a folder and thereby a file of its own.
    """

    def run(batches):
        import zstandard

        own = f"{folder}/{uuid.uuid4().hex}"
        storage, inner = storage_of(own)
        storage.create_dir(inner, recursive=True)
        text = "".join(line + "\n" for batch in batches for line in batch.column(0).to_pylist()).encode()
        if not text:
            return
        file, size = f"{name}-07.zst", max(1, len(text) // 8)
        with storage.open_output_stream(f"{inner}/{file}", compression=None) as out:
            for a in range(0, len(text), size):
                out.write(zstandard.ZstdCompressor().compress(text[a : a + size]))
        yield pa.RecordBatch.from_arrays([pa.array([f"{own}/{file}"])], names=["path"])

    return run


@query(
    "read_framed_archive",
    """SELECT id, subreddit, created_utc, md5(title) AS title, num_comments, CAST(NULL AS VARCHAR) AS bad FROM posts
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, '{' || id FROM posts WHERE created_utc % 7 = 0""",
)
def _(t: Tables):
    # archives of several frames, with lines that are no JSON among the rows
    line = F.to_json(F.struct("id", "subreddit", "created_utc", "title", "selftext", "num_comments"))
    broken = F.when(F.col("created_utc") % 7 == 0, F.concat(F.lit("{"), "id"))
    lines = t.posts.select(F.explode(F.filter(F.array(line, broken), lambda v: v.isNotNull())).alias("value"))
    written = lines.mapInArrow(write_frames(scratch_path(t.spark, "frames"), "RS_2025"), "path string").collect()
    rows = frames.read_framed_archives(t.spark, [r["path"] for r in written], "posts", partition_bytes=1 << 14)
    return rows.select("id", "subreddit", "created_utc", F.md5("title").alias("title"), "num_comments", F.col("bad_line").alias("bad"))


@query("append_rows", "SELECT id, subreddit, subreddit AS source_file FROM posts")
def _(t: Tables):
    path = scratch_path(t.spark, "append")
    rows = t.posts.select("id", "subreddit", F.col("subreddit").alias("source_file"))
    stores.append_rows(rows, path)
    # loading some files again replaces their rows
    stores.append_rows(rows.filter("subreddit < 'src3'"), path)
    return stores.read_table(t.spark, path, rows.schema)


@query("overwrite_output", "SELECT id, score FROM posts WHERE score >= 500")
def _(t: Tables):
    path = scratch_path(t.spark, "output")
    stores.write_table(t.posts.select("id", "score"), path)
    stores.write_table(t.posts.select("id", "score").filter("score >= 500"), path)
    return stores.read_table(t.spark, path)


@query(
    "topic_table",
    """SELECT scope_type, scope_value, topic_id, CAST(rank AS INTEGER) AS rank, word FROM topic_words
    WHERE scope_type = 'subreddit' AND scope_value = 'src2'""",
)
def _(t: Tables):
    path = scratch_path(t.spark, "topics")
    stores.write_scope(t.topic_words.drop("n"), path)
    return stores.read_scope(t.spark, path, "subreddit", "src2").select(
        "scope_type", "scope_value", "topic_id", "rank", "word"
    )


@query(
    "report_files",
    """SELECT cluster_id, string_agg(subreddit, ', ' ORDER BY rn) AS top_subreddits FROM (
      SELECT cluster_id, subreddit, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, subreddit) AS rn
      FROM combined GROUP BY cluster_id, subreddit) WHERE rn <= 5 GROUP BY cluster_id""",
)
def _(t: Tables):
    from pyspark.sql.types import IntegerType, StringType, StructType

    from agoraflow.operators.aggregates import top_communities_per_cluster

    path = scratch_path(t.spark, "report")
    stores.write_report(top_communities_per_cluster(t.combined), path)
    schema = StructType().add("cluster_id", IntegerType()).add("top_subreddits", StringType())
    return stores.read_report(t.spark, path, schema)
