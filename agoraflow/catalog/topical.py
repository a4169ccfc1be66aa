"""Queries of the token, n-gram and topic operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoraflow.catalog.fixtures import STOP_WORDS, Tables
from agoraflow.catalog.graphs import _TOPIC_COUNTS, _topic_counts
from agoraflow.functions import vectors as vec
from agoraflow.functions.scale import materialize
from agoraflow.operators import aggregates as agg
from agoraflow.operators import similarity, tokens, topics
from agoraflow.registry import query

_KEY = ["scope_type", "scope_value", "topic_id"]

# ---- vocabulary and tokens ----

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 1)"
_VOCABULARY = f"""SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) + 2 AS INTEGER) AS token
    FROM (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM content) GROUP BY word HAVING count(*) >= 3)"""


@query("build_vocabulary", _VOCABULARY)
def _(t: Tables):
    return tokens.build_vocabulary(t.content, min_count=3)


@query(
    "tokenize",
    f"""WITH v AS ({_VOCABULARY}),
    w AS (SELECT type, id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
          FROM (SELECT type, id, {_WORDS} AS words FROM content)),
    j AS (SELECT type, id, string_agg(CAST(coalesce(v.token, 0) AS VARCHAR), ' ' ORDER BY pos) AS body, count(*) AS n
          FROM w LEFT JOIN v USING (word) GROUP BY type, id)
    SELECT c.type, c.id, md5('1 ' || coalesce(j.body || ' ', '') || '2') AS digest, coalesce(j.n, 0) + 2 AS n_tokens
    FROM content c LEFT JOIN j USING (type, id)""",
)
def _(t: Tables):
    vocabulary = tokens.build_vocabulary(t.content, min_count=3)
    rows = tokens.tokenize(t.content, vocabulary)
    return rows.select(
        "type", "id",
        F.md5(F.concat_ws(" ", F.col("tokens").cast("array<string>"))).alias("digest"),
        F.size("tokens").cast("long").alias("n_tokens"),
    )


_POOL_TOKENS = r"""SELECT id, token, count(*) AS w FROM (
      SELECT id, (length(word) * 31 + ascii(word)) % 600 AS token FROM (
        SELECT id, unnest(list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM comments))
    GROUP BY id, token"""


def _pool(t: Tables):
    words = F.filter(F.split(F.lower("body"), "[^a-z0-9]+"), lambda w: w != "")
    ids = F.transform(words, lambda w: (F.length(w) * 31 + F.ascii(w)) % 600)
    docs = t.comments.select("id", ids.alias("tokens"))
    table = t.vectors.select(F.col("vec_id").cast("int").alias("token"), "vector")
    return tokens.mean_pool_tokens(docs, table, ["id"])


@query(
    "mean_pool_tokens",
    f"""SELECT id, pos, round(sum(w * v) / sum(w), 6) AS value FROM (
      SELECT p.id, p.w, unnest(v.vector) AS v, generate_subscripts(v.vector, 1) AS pos
      FROM ({_POOL_TOKENS}) p JOIN vectors v ON v.vec_id = p.token) GROUP BY id, pos""",
)
def _(t: Tables):
    rows = _pool(t).select("id", F.posexplode("vector").alias("p", "v"))
    return rows.select("id", (F.col("p") + 1).cast("long").alias("pos"), F.round("v", 6).alias("value"))


@query(
    "mean_pool",
    f"""SELECT id, round(sqrt(sum(value * value)), 6) AS norm FROM (
      SELECT id, pos, sum(w * v) / sum(w) AS value FROM (
        SELECT p.id, p.w, unnest(v.vector) AS v, generate_subscripts(v.vector, 1) AS pos
        FROM ({_POOL_TOKENS}) p JOIN vectors v ON v.vec_id = p.token) GROUP BY id, pos) GROUP BY id""",
)
def _(t: Tables):
    return _pool(t).select("id", F.round(vec.l2_norm(F.col("vector")), 6).alias("norm"))


@query(
    "tokenize_chunks",
    f"""WITH v AS ({_VOCABULARY}),
    w AS (SELECT type, id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
          FROM (SELECT type, id, {_WORDS} AS words FROM content)),
    j AS (SELECT type, id, (pos - 1) // 62 AS chunk,
            string_agg(CAST(coalesce(v.token, 0) AS VARCHAR), ' ' ORDER BY pos) AS body, count(*) AS n
          FROM w LEFT JOIN v USING (word) GROUP BY ALL)
    SELECT c.type, c.id, CAST(coalesce(j.chunk, 0) AS INTEGER) AS chunk,
      md5('1 ' || coalesce(j.body || ' ', '') || '2') AS digest, coalesce(j.n, 0) + 2 AS n_tokens
    FROM content c LEFT JOIN j USING (type, id)""",
)
def _(t: Tables):
    rows = tokens.tokenize_chunks(t.content, tokens.build_vocabulary(t.content, min_count=3), 64)
    return rows.select(
        "type", "id", "chunk",
        F.md5(F.concat_ws(" ", F.col("tokens").cast("array<string>"))).alias("digest"),
        F.size("tokens").cast("long").alias("n_tokens"),
    )


_HEX = "list_sum(list_transform(range(8), lambda i: (strpos('0123456789abcdef', substr(h, CAST(i + 1 AS INTEGER), 1)) - 1) * CAST(pow(16, 7 - i) AS BIGINT)))"
_EMBEDDED = f"""WITH w AS (SELECT type, id, md5(unnest({_WORDS})) AS h FROM content),
    n AS (SELECT type, id, CAST({_HEX} AS BIGINT) % 768 AS dim, count(*) AS n FROM w GROUP BY ALL),
    f AS (SELECT dim, ln(((SELECT count(*) FROM (SELECT DISTINCT type, id FROM n)) + 1) / (count(*) + 1)::DOUBLE) AS idf
          FROM n GROUP BY dim),
    v AS (SELECT type, id, dim, n.n * idf AS x FROM n JOIN f USING (dim)),
    u AS (SELECT type, id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY type, id)) AS value, x FROM v)"""


@query("embed_documents", f"{_EMBEDDED} SELECT type, id, dim AS pos, round(value, 6) AS value FROM u WHERE round(value, 6) > 0")
def _(t: Tables):
    rows = tokens.embed_documents(t.content).select("type", "id", F.posexplode("vector").alias("pos", "value"))
    return rows.select("type", "id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value")).filter("value > 0")


# ---- functions of one's own over Arrow batches ----


@query(
    "user_tokenizer",
    f"""SELECT type, id, array_to_string(list_transform({_WORDS}, lambda w: length(w) % 100), ' ') AS tokens FROM content""",
)
def _(t: Tables):
    def lengths(batches):
        import regex

        words = regex.compile(r"[\p{L}\p{N}]+")
        for pdf in batches:
            pdf["tokens"] = [[len(w) % 100 for w in words.findall((text or "").lower())] for text in pdf["text"]]
            yield pdf[["type", "id", "tokens"]]

    rows = tokens.tokenize_with(t.content.select("type", "id", "text"), lengths, "type string, id string, tokens array<int>")
    return rows.select("type", "id", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


@query("user_encoder", "SELECT type, id, length(text)::DOUBLE AS size, (length(text) % 7)::DOUBLE AS rest FROM content")
def _(t: Tables):
    def sizes(batches):
        for pdf in batches:
            pdf["vector"] = [[float(len(text)), float(len(text) % 7)] for text in pdf["text"]]
            yield pdf[["type", "id", "vector"]]

    # every document twice: each key is encoded once
    docs = t.content.select("type", "id", "text")
    rows = tokens.embed_with(docs.unionByName(docs), sizes, schema="type string, id string, vector array<double>")
    return rows.select("type", "id", F.col("vector")[0].alias("size"), F.col("vector")[1].alias("rest"))


# ---- n-grams and topic words ----

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_CLEAN = rf"""list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'),
      lambda w: length(w) >= 2 AND w NOT IN ({_STOPS}))"""
_GRAMS = f"""WITH d AS (SELECT scope_type, scope_value, topic_id, {_CLEAN} AS words FROM topic_texts),
    p AS (SELECT scope_type, scope_value, topic_id, words, unnest(range(1, len(words) + 1)) AS i FROM d),
    g AS (SELECT scope_type, scope_value, topic_id, words[i] AS term FROM p
      UNION ALL SELECT scope_type, scope_value, topic_id, words[i] || ' ' || words[i + 1] FROM p WHERE i + 1 <= len(words)
      UNION ALL SELECT scope_type, scope_value, topic_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]
        FROM p WHERE i + 2 <= len(words)),
    c AS (SELECT scope_type, scope_value, topic_id, term, count(*) AS n FROM g GROUP BY ALL),
    k AS (SELECT *, count(*) OVER (PARTITION BY scope_type, scope_value, term) AS df,
            CAST(sum(n) OVER (PARTITION BY scope_type, scope_value, term) AS BIGINT) AS total FROM c),
    counts AS (SELECT scope_type, scope_value, topic_id, term, n, total FROM k WHERE df >= 2)"""
_WEIGHTS = f"""{_GRAMS},
    classes AS (SELECT *, floor(avg(s) OVER (PARTITION BY scope_type, scope_value)) AS a FROM (
      SELECT scope_type, scope_value, topic_id, sum(n) AS s FROM counts GROUP BY ALL)),
    weights AS (SELECT scope_type, scope_value, topic_id, term,
        sqrt(n / s::DOUBLE) * ln(1 + (a - total + 0.5) / (total + 0.5)) AS weight
      FROM counts JOIN classes USING (scope_type, scope_value, topic_id)),
    top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope_type, scope_value, topic_id
      ORDER BY weight DESC, term) AS INTEGER) AS rank FROM weights) WHERE rank <= 10),
    sizes AS (SELECT scope_type, scope_value, topic_id, count(*) AS n_docs FROM membership GROUP BY ALL)"""


def _counts(t: Tables):
    return tokens.ngram_counts(t.topic_texts, stop_words=STOP_WORDS)


def _weights(t: Tables):
    return topics.class_tfidf(materialize(_counts(t)))


def _words(t: Tables):
    return topics.top_words(_weights(t))


@query("ngram_counts", f"{_GRAMS} SELECT * FROM counts")
def _(t: Tables):
    return _counts(t)


@query(
    "ctfidf_bm25",
    f"{_WEIGHTS} SELECT scope_type, scope_value, topic_id, term, round(weight, 6) AS weight FROM weights",
)
def _(t: Tables):
    return _weights(t).withColumn("weight", F.round("weight", 6))


@query(
    "top_words",
    f"{_WEIGHTS} SELECT scope_type, scope_value, topic_id, rank, term AS word, round(weight, 6) AS weight FROM top",
)
def _(t: Tables):
    return _words(t).withColumn("weight", F.round("weight", 6))


@query(
    "topic_info",
    f"""{_WEIGHTS} SELECT s.scope_type, s.scope_value, s.topic_id, s.n_docs,
      string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS label
    FROM sizes s LEFT JOIN top USING (scope_type, scope_value, topic_id) GROUP BY ALL""",
)
def _(t: Tables):
    return topics.topic_info(t.membership, _words(t))


@query(
    "get_topics",
    f"""{_WEIGHTS} SELECT scope_type, scope_value, topic_id, count(*) AS n_words,
      string_agg(term, '|' ORDER BY rank) AS words FROM top GROUP BY ALL""",
)
def _(t: Tables):
    rows = topics.get_topics(_words(t))
    return rows.select(
        *_KEY, F.size("words").cast("long").alias("n_words"),
        F.concat_ws("|", F.transform("words", lambda s: s["word"])).alias("words"),
    )


@query(
    "topic_words",
    f"""{_WEIGHTS} SELECT scope_type, scope_value, topic_id, rank, term AS word, round(weight, 6) AS weight FROM top
    WHERE scope_type = 'subreddit' AND scope_value = 'src2' AND topic_id = 3 AND rank <= 5""",
)
def _(t: Tables):
    rows = topics.topic_words(_words(t), "subreddit", "src2", 3, 5)
    return rows.withColumn("weight", F.round("weight", 6))


_DETAILS = f"""SELECT scope_type AS model_type, scope_type || '_' || scope_value AS model_name, topic_id,
      any_value(n_docs) AS document_count, string_agg(term, ', ' ORDER BY rank) AS top_words
    FROM sizes LEFT JOIN top USING (scope_type, scope_value, topic_id) GROUP BY scope_type, scope_value, topic_id"""


@query("topic_details", f"{_WEIGHTS} {_DETAILS}")
def _(t: Tables):
    return topics.topic_details(t.membership, _words(t))


@query(
    "dominant_topic",
    f"""{_WEIGHTS}, details AS ({_DETAILS})
    SELECT subreddit, topic_id AS dominant_topic_id, document_count AS topic_doc_count, CAST(total AS BIGINT) AS subreddit_total_docs,
      round_even(document_count / total * 100, 1) AS pct_of_subreddit, top_words FROM (
        SELECT replace(model_name, 'subreddit_', '') AS subreddit, topic_id, document_count, top_words,
          sum(document_count) OVER (PARTITION BY model_name)::DOUBLE AS total,
          row_number() OVER (PARTITION BY model_name ORDER BY document_count DESC, topic_id) AS rn
        FROM details WHERE model_type = 'subreddit') WHERE rn = 1""",
)
def _(t: Tables):
    return agg.dominant_topics(topics.topic_details(t.membership, _words(t)))


@query(
    "mmr_words",
    f"""{_WEIGHTS.replace("WITH d", "WITH RECURSIVE d", 1)},
    candidates AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope_type, scope_value, topic_id ORDER BY weight DESC, term) AS was
      FROM weights) WHERE was <= 30),
    dd AS (SELECT scope_type, scope_value, topic_id, type, id, {_CLEAN} AS words FROM topic_texts),
    dp AS (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM dd),
    dt AS (SELECT DISTINCT scope_type, scope_value, topic_id, type, id, unnest([words[i],
      CASE WHEN i + 1 <= len(words) THEN words[i] || ' ' || words[i + 1] END,
      CASE WHEN i + 2 <= len(words) THEN words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END]) AS term FROM dp),
    placed AS (SELECT scope_type || '/' || scope_value || '/' || topic_id AS k, c.*, v.type, v.id, v.vector
      FROM candidates c JOIN dt USING (scope_type, scope_value, topic_id, term) JOIN vectors v USING (type, id)),
    flat AS (SELECT k, term, unnest(vector) AS v, generate_subscripts(vector, 1) AS i FROM placed),
    means AS (SELECT k, term, i, avg(v) AS v FROM flat GROUP BY ALL),
    units AS (SELECT k, term, list(v ORDER BY i) AS u FROM (SELECT k, term, i, v / sqrt(sum(v * v) OVER (PARTITION BY k, term)) AS v FROM means)
      GROUP BY k, term),
    entries AS MATERIALIZED (SELECT DISTINCT p.k, p.scope_type, p.scope_value, p.topic_id, term, weight, was, u,
      list_dot_product(u, m.centroid) AS fits FROM placed p JOIN units USING (k, term) JOIN centroids m USING (scope_type, scope_value, topic_id)),
    alike AS MATERIALIZED (SELECT a.k, a.term, b.term AS other, list_dot_product(a.u, b.u) AS s FROM entries a JOIN entries b USING (k)),
    walk AS (SELECT 0 AS step, k, term, was, fits, CAST(NULL AS DOUBLE) AS close_to, CAST(NULL AS INTEGER) AS rank FROM entries
      UNION ALL
      SELECT step + 1, o.k, o.term, was, fits, greatest(close_to, s),
        CASE WHEN rank IS NULL AND o.term = pick THEN step + 1 ELSE rank END
      FROM (SELECT *, first_value(term) OVER (PARTITION BY k
          ORDER BY rank IS NOT NULL, round(0.5 * fits - 0.5 * coalesce(close_to, 0), 9) DESC, was) AS pick FROM walk) o
      JOIN alike a ON a.k = o.k AND a.term = o.term AND a.other = o.pick WHERE step < 10)
    SELECT scope_type, scope_value, topic_id, CAST(w.rank AS INTEGER) AS rank, term AS word, round(weight, 6) AS weight
    FROM walk w JOIN entries USING (k, term) WHERE step = 10 AND w.rank IS NOT NULL""",
)
def _(t: Tables):
    weights = _weights(t)
    candidates = materialize(topics.top_words(weights, 30))
    terms = tokens.document_terms(t.topic_texts, stop_words=STOP_WORDS).withColumnRenamed("term", "word")
    term_docs = topics.candidate_documents(terms, candidates)
    return topics.mmr_words(candidates, term_docs, t.vectors, t.centroids).withColumn("weight", F.round("weight", 6))


# ---- comparison of communities ----


@query(
    "word_set_ops",
    """SELECT a.subreddit, a.topic_id, len(list_intersect(a.words, b.words)) AS n_shared,
      len(list_distinct(list_concat(a.words, b.words))) AS n_all
    FROM community_sets a JOIN community_sets b ON a.subreddit = b.subreddit AND b.topic_id = 0""",
)
def _(t: Tables):
    sets = similarity.word_sets(t.community_words)
    first = sets.filter("topic_id = 0").select("scope_value", F.col("words").alias("first"))
    return sets.join(first, "scope_value").select(
        F.col("scope_value").alias("subreddit"),
        "topic_id",
        F.size(F.array_intersect("words", "first")).cast("long").alias("n_shared"),
        F.size(F.array_union("words", "first")).cast("long").alias("n_all"),
    )


@query(
    "jaccard",
    """SELECT subreddit_1, topic_1, subreddit_2, topic_2, round(jaccard, 6) AS jaccard FROM topic_jaccard
    WHERE topic_1 = topic_2""",
)
def _(t: Tables):
    sets = similarity.word_sets(t.community_words)
    one = sets.select(F.col("scope_value").alias("subreddit_1"), "topic_id", F.col("words").alias("a"))
    two = sets.select(F.col("scope_value").alias("subreddit_2"), "topic_id", F.col("words").alias("b"))
    pairs = one.join(two, "topic_id").filter("subreddit_1 < subreddit_2")
    return pairs.select(
        "subreddit_1", F.col("topic_id").alias("topic_1"), "subreddit_2", F.col("topic_id").alias("topic_2"),
        F.round(vec.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"),
    )


@query(
    "shared_topics",
    """SELECT subreddit_1, topic_1, subreddit_2, topic_2, round(jaccard, 6) AS jaccard FROM topic_jaccard
    WHERE jaccard >= 0.3""",
)
def _(t: Tables):
    return similarity.shared_topics(t.community_words, 0.3).withColumn("jaccard", F.round("jaccard", 6))


_SHARED = """SELECT subreddit_1, subreddit_2, count(*) AS shared FROM topic_jaccard WHERE jaccard >= 0.3 GROUP BY 1, 2"""
_SCORES = f"""SELECT a.subreddit AS subreddit_1, b.subreddit AS subreddit_2,
      s.shared / greatest(a.n_topics, b.n_topics)::DOUBLE AS score, s.shared
    FROM ({_SHARED}) s JOIN ({_TOPIC_COUNTS}) a ON s.subreddit_1 = a.subreddit
    JOIN ({_TOPIC_COUNTS}) b ON s.subreddit_2 = b.subreddit"""


@query(
    "topic_overlap_score",
    f"""SELECT subreddit_1, subreddit_2, round(score, 6) AS score FROM ({_SCORES})
    UNION ALL SELECT subreddit_2, subreddit_1, round(score, 6) FROM ({_SCORES})
    UNION ALL SELECT subreddit, subreddit, 1.0::DOUBLE FROM ({_TOPIC_COUNTS})""",
)
def _(t: Tables):
    shared = similarity.shared_topic_counts(t.community_words, 0.3)
    scores = topics.topic_overlap_score(shared, _topic_counts(t))
    return scores.withColumn("score", F.round("score", 6))


@query(
    "combined_similarity",
    f"""WITH sets AS (SELECT subreddit, list(DISTINCT cluster_id) AS c FROM combined WHERE cluster_id <> -1
      AND subreddit IN (SELECT subreddit FROM ({_TOPIC_COUNTS})) GROUP BY subreddit),
    near AS (SELECT a.subreddit AS subreddit_1, b.subreddit AS subreddit_2, len(list_intersect(a.c, b.c)) AS k,
      len(list_distinct(list_concat(a.c, b.c)))::DOUBLE AS u FROM sets a JOIN sets b
      ON a.subreddit < b.subreddit AND len(list_intersect(a.c, b.c)) > 0)
    SELECT subreddit_1, subreddit_2, coalesce(s.shared, 0) AS shared_topics, coalesce(k, 0) AS shared_clusters,
      round((least(coalesce(s.score, 0), 1) + coalesce(k / u, 0)) / 2, 6) AS combined_score
    FROM ({_SCORES}) s FULL JOIN near USING (subreddit_1, subreddit_2)""",
)
def _(t: Tables):
    shared = materialize(similarity.shared_topic_counts(t.community_words, 0.3))
    rows = topics.combined_similarity(shared, _topic_counts(t), t.combined)
    return rows.withColumn("combined_score", F.round("combined_score", 6))
