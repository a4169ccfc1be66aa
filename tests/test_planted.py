"""Small frames with a known answer."""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from agoraflow import schemas
from agoraflow.functions import scale, text
from agoraflow.operators import aggregates, combine, filters, graph, ranking, sampling, similarity, tokens, topics
from agoraflow.sources import lists, stores


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- text and keywords ----


def test_text_rules(spark):
    posts = frame(
        spark,
        [("1", "s", None, "body"), ("2", "s", "title", None), ("3", "s", "  \t", "　\n")],
        "id string, subreddit string, title string, selftext string",
    )
    none = frame(spark, [], "id string, subreddit string, body string")
    rows = {r["id"]: r["text"] for r in combine.union_content(posts, none).collect()}
    assert rows == {"1": " body", "2": "title ", "3": "  \t 　\n"}
    kept = {r["id"]: r["text"] for r in filters.drop_blank_text(combine.union_content(posts, none)).collect()}
    assert kept == {"1": "body", "2": "title"}


def test_word_boundaries(spark):
    df = frame(
        spark,
        [("1", "i like gpt"), ("2", "chatgpt"), ("3", "égpt"), ("4", "c++ rocks"), ("5", "GPT_4"), ("6", None)],
        "id string, title string",
    )
    ids = lambda d: sorted(r["id"] for r in d.select("id").collect())
    assert ids(df.filter(filters.matches_any_term(["gpt", "c++"], ["title"]))) == ["1", "3", "4"]
    terms = lists.clean_terms(frame(spark, [("gpt",), ("C++",)], "value string"))
    assert ids(filters.match_terms_by_join(df, terms, ["title"])) == ["1", "3", "4"]


def test_term_join_equals_alternation(spark):
    words = ["alpha", "beta gamma", "g-3", "x_y", "+++"]
    texts = ["an alpha here", "beta gamma", "beta  gamma", "big-3 g-3", "x_y z", "ax_y", "a +++ b", "alphabet", ""]
    df = frame(spark, [(str(i), t) for i, t in enumerate(texts)], "id string, title string")
    one = df.filter(filters.matches_any_term(words, ["title"])).select("id")
    terms = lists.clean_terms(frame(spark, [(w,) for w in words], "value string"))
    two = filters.match_terms_by_join(df, terms, ["title"]).select("id")
    assert sorted(one.collect()) == sorted(two.collect())


def test_every_term_and_the_whole_text_count(spark):
    terms = [f"term{i:02d}" for i in range(45)]
    rows = [("1", "s", "has term03", ""), ("2", "s", "x " * 5000 + "term44", ""), ("3", "s", "term450", "")]
    df = frame(spark, rows, "id string, subreddit string, title string, selftext string")
    assert sorted(r["id"] for r in filters.keyword_filter(df, terms, "posts").collect()) == ["1", "2"]
    table = lists.clean_terms(frame(spark, [(t,) for t in terms], "value string"))
    assert sorted(r["id"] for r in filters.match_terms_by_join(df, table, ["title"]).collect()) == ["1", "2"]


def test_selftext_only_hit_is_dropped_unless_matched(spark):
    df = frame(spark, [("1", "s", "no", "a gpt here")], "id string, subreddit string, title string, selftext string")
    assert filters.keyword_filter(df, ["gpt"], "posts").count() == 0
    assert filters.keyword_filter(df, ["gpt"], "posts", match_cols=["title", "selftext"]).count() == 1


def test_short_terms_and_escaping(spark):
    df = frame(spark, [("ai",), ("ml",), (" GPT ",), ("gpt",), ("",), ("c++",)], "value string")
    rows = {r["term"]: r["pattern"] for r in lists.clean_terms(df).collect()}
    assert rows == {"ai": "ai", "gpt": "gpt", "c++": "c\\+\\+"}
    assert lists.term_list(lists.clean_terms(df)) == ["ai", "c++", "gpt"]


def test_whitelist(spark):
    names = lists.clean_whitelist(frame(spark, [("X",), ("x",), ("",), (" y ",)], "value string"))
    assert sorted(r["subreddit"] for r in names.collect()) == ["x", "y"]
    df = frame(spark, [("1", "X"), ("2", "z"), ("3", "Y")], "id string, subreddit string")
    doubled = names.unionByName(names)
    assert sorted(r["id"] for r in combine.whitelist_join(df, doubled).collect()) == ["1", "3"]


def test_name_helpers(spark):
    df = frame(spark, [("a_topic_topic3", "a/b\\c", "subreddit_subreddit_x")], "k string, n string, m string")
    scope, topic = text.split_topic_key(F.col("k"))
    row = df.select(scope, topic, text.safe_name(F.col("n")), text.drop_first_prefix(F.col("m"))).first()
    assert tuple(row) == ("a_topic", 3, "a_b_c", "subreddit_x")


# ---- keys, state, scopes ----


def test_same_id_in_both_kinds_does_not_fan_out(spark):
    coords = frame(spark, [("7", "post", 0.0, 0.0, 0.0), ("7", "comment", 1.0, 1.0, 1.0)], "id string, type string, x double, y double, z double")
    labels = frame(spark, [("7", "post", 1), ("7", "comment", 2)], "id string, type string, cluster_id int")
    posts = frame(spark, [("7", "s", "t", "b")], "id string, subreddit string, title string, selftext string")
    comments = frame(spark, [("7", None, "c")], "id string, subreddit string, body string")
    rows = combine.combined_dataset(coords, labels, posts, comments).collect()
    assert sorted((r["type"], r["cluster_id"], r["subreddit"], r["text"]) for r in rows) == [
        ("comment", 2, "Unknown", "c"), ("post", 1, "s", "t b"),
    ]


def test_dedup_keeps_latest(spark):
    df = frame(spark, [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "w")], "id string, retrieved_on long, v string")
    assert sorted((r["id"], r["v"]) for r in stores.dedup_by_id(df).collect()) == [("a", "y"), ("b", "w")]
    assert stores.duplicate_keys(stores.dedup_by_id(df)).count() == 0


def test_state_upsert(spark):
    first = stores.state_change(spark, ["f1", "f2"], "in_progress").withColumn("updated_at", F.lit("2025-01-01").cast("timestamp"))
    second = stores.state_change(spark, ["f1"], "done")
    rows = {r["filepath"]: (r["status"], r["last_line"]) for r in stores.upsert_state(first, second).collect()}
    assert rows == {"f1": ("done", 0), "f2": ("in_progress", 0)}


def test_replace_scope_is_idempotent(spark):
    old = frame(spark, [("cluster", "1", 0), ("cluster", "2", 0)], "scope_type string, scope_value string, topic_id int")
    new = frame(spark, [("cluster", "1", 5), ("cluster", "1", 6)], "scope_type string, scope_value string, topic_id int")
    once = stores.replace_scope(old, new)
    twice = stores.replace_scope(once, new)
    want = [("cluster", "1", 5), ("cluster", "1", 6), ("cluster", "2", 0)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


# ---- sampling and order ----


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 2).alias("type"))
    one = sampling.sample_n(df, 700, ["type", "id"])
    two = sampling.sample_n(df.repartition(7), 700, ["type", "id"])
    a, b = {r["id"] for r in one.collect()}, {r["id"] for r in two.collect()}
    assert len(a) == 700 and a == b
    assert sampling.sample_n(df, 9999, ["id"]).count() == 5000
    halves = sampling.balanced_sample(df, 600).groupBy("type").count().collect()
    assert sorted(r["count"] for r in halves) == [300, 300]


def test_global_order(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id"))
    rows = scale.global_row_number(df, [F.desc("k"), F.col("id")], "rn").collect()
    want = sorted(((r["k"], r["id"]) for r in rows), key=lambda t: (-t[0], t[1]))
    assert [t for t in want] == [(r["k"], r["id"]) for r in sorted(rows, key=lambda r: r["rn"])]
    assert sorted(r["rn"] for r in rows) == list(range(1, 3001))
    sums = scale.global_running_sum(df, [F.col("id")], "k", "s").collect()
    assert {r["id"]: r["s"] for r in sums} == {i: sum(j % 3 for j in range(i + 1)) for i in range(3000)}


def test_ramp(spark):
    rows = {r["frame"]: r["n_shown"] for r in ranking.ramp_schedule(spark, 750).collect()}
    assert rows[0] == 1 and rows[375] == 100 and rows[749] == 1 and rows[187] == 50


def test_paging(spark):
    df = spark.range(100)
    seen, last = [], None
    while page := [r["id"] for r in sampling.page_after(df, "id", last, 30).collect()]:
        seen += page
        last = page[-1]
    assert seen == list(range(100))


# ---- distributions ----


def test_diversity(spark):
    rows = [(1, "a")] * 3 + [(2, s) for s in "abcd"] + [(3, "a")] * 3 + [(3, "b")] + [(-1, "a")]
    got = {r["cluster_id"]: r["diversity"] for r in aggregates.cluster_diversity(frame(spark, rows, "cluster_id int, subreddit string")).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1] == 0.0 and math.copysign(1, got[1]) == 1
    assert got[2] == pytest.approx(1.0) and got[3] == pytest.approx(0.811278, abs=1e-6)


def test_dominant_topic_tie_and_rounding(spark):
    rows = [("subreddit", "subreddit_s", t, n, f"w{t}") for t, n in ((4, 9), (2, 9), (7, 2))] + [("cluster", "cluster_1", 0, 50, "x")]
    row = aggregates.dominant_topics(frame(spark, rows, schemas.TOPIC_DETAILS)).collect()
    assert [tuple(r) for r in row] == [("s", 2, 9, 20, 45.0, "w2")]
    halves = frame(spark, [(0.25,), (2.25,)], "v double").select(F.bround("v", 1)).collect()
    assert [r[0] for r in halves] == [0.2, 2.2]


def test_noise_only_report(spark):
    row = aggregates.cluster_report(frame(spark, [(-1,), (-1,)], "cluster_id int")).first()
    assert tuple(row) == (0, 2, 100.0)


def test_centroids_of_zero_vectors(spark):
    df = frame(
        spark,
        [("s", "v", 0, [0.0, 0.0]), ("s", "v", 1, [3.0, 0.0]), ("s", "v", 1, [0.0, 4.0]), ("s", "v", -1, [1.0, 1.0])],
        "scope_type string, scope_value string, topic_id int, vector array<double>",
    )
    got = {r["topic_id"]: (r["n_docs"], list(r["centroid"])) for r in aggregates.topic_centroids(df).collect()}
    assert got[0] == (1, [0.0, 0.0]) and got[1][0] == 2 and got[1][1] == pytest.approx([0.6, 0.8]) and -1 not in got


# ---- graph reports ----


def edges(spark, rows):
    return frame(spark, [("subreddit", a, i, "subreddit", b, j, s) for a, i, b, j, s in rows], schemas.EDGES)


def test_bridge(spark):
    rows = graph.bridge_topics(edges(spark, [("A", 0, "B", 0, 0.9), ("A", 0, "C", 0, 0.9)]), 3, 0.7).collect()
    assert [tuple(r) for r in rows] == [("A", 0, 3, "A, B, C")]


def test_reversed_and_self_pairs(spark):
    rows = [("A", i, "B", i, 0.8) for i in range(3)] + [("B", i, "A", i + 5, 0.9) for i in range(2)]
    rows += [("A", i, "A", i + 9, 0.95) for i in range(6)]
    e = edges(spark, rows)
    assert [(r["source"], r["target"], r["n"]) for r in graph.affinity_network(e).collect()] == [("A", "B", 5)]
    kept = {(r["source"], r["target"]): r["n"] for r in graph.affinity_network(e, drop_self=False).collect()}
    assert kept == {("A", "B"): 5, ("A", "A"): 6}
    degrees = graph.node_degree(graph.affinity_network(e, drop_self=False)).collect()
    assert {r["node"]: r["degree"] for r in degrees} == {"A": 3, "B": 1}


def test_reach_names_the_first_ten(spark):
    rows = graph.topic_reach(edges(spark, [("A", 0, f"B{i:02d}", 0, 0.9) for i in range(12)])).collect()
    top = next(r for r in rows if r["scope_value"] == "A")
    assert top["reach"] == 12
    assert top["communities"] == ", ".join(f"subreddit:B{i:02d}" for i in range(10))


def test_empty_edges(spark):
    e = edges(spark, [])
    for report in (graph.cross_scope_summary, graph.bridge_topics, graph.topic_reach, graph.affinity_network):
        assert report(e).count() == 0 and report(e).columns
    assert graph.connected_components(spark.createDataFrame([], "source string, target string")).count() == 0


def test_components_of_chains_and_hubs(spark):
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)] + [("h", f"l{i}") for i in range(200)] + [("q", "q")]
    got = {r["node"]: r["component"] for r in graph.connected_components(frame(spark, pairs, "source string, target string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(121)} == {"n000"}
    assert {got[f"l{i}"] for i in range(200)} | {got["h"]} == {"h"} and "q" not in got


def test_directed_overlap_counts_each_topic_once(spark):
    e = edges(spark, [("A", 0, "B", 0, 0.9), ("A", 0, "B", 1, 0.9), ("A", 1, "B", 1, 0.8), ("A", 2, "B", 2, 0.6)])
    got = {(r["source"], r["target"]): r["n_topics"] for r in graph.topic_overlap_directed(e).collect()}
    assert got == {("A", "B"): 2, ("B", "A"): 2}


def test_many_communities_are_compared_sparsely(spark):
    n = 5000
    counts = spark.range(n).selectExpr("concat('s', id) AS subreddit", "CAST(2 AS BIGINT) AS n_topics")
    shared = spark.range(n // 2).selectExpr(
        "concat('s', 2 * id) AS subreddit_1", "concat('s', 2 * id + 1) AS subreddit_2", "CAST(1 AS BIGINT) AS shared_topics"
    ).filter("subreddit_1 < subreddit_2")
    docs = spark.range(n).selectExpr("concat('s', id) AS subreddit", "CAST(id div 2 AS INT) AS cluster_id")
    rows = topics.combined_similarity(shared, counts, docs).collect()
    assert len(rows) == n // 2 and {r["shared_clusters"] for r in rows} == {1}
    assert topics.topic_overlap_score(shared, counts).count() == n + 2 * shared.count()


# ---- similarity ----


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_cosine_pairs_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 8))
    v[:30] = v[0]  # a third are copies
    v[-1] = 0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "k long, v array<double>")
    got = {(r["a_k"], r["b_k"]): r["similarity"] for r in similarity.cosine_pairs(df, 0.4, ["k"], "v", block_rows).collect()}
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(norm > 0, norm, 1)
    want = {(i, j): u[i] @ u[j] for i, j in itertools.combinations(range(90), 2) if u[i] @ u[j] >= 0.4}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def words_frame(spark, sets):
    rows = [("subreddit", s, t, r + 1, w, 1.0) for (s, t), ws in sets.items() for r, w in enumerate(ws)]
    return frame(spark, rows, schemas.TOPIC_WORDS)


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.8, 1.0])
def test_shared_topics_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(14)]
    sets = {(s, t): list(rng.choice(vocabulary, rng.integers(1, 9), replace=False)) for s in "ABC" for t in range(8)}
    for t in range(3):  # copies of one word set in every community
        sets["ABC"[t], 0] = ["w1", "w2", "w3", "w4"]
    got = {
        (r["subreddit_1"], r["topic_1"], r["subreddit_2"], r["topic_2"]): r["jaccard"]
        for r in similarity.shared_topics(words_frame(spark, sets), threshold).collect()
    }
    want = {}
    for (a, x), (b, y) in itertools.product(sets.items(), repeat=2):
        if a[0] < b[0]:
            x_, y_ = set(x), set(y)
            score = len(x_ & y_) / len(x_ | y_)
            if score >= threshold:
                want[(*a, *b)] = score
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    counts = {(r["subreddit_1"], r["subreddit_2"]): r["shared_topics"] for r in similarity.shared_topic_counts(words_frame(spark, sets), threshold).collect()}
    assert counts == dict(Counter((k[0], k[2]) for k in want))


def test_overlap_score_above_one(spark):
    same = ["a", "b", "c"]
    sets = {("A", 0): same, ("A", 1): same, ("B", 0): same, ("B", 1): same, ("B", 2): same}
    counts = frame(spark, [("A", 2), ("B", 3), ("C", 1)], "subreddit string, n_topics long")
    shared = similarity.shared_topic_counts(words_frame(spark, sets), 0.3)
    got = {(r["subreddit_1"], r["subreddit_2"]): r["score"] for r in topics.topic_overlap_score(shared, counts).collect()}
    assert got["A", "B"] == got["B", "A"] == 2.0 and got["C", "C"] == 1.0 and len(got) == 5


# ---- tokens and topic words ----


def test_tokens_are_framed_and_whole(spark):
    vocabulary = frame(spark, [("a", 3), ("b", 4)], "word string, token int")
    long = "a b " * 10_000
    rows = [("post", "1", "B a x a"), ("post", "2", "..."), ("post", "3", None), ("post", "4", long),
            ("post", "1", "a b"), ("post", "1", "B a x a")]
    df = frame(spark, rows, "type string, id string, text string")
    got = sorted((r["id"], r["tokens"]) for r in tokens.tokenize(df, vocabulary).collect())
    assert got == sorted(
        [("1", [1, 4, 3, 0, 3, 2]), ("1", [1, 4, 3, 0, 3, 2]), ("1", [1, 3, 4, 2]), ("2", [1, 2]), ("3", [1, 2]),
         ("4", [1, *[3, 4] * 10_000, 2])]
    )
    cut = sorted((r["id"], r["tokens"]) for r in tokens.tokenize(df.limit(3), vocabulary, max_len=5).collect())
    assert cut == [("1", [1, 4, 3, 0, 2]), ("2", [1, 2]), ("3", [1, 2])]
    chunks = sorted((r["id"], r["chunk"], r["tokens"]) for r in tokens.tokenize_chunks(df.limit(3), vocabulary, 5).collect())
    assert chunks == [("1", 0, [1, 4, 3, 0, 2]), ("1", 1, [1, 3, 2]), ("2", 0, [1, 2]), ("3", 0, [1, 2])]


def test_user_hooks(spark):
    df = frame(spark, [("post", "1", "aa"), ("post", "1", "aa"), ("post", "2", "b")], "type string, id string, text string")

    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame({"type": pdf["type"], "id": pdf["id"], "vector": [[float(len(t))] for t in pdf["text"]]})

    rows = {r["id"]: r["vector"] for r in tokens.embed_with(df, encode).collect()}
    assert rows == {"1": [2.0], "2": [1.0]}


def test_hashed_vectors_equal_brute_force(spark):
    import hashlib

    rows = [("post", "1", "a b b"), ("post", "1", "a b b"), ("post", "2", "a c"), ("post", "3", "...")]
    df = frame(spark, rows, "type string, id string, text string")
    got = {r["id"]: np.array(r["vector"]) for r in tokens.embed_documents(df, 32).collect()}
    at = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32
    texts = {"1": ["a", "b", "b"], "2": ["a", "c"]}
    docs = {i: np.bincount([at(w) for w in ws], minlength=32) for i, ws in texts.items()}
    df_counts = sum((v > 0).astype(int) for v in docs.values())
    idf = np.where(df_counts >= 1, np.log(3 / (df_counts + 1)), 0)
    assert set(got) == set(docs)
    for i, v in docs.items():
        w = v * idf
        assert np.allclose(got[i], w / (np.linalg.norm(w) or 1))


def test_ngrams_stop_words_and_min_df(spark):
    df = frame(
        spark,
        [("c", "1", 0, "the big red dog"), ("c", "1", 1, "big red cat"), ("c", "2", 0, "big red")],
        "scope_type string, scope_value string, topic_id int, text string",
    )
    rows = tokens.ngram_counts(df, stop_words=["the"]).collect()
    got = {(r["scope_value"], r["topic_id"], r["term"]): (r["n"], r["total"]) for r in rows}
    assert got == {("1", t, w): (1, 2) for t in (0, 1) for w in ("big", "red", "big red")}


def test_mmr_prefers_diverse_words(spark):
    key = ("c", "1", 0)
    unit = {"a": [1.0, 0.0], "b": [0.999, 0.04], "c": [0.6, 0.8]}
    candidates = frame(spark, [(*key, i + 1, w, 1.0 - i / 10) for i, w in enumerate("abc")], schemas.TOPIC_WORDS)
    docs = frame(spark, [(*key, "post", w, w) for w in "abc"], "scope_type string, scope_value string, topic_id int, type string, id string, word string")
    vectors = frame(spark, [("post", w, v) for w, v in unit.items()], "type string, id string, vector array<double>")
    centroids = frame(spark, [(*key, [1.0, 0.0])], "scope_type string, scope_value string, topic_id int, centroid array<double>")
    order = lambda d: [r["word"] for r in sorted(topics.mmr_words(candidates, docs, vectors, centroids, 2, d).collect(), key=lambda r: r["rank"])]
    assert order(0.0) == ["a", "b"] and order(0.7) == ["a", "c"]


def test_term_join_keeps_rows_without_an_id(spark):
    from agoraflow.functions.text import escape_literal

    df = spark.createDataFrame([(None, "a gpt here"), (None, "nothing"), (None, "llm"), ("1", "gpt")], "id string, title string")
    terms = spark.createDataFrame([(t, escape_literal(t)) for t in ("gpt", "llm")], "term string, pattern string")
    got = filters.match_terms_by_join(df, terms, ["title"]).collect()
    want = df.filter(filters.matches_any_term(["gpt", "llm"], ["title"])).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 3
