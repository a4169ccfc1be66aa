"""Terms and word vectors at scale: what is shuffled, and how rows are dealt."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from agoraflow.operators import tokens, topics

KEY = "scope_type string, scope_value string, topic_id int"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_vectors_shuffle_texts_only(spark):
    rows = [("post", "1", "a b b"), ("post", "1", "a b b"), ("post", None, "a c"), ("post", "3", "..."), ("post", "4", None), (None, "5", "d")]
    df = spark.createDataFrame(rows, "type string, id string, text string")
    vectors = tokens.embed_documents(df, 32)
    assert "Exchange" not in plan(vectors)  # the counts are not gathered again
    got = {(r["type"], r["id"]): r["vector"] for r in vectors.collect()}
    assert set(got) == {("post", "1"), ("post", None), (None, "5")}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in got.values())


def test_vectors_of_documents_behind_a_slice(spark, monkeypatch):
    df = spark.range(50).select(F.lit("post").alias("type"), F.col("id").cast("string"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" x"), "id").alias("text"))
    want = {r["id"]: r["vector"] for r in tokens.embed_documents(df, 64).collect()}
    monkeypatch.setattr(tokens, "COUNTED_ROWS", 3)
    assert {r["id"]: r["vector"] for r in tokens.embed_documents(df.coalesce(1), 64).collect()} == want and len(want) == 50


def test_terms_are_shuffled_once(spark):
    rng = random.Random(4)
    rows = [("c", str(rng.randrange(2)), rng.randrange(3), i, " ".join(rng.choices(["aa", "bb", "cc", "dd", "the"], k=rng.randrange(9)))) for i in range(200)]
    rows += [("c", "0", 1, 1000, "aa bb")] * 5 + [("c", None, 1, 1001, "aa"), ("c", None, 2, 1002, "aa"), ("c", "1", None, 1003, "")]
    df = spark.createDataFrame(rows, f"{KEY}, id int, text string").coalesce(1)
    counted = tokens.ngram_counts(df, stop_words=["the"])
    shuffles = [line for line in plan(counted).splitlines() if "Exchange hashpartitioning" in line]
    assert len([x for x in shuffles if "term" in x]) == 1
    counts = Counter()
    for kind, value, topic, _, text in rows:
        words = [w for w in text.split() if w != "the"]
        counts.update((kind, value, topic, " ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    df_, total = Counter(), Counter()
    for (kind, value, _, term), n in counts.items():
        df_[kind, value, term] += 1
        total[kind, value, term] += n
    want = {(*k, n, total[k[0], k[1], k[3]]) for k, n in counts.items() if df_[k[0], k[1], k[3]] >= 2}
    assert {tuple(r) for r in counted.collect()} == want and counted.count() == len(want)


def test_terms_are_counted_before_rows_are_made(spark, monkeypatch):
    """No row per occurrence: what is shuffled are different terms, and pieces of a batch add up."""
    rows = [("c", "0", t, "aa bb  aa bb" if t else "bb aa bb aa", 1.5) for t in (0, 1, None) for _ in range(40)]
    rows += [("c", "0", 0, "", 1.0), ("c", "1", 1, "aa zz", 1.0)]
    df = spark.createDataFrame(rows, f"{KEY}, text string, w double").coalesce(1)
    counted = tokens.ngram_counts(df)
    assert "Generate" not in plan(counted)
    words = tokens._with_terms(df, list(topics.TOPIC), "text", 3, [], "a-z", 2).coalesce(1)
    terms = tokens._count_terms(words, list(topics.TOPIC), 3).collect()
    assert len(terms) == len({r[:4] for r in terms}) == 18 + 3
    want = {(*r[:3], r["term"], r["n"], r["total"]) for r in counted.collect()}
    twice, once = {"aa", "bb"}, {"aa bb": (80, 40), "bb aa": (40, 80)}
    assert {r[3:] for r in want if r[3] in twice} == {(w, 80, 240) for w in twice} and len(want) == 18
    assert {r[4] for r in want if r[3] in once} == {40, 80} and {r[5] for r in want if r[3] in once} == {200, 160}
    assert {r[3:] for r in want if r[3] == "aa bb aa"} == {("aa bb aa", 40, 120)}
    monkeypatch.setattr(tokens, "BATCH_WORDS", 5)
    assert {(*r[:3], r["term"], r["n"], r["total"]) for r in tokens.ngram_counts(df).collect()} == want


def test_texts_of_one_partition_are_dealt(spark):
    df = spark.range(400).select(F.lit("c").alias("scope_type"), F.lit("1").alias("scope_value"), F.lit(0).alias("topic_id"), "id", F.lit("one text").alias("text")).coalesce(1)
    dealt = tokens._with_terms(df, ["scope_type"], "text", 2, [], r"\p{L}", 2)
    held = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 300


def test_terms_meet_candidates_without_a_shuffle(spark, no_small_tables):
    terms = spark.createDataFrame([("c", "1", 0, "post", str(i), w) for i in range(9) for w in "abc"], f"{KEY}, type string, id string, word string")
    words = spark.createDataFrame([("c", "1", 0, "a"), ("c", "1", 1, "b")], f"{KEY}, word string")
    found = topics.candidate_documents(terms, words)
    assert "Exchange hashpartitioning" not in plan(found) and {r["word"] for r in found.collect()} == {"a"} and found.count() == 9
