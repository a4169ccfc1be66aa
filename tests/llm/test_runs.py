"""Runs of words: the automaton with link-cut access, and the stretches it is given, against brute force."""

from __future__ import annotations

import random

import pytest

from agoraflow.llm import runs
from agoraflow.llm.common import table


def brute(words, least=6, times=4):
    """Stretches of equal words at every distance; of equal stretches the smallest period counts."""
    n, best = len(words), {}
    for q in range(n // times, 0, -1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            size = j - i + q
            if size >= max(least, times * q):
                best[i - q, size] = q
            i = j
    return sorted((start, size, q) for (start, size), q in best.items())


def random_words(rng, n, kinds):
    return [b"w%d" % rng.randrange(kinds) for _ in range(n)]


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (9, 3)])
def test_automaton_against_brute_force(least, times):
    rng = random.Random(least)
    for kinds in (1, 2, 2, 3):
        for _ in range(60):
            words = random_words(rng, rng.randrange(0, 60), kinds)
            for _ in range(rng.randrange(3)):  # repeat a part of it
                a = rng.randrange(len(words) + 1)
                words += words[a : a + rng.randrange(1, 8)] * rng.randrange(1, 7)
            assert runs.runs_of(words, least, times) == brute(words, least, times)


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2)])
def test_stretches_hold_all_runs(least, times):
    rng = random.Random(times)
    texts = []
    for _ in range(120):
        words = random_words(rng, rng.randrange(0, 120), rng.choice([2, 5, 400]))
        for _ in range(rng.randrange(4)):
            period = random_words(rng, rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64]), 300)
            many = period * rng.randrange(2, 7)
            words += many[: len(many) - rng.randrange(len(period))]
            words += random_words(rng, rng.randrange(30), 400)
        texts.append(words)
    want = [brute(t, least, times) for t in texts]
    assert sum(map(len, want)) > 100
    assert runs.find_runs(texts, least, times) == want


def test_neighbouring_texts_are_apart():
    one = [b"a", b"b"] * 3
    assert runs.find_runs([one, one, one]) == [[], [], []]
    assert runs.find_runs([one + one, one]) == [[(0, 12, 2)], []]


def test_segments_recolour():
    paths = runs.Paths([-1, 0, 1, 1])
    assert paths.access(2, 0) == [(2, -1), (1, -1), (0, -1)]
    assert paths.access(3, 1) == [(3, -1), (1, 0)]
    assert paths.access(2, 2) == [(2, 0), (1, 1)]


def test_long_periodic_text_takes_linear_time():
    period = [b"%d" % i for i in range(700)]
    words = period * 120
    assert runs.runs_of(words) == [(0, len(words), 700)]
    assert runs.runs_of([b"x"] * 50_000) == [(0, 50_000, 1)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a\ta\na\ra  a a a"), (4, "a b " * 3), (4, "x " * 200_000), (4, "x " * 200_000), (5, " \n")]
    docs = spark.createDataFrame([(d, t, 9, "own") for d, t in rows], "doc_id long, text string, n_words int, collapsed string")
    got = runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    out = {(r.doc_id, r.text): (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()}
    assert got.count() == len(rows)
    assert out[1, None] == out[2, ""] == out[5, " \n"] == (0, [], "")
    assert out[None, rows[2][1]] == (7, [(0, 7, 1)], "a")
    assert out[4, rows[3][1]] == (3, [], "a b a b a b")
    assert out[4, rows[4][1]] == (200_000, [(0, 200_000, 1)], "x")
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, times=1)


def test_clashing_names(spark):
    docs = spark.createDataFrame([("a a a a a a", 1, 2)], "text string, runs int, `a.b` int")
    row = runs.periodic_runs(docs).first()
    assert (row["a.b"], row["n_words"], row["collapsed"]) == (2, 6, "a")


def test_repeated_tail(spark, sf_dir):
    import zlib

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = {r.doc_id: r.text for r in runs.with_repeated_tail(docs).collect()}
    touched = 0
    for doc_id, text in docs.collect():
        h = zlib.crc32(str(doc_id).encode())
        words, g = text.encode().split(), h // 10
        if h % 10 == 0 and words:
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert changed[doc_id].encode() == b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])
            touched += 1
        else:
            assert changed[doc_id] == text
    assert touched > 50
    odd = spark.createDataFrame([(None, "a b"), (3, None), (2, ""), (42, " ")], "doc_id long, text string")
    assert sorted(runs.with_repeated_tail(odd).collect(), key=str) == sorted(odd.collect(), key=str)


def test_more_rows_than_a_slice(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat(id, ' ', repeat(concat('x', id, ' '), int(id % 9))) as text").coalesce(1)
    for r in runs.periodic_runs(docs, keep=["doc_id"]).collect():
        n = r.doc_id % 9
        assert [tuple(x) for x in r.runs] == ([(1, n, 1)] if n >= 6 else [])
        assert r.collapsed == (f"{r.doc_id} x{r.doc_id}" if n >= 6 else " ".join([str(r.doc_id)] + [f"x{r.doc_id}"] * n))
