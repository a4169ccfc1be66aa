"""Base counts by definition, distances by formula, verdicts on labelled documents."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from agoraflow.llm import quality
from agoraflow.llm.common import table
from agoraflow.llm.queries import QUERIES


def slow_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    failed = n < 20 or 100 * len(hit) > 30 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


def slow_js(p, q):
    p, q = np.asarray(p) / sum(p), np.asarray(q) / sum(q)
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return np.sqrt((kl(p) + kl(q)) / 2)


def test_query_equals_definitions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").collect()
    texts = {r.doc_id: r.text for r in docs}
    words = {lang: Counter() for lang in {r.lang for r in docs}}
    classes = {lang: np.zeros(quality.CLASSES) for lang in words}
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    for r in docs:
        words[r.lang].update(split(r.text))
        classes[r.lang] += quality.class_histograms([r.text.encode()])[0]
    top = {lang: sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON] for lang, c in words.items()}
    got = {r.doc_id: r for r in QUERIES["op3_divergence_rules"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        want, r = slow_counts(text), got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        own = Counter(split(text))
        by_class = min(slow_js(quality.class_histograms([text.encode()])[0], c) for c in classes.values())
        by_word = 1.0
        for lang, t in top.items():
            ours = [own[w] for w, _ in t]
            ref = [n for _, n in t]
            total = sum(own.values())
            if total:
                by_word = min(by_word, slow_js([total - sum(ours), *ours], [words[lang].total() - sum(ref), *ref]))
        far = False
        if want[1] >= quality.MIN_CHARS:
            assert r.char_distance == pytest.approx(by_class, abs=1e-9)
            far |= r.char_distance > quality.MAX_CHAR_DISTANCE
        else:
            assert r.char_distance is None
        if want[0] >= quality.MIN_WORDS:
            assert r.word_distance == pytest.approx(by_word, abs=1e-9)
            far |= r.word_distance > quality.MAX_WORD_DISTANCE
        else:
            assert r.word_distance is None
        assert r.kept == (not want[5] and not far)


def test_labelled_documents(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    rows = [r for r in QUERIES["op3_divergence_rules"](spark, sf_dir).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id]]
    bad = [r.kept for r in rows if not labels[r.doc_id]]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.4


def test_odd_rows(spark):
    texts = [None, "", " \n\n\t", "a b c d e f g h " * 4, "one\none\n\none", "é" * 5000, "# $ %" * 300, "x y " * 40_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, None, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string, n_words int")
    refs = quality.learn_references(docs)
    assert refs.langs == []
    for r in quality.judge(docs, refs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_counts(texts[r.doc_id])
        assert r.char_distance is None and r.kept == (not r.base_failed)
    spoken = docs.selectExpr("doc_id", "text", "'xx' as lang")
    assert quality.judge(spoken, quality.learn_references(spoken)).count() == len(texts)
    assert quality.judge(docs.limit(0), refs).count() == 0
