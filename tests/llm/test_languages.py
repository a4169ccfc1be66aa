"""Held-out accuracy, mixtures with known proportions, and odd rows."""

from __future__ import annotations

import zlib

import numpy as np

from agoraflow.llm import languages
from agoraflow.llm.common import table
from agoraflow.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op10_language_mixture"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == lang.keys()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in set(lang.values()) | {"und"} and 0 <= r.score <= 1
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97


def slow_trigrams(text):
    data = b"  " + text.translate(languages._LETTERS) + b"  "
    out = np.zeros(languages.BUCKETS, dtype=int)
    for i in range(len(data) - 2):
        if data[i : i + 3] != b"   ":
            out[(int.from_bytes(data[i : i + 3]) * 2654435761 % 2**32) >> 20] += 1
    return out


def test_trigram_counts_over_pieces(monkeypatch):
    texts = [b"", b"Abc d, e", b"xy" * 50, "é漢".encode() * 9, b"q"]
    whole = languages.trigram_counts(texts)
    assert (whole == np.array([slow_trigrams(t) for t in texts])).all()
    monkeypatch.setattr(languages, "_SEGMENT", 7)
    assert (languages.trigram_counts(texts) == whole).all()


def test_mixture_proportions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("length(text) > 1500").collect()
    models = languages.learn(table(spark, sf_dir, "documents"))
    by = {}
    for r in docs:
        by.setdefault(r.lang, []).append(r.text.encode()[:1200])
    three = by["en"][0] + b" " + by["de"][0] + b" " + by["fr"][0]
    shares = models.infer(languages.trigram_counts([by["en"][1] * 2, by["de"][1] + b" " + by["en"][2] * 3, three]))
    at = models.langs.index
    assert shares[0, at("en")] > 0.99 and (shares[0] > 0).sum() == 1
    assert abs(shares[1, at("en")] - 0.75) < 0.08 and (shares[1] > 0).sum() == 2
    assert (shares[2] > 0.2).sum() == 3


def test_odd_rows(spark, sf_dir):
    models = languages.learn(table(spark, sf_dir, "documents"))
    texts = [None, "", "123 ++ ½²", "the of and is that with", "THE OF AND is that with", "x" * 100_000, "the", "the", "漢字"]
    docs = spark.createDataFrame([(i, t, 3.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in languages.identify(docs, models).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[2].score == 0
    assert got[3].lang_pred == got[4].lang_pred == "en" and got[6] != got[5] and got[8].lang_pred != "und"
    assert languages.identify(docs.limit(0), models).count() == 0
    none = languages.learn(table(spark, sf_dir, "documents").limit(0))
    assert {r.lang_pred for r in languages.identify(docs, none).collect()} == {"und"}
    one = languages.learn(table(spark, sf_dir, "documents").filter("lang = 'en'"))
    assert {r.lang_pred for r in languages.identify(docs, one).collect()} == {"und", "en"}
    labelled = docs.selectExpr("doc_id", "text", "'a' as lang", "'b' as lang_pred", "score")
    kept = languages.keep_identified(labelled)
    assert kept.columns == labelled.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8]
