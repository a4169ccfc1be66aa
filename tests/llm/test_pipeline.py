"""Each stage against its brute-force version on the stage's own input, and the whole run."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from agoraflow.functions.scale import materialize
from agoraflow.llm import bpe
from agoraflow.llm.common import table
from test_fm_index import slow_hits
from test_simhash import slow_fingerprint
from test_substrings import slow_exact, words


@pytest.fixture(scope="module")
def outputs(spark, sf_dir):
    docs = [table(spark, sf_dir, "documents")]
    for _, stage in pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], sf_dir)))
    return docs


def texts(df):
    rows = df.collect()
    out = {r.doc_id: r.text for r in rows}
    assert len(out) == len(rows)
    return out


def test_columns_and_lengths(outputs):
    for df in outputs[1:-1]:
        assert df.dtypes == outputs[0].dtypes
        assert df.filter("n_chars != length(text)").count() == 0
    assert [name for name, _ in pipeline.STAGES] == [
        "language_id",
        "simhash_near_dedup",
        "substring_dedup",
        "decontamination",
        "byte_bpe",
    ]


def test_language_stage(outputs):
    before, after = texts(outputs[0]), texts(outputs[1])
    assert all(after[d] == before[d] for d in after)
    assert all(any(map(str.isalpha, t)) for t in after.values())
    assert len(after) > 0.98 * len(before)


def test_simhash_stage(outputs):
    before, after = texts(outputs[1]), texts(outputs[2])
    fps = {d: slow_fingerprint(t, 5) for d, t in before.items()}
    label = {d: d for d in before}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(before)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    assert after == {d: t for d, t in before.items() if root(d) == d}
    assert len(after) < len(before)


def test_substring_stage(outputs):
    before, after = texts(outputs[2]), texts(outputs[3])
    for d, hit in slow_exact(before).items():
        if not hit:
            continue
        left = words(after.get(d, ""))
        assert len(left) <= len(words(before[d])) - len(hit)
    assert not any(slow_exact(after, 50).values())
    same = sum(after.get(d) == t for d, t in before.items())
    assert 0.7 * len(before) < same < len(before)


def test_decontamination_stage(spark, outputs, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    before, after = texts(outputs[3]), texts(outputs[4])
    hits = {d: n for d, _, n, _ in slow_hits(before.items(), items)}
    assert any(hits.values()) and not any(n for _, _, n, _ in slow_hits(after.items(), items))
    for d, n in hits.items():
        if n == 0:
            assert after[d] == before[d]


def test_token_stage(outputs):
    with open(public_tokenizers.path(pipeline.RANKS), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before = texts(outputs[4])
    rows = outputs[5].collect()
    assert {r.doc_id for r in rows} == before.keys()
    for r in rows:
        assert r.token_ids == library.encode_ordinary(before[r.doc_id]) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()


ODD = [(1, None, "en"), (2, "", "en"), (3, "!!", None), (4, "the of and is", "en"), (4, "the of and is", "en"), (5, "x" * 9000, None), (None, "the of and", "en")]


def test_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(d, t, g, "s", 1, "own") for d, t, g in ODD],
                                 "doc_id long, text string, lang string, source string, n_chars long, token_ids string")
    for start in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES:
            start = materialize(stage(spark, start, sf_dir))
        assert start.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "decoded_sha256"]
    for _, stage in pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_run_is_the_stages(spark, sf_dir, outputs):
    got = pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "decoded_sha256").collect())) == sorted(
        map(tuple, outputs[-1].select("doc_id", "decoded_sha256").collect())
    )
