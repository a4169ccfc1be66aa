"""The index against plain searching, on random texts, the test tables and odd rows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from agoraflow.llm import fm_index
from agoraflow.llm.common import table
from agoraflow.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)) if text else []


def slow_hits(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = tuple(slow_words(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(words[i : i + window], set()).add(str(item))
    lengths = sorted({len(w) for w in windows})
    out = []
    for d, text in docs:
        words = slow_words(text)
        hit, names = [False] * len(words), set()
        for i in range(len(words)):
            for n in lengths:
                found = windows.get(tuple(words[i : i + n])) if i + n <= len(words) else None
                if found:
                    hit[i : i + n] = [True] * n
                    names |= found
        out.append((d, len(words), sum(hit), sorted(names)))
    return out


def test_suffix_order_and_search():
    rng = np.random.default_rng(0)
    for trial in range(40):
        text = rng.integers(0, 4, 200)
        text[-1] = 0
        order = fm_index.suffix_order(text)
        borders = np.cumsum(text == 0)
        letters = [(int(borders[i]), 0) if text[i] == 0 else (10**6, int(text[i])) for i in range(200)]
        assert order.tolist() == sorted(range(200), key=lambda i: letters[i:])
        index = fm_index.FMIndex(text, 4, sample=5)
        patterns = rng.integers(1, 4, (30, 5))
        lengths = rng.integers(1, 6, 30)
        low, high = index.search(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, low, high):
            want = [i for i in range(201 - n) if (text[i : i + n] == p[:n]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_query_equals_plain_search(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = sorted(map(tuple, QUERIES["op9_fm_decontamination"](spark, sf_dir).collect()))
    want = sorted(
        (d, n, k, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), k > 0)
        for d, n, k, names in slow_hits(docs, items)
    )
    assert got == want
    assert any(r[5] for r in got)


LONG = "Zero one TWO three four five six seven eight nine ten eleven"
DOCS = [
    (1, "x " + LONG.lower() + " y"),
    (2, None),
    (3, ""),
    (4, "short item, here: tiny; tiny!"),
    (5, (LONG + "\n") * 3000),
    (6, "one two three four five six seven eight nine"),
    (7, "clean   text\twith  space "),
    (7, "clean   text\twith  space "),
    (None, "été naïve"),
    (8, LONG),
]
ITEMS = [(10, LONG), (9, LONG.upper()), (11, "tiny"), (12, None), (13, "-- !"), (None, "clean"), (14, "naïve"), (11, "tiny")]


@pytest.mark.parametrize("block_bytes", [16 << 20, 40])
def test_odd_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(fm_index, "BLOCK_BYTES", block_bytes)
    docs = spark.createDataFrame([(d, t, "a", [1]) for d, t in DOCS], "doc_id long, text string, n_hit string, spans array<int>")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in fm_index.contamination(docs, bench).collect()), key=str)
    # the item without id is searched, and named nowhere
    want = slow_hits(DOCS, [("" if i is None else i, t) for i, t in ITEMS])
    assert got == sorted(((d, n, k, [x for x in names if x]) for d, n, k, names in want), key=str)
    left = fm_index.remove_hits(docs, bench)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        [
            (1, "x\ny"),
            (2, None),
            (3, ""),
            (4, "short item, here:\n!"),
            (6, DOCS[5][1]),
            (7, "text\twith  space"),
            (7, "text\twith  space"),
            (None, "été"),
        ],
        key=str,
    )


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert fm_index.contamination(docs.limit(0), bench).count() == 0
    assert fm_index.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert fm_index.remove_hits(docs, bench.limit(0)).count() == len(DOCS)


def test_items_without_id_and_clashing_names(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(None, passage), ("b", "other words here"), (None, None)], "item_id string, text string")
    rows = [(1, f"start {passage} end", "mine"), (2, "clean text", "yours"), (3, None, None), (4, "other words here", "gone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _emptied string")
    got = {r.doc_id: r for r in fm_index.contamination(docs, items).collect()}
    assert got[1].contaminated and got[1].n_hit == 12 and list(got[1]["items"]) == []
    assert got[4].contaminated and list(got[4]["items"]) == ["b"] and not got[2].contaminated and not got[3].contaminated
    cut = {r.doc_id: (r.text, r["_emptied"]) for r in fm_index.remove_hits(docs, items).collect()}
    assert cut == {1: ("start\nend", "mine"), 2: ("clean text", "yours"), 3: (None, None)}
