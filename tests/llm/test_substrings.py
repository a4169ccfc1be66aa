"""Windows against the recursive definition; passages against every run of 50 words."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from agoraflow.functions import scale
from agoraflow.llm import substrings
from agoraflow.llm.common import table
from agoraflow.llm.queries import QUERIES


def slow_windows(h, t):
    out = []

    def split(a, b):
        if b - a < t:
            return
        c = min(range(a, b), key=lambda i: (h[i], i))
        out.append((a, c, b - 1))
        split(a, c)
        split(c + 1, b)

    split(0, len(h))
    return sorted(out)


@pytest.mark.parametrize("n,t,values", [(0, 3, 9), (2, 3, 9), (3, 3, 9), (200, 7, 1000), (300, 5, 4), (97, 97, 50)])
def test_windows_are_the_tree(n, t, values):
    rng = np.random.default_rng(n + t)
    for _ in range(20):
        h = rng.integers(1, values, n).astype(np.uint64)
        got = sorted(zip(*(x.tolist() for x in substrings.compact_windows(h, t))))
        assert got == slow_windows(h.tolist(), t)


def test_windows_of_parted_documents():
    rng = np.random.default_rng(0)
    parts = [rng.integers(1, 99, n).astype(np.uint64) for n in (5, 40, 3, 0, 30)]
    flat = np.concatenate([x for p in parts for x in (np.zeros(1, np.uint64), p)] + [np.zeros(1, np.uint64)])
    got = sorted(zip(*(x.tolist() for x in substrings.compact_windows(flat, 4))))
    want, start = [], 1
    for p in parts:
        want += [(a + start, c + start, b + start) for a, c, b in slow_windows(p.tolist(), 4)]
        start += len(p) + 1
    assert got == sorted(want)


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def slow_exact(docs, n=50):
    """Per document the words that lie in a run of n words that a smaller id has, too."""
    first, out = {}, {}
    for d, text in sorted(docs.items()):
        w = words(text)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), d)
    for d, text in docs.items():
        w, hit = words(text), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                hit.update(range(i, i + n))
        out[d] = hit
    return out


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similar_passage(passage, source):
    """Whether some stretch of the source has a Jaccard similarity of 0.8 with the passage."""
    mine = shingles(passage)
    places = [i for i in range(len(source) - 4) if tuple(source[i : i + 5]) in mine]
    for i, a in enumerate(places):
        for b in places[i:]:
            theirs = shingles(source[a : b + 5])
            if len(mine & theirs) >= 0.8 * len(mine | theirs):
                return True
            if len(theirs) > 2 * len(mine):
                break
    return False


def test_query_finds_every_repeat(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {}
    rows = QUERIES["op7_compact_windows"](spark, sf_dir).collect()
    for r in rows:
        assert r.source_id < r.doc_id and r.end - r.start >= 50
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    want = slow_exact(docs)
    assert sum(map(bool, want.values())) > 50
    for d, hit in want.items():
        assert hit <= got.get(d, set()), d
    rng = random.Random(0)
    for r in rng.sample(rows, 40):
        assert similar_passage(words(docs[r.doc_id])[r.start : r.end][:400], words(docs[r.source_id])) or r.end - r.start > 400


def planted(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, near = say(60), say(120)
    edited = list(near)
    edited[60] = "other"
    edited.insert(30, "more")
    half = passage[:30]
    docs = {
        0: say(200) + half + say(40),  # has half of the passage only
        1: say(30) + passage + say(80),
        2: say(300) + passage,
        3: passage + say(10),
        4: say(50) + near + say(20),
        5: say(11) + edited + say(33),
        6: say(500),
        7: say(49),
        8: None,
        9: "",
    }
    return {d: None if w is None else " ".join(w) for d, w in docs.items()}, passage, edited


def test_planted_passages(spark):
    docs, passage, edited = planted()
    rows = spark.createDataFrame([(d, t, "x", [1]) for d, t in docs.items()], "doc_id long, text string, start string, words array<int>")
    found = substrings.repeated_passages(rows).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert got.keys() == {2, 3, 5}
    assert got[2] == set(range(300, 360)) and got[3] == set(range(60)) and got[5] == set(range(11, 132))
    left = {r.doc_id: r.text for r in substrings.remove_repeats(rows).collect()}
    assert left.keys() == docs.keys()
    assert left[3] == " ".join(docs[3].split()[60:]) and left[1] == docs[1]
    assert left[5].split() == docs[5].split()[:11] + docs[5].split()[132:]


def test_copies_ties_and_nulls(spark):
    docs, passage, _ = planted(8)
    long = " ".join(f"t{i % 977}x{i}" for i in range(20_000))
    rows = [(1, docs[6]), (2, docs[6]), (2, docs[6]), (3, docs[6].upper()), (None, docs[6]), (None, "x y"), (4, long), (5, "pre " + long)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in substrings.remove_repeats(frame).collect()), key=str)
    assert left == sorted([(1, docs[6]), (None, "x y"), (4, long), (5, "pre")], key=str)
    assert substrings.repeated_passages(frame.limit(0)).count() == 0
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def captured(seed=11):
    """Copies of a passage behind documents that share less than 50 words of it, each part of it by some."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [say(60), say(60), say(50)]
    docs, n = {}, 0
    for passage in passages:
        for a in range(0, len(passage) - 24, 5):
            for size in (25, 35, 49):
                docs[n] = say(20) + passage[a : a + size] + say(30)
                docs[n] = docs[n] if len(passage[a : a + size]) < 50 else say(9)
                n += 1
    copies = {}
    for k in range(6):
        for passage in passages:
            before = rng.randrange(200)
            docs[n] = say(before) + passage + say(rng.randrange(100))
            copies[n] = set(range(before, before + len(passage)))
            n += 1
    return {d: " ".join(w) for d, w in docs.items()}, copies


def test_partial_sharers_do_not_capture_copies(spark):
    for seed in (11, 12):
        docs, copies = captured(seed)
        rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {}
        for r in substrings.repeated_passages(rows).collect():
            got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        want = slow_exact(docs)
        assert sum(want[d] == copies[d] for d in copies) == 15
        for d, hit in want.items():
            assert hit <= got.get(d, set()), d


def edited_behind(seed, sharers):
    """Passages of 160 words, their copies with a word in 40 changed, and documents before them that share 25 words each."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [say(160) for _ in range(10)]
    docs = []
    for passage in passages:
        docs += [say(20) + passage[a : a + 25] + say(30) for a in range(0, 136, 5) for _ in range(sharers)]
    docs += [say(30) + p + say(30) for p in passages]
    originals = len(docs)
    for passage in passages:
        copy = list(passage)
        for k in range(20, 160, 40):
            copy[k] = f"other{rng.random()}"
        docs.append(say(40) + copy + say(10))
    return [(d, " ".join(w)) for d, w in enumerate(docs)], originals


def test_partial_sharers_do_not_capture_edited_copies(spark):
    for seed, sharers in ((5, 1), (6, 3)):
        docs, originals = edited_behind(seed, sharers)
        rows = spark.createDataFrame(docs, "doc_id long, text string")
        got = {}
        for r in substrings.repeated_passages(rows).collect():
            assert r.source_id == r.doc_id - 10 and r.doc_id >= originals
            got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert set(got) == set(range(originals, originals + 10))
        assert all(len(hit & set(range(40, 200))) > 100 and len(hit - set(range(40, 200))) == 0 for hit in got.values())


def test_word_hashes():
    texts = [b"Hello  World\tfoo", None, b"", b" \n ", b"hello world foo", b"a\x0bb\x0cc\x1cd \xc3\x89t\xc3\xa9", b"zz " * 9 + b"y" * 40]
    whole = substrings.hash_texts(texts)
    assert [len(h) for h in whole] == [len((t or b"").split()) for t in texts] and whole[0].tolist() == whole[4].tolist()
    some = [b"ab\x00" * k + b"q" * (n % 3) for n in range(40) for k in (1, n % 17 + 1)] + [b"x" * n for n in range(1, 70)]
    assert substrings.hash_text(b"\n".join(some)).tolist() == [xxhash.xxh64_intdigest(w) for w in some]


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = [b"one two three four", None, b"five " * 20 + b"sixsixsixsixsix seven", b" x "]
    whole = [h.tolist() for h in substrings.hash_texts(texts)]
    monkeypatch.setattr(substrings, "_PIECE", 7)
    assert [h.tolist() for h in substrings.hash_texts(texts)] == whole


def test_links_of_a_crowded_group_grow_with_its_windows(spark):
    """Every window of a group is open and alike to all others: links per window, not pairs of windows."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(4000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    line = say(40)
    made = {}
    for n in (40, 160):
        docs = [(d, " ".join(say(40) + line + say(40))) for d in range(n)]
        frame = spark.createDataFrame([(d, d, t) for d, t in docs], "doc long, mark long, text string")
        found = substrings.windows(frame, substrings.MIN_WORDS, substrings.HASHES)
        grouped = substrings.grouped_windows(found, substrings.first_windows(found))
        none = spark.createDataFrame([], "doc long, mark long, source long, start int, end int")
        sketched, _ = substrings.sketches(grouped, frame, none, substrings.MIN_WORDS)
        opened = sketched.filter("open").count()
        later = substrings.later_links(sketched, substrings.MIN_WORDS)
        made[n] = later.count()
        assert opened >= n - 1 and 0 < made[n] <= (2 * substrings.MARKS + 1) * opened
        assert substrings.most_alike(later).count() <= opened
    assert made[160] < 6 * made[40]


def test_released_tables_are_empty(spark):
    kept, gone = (scale.materialize(spark.range(1000)) for _ in range(2))
    scale.release(gone)
    assert spark.read.parquet(gone.inputFiles()[0].rpartition("/")[0]).isEmpty() and kept.count() == 1000


def test_marks_of_windows_are_not_broadcast(spark, monkeypatch):
    """A window has up to 17 rows of marks, which the planner takes for one: they are merged at any size."""
    bits = ", ".join(f"-1L as s{k}" for k in range(substrings.SKETCH))
    sketched = spark.range(40).selectExpr("id as doc", "0L as at", "true as open", "id as same", "array(100L + id % 2, 200L) as marks", *bits.split(", "))
    plans = []

    def written(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return scale.materialize(df)

    monkeypatch.setattr(substrings, "_written", written)
    later = substrings.later_links(sketched, substrings.MIN_WORDS)
    # of all windows the first, of the odd ones the first odd one, too
    assert sorted((r["doc"], r["rep"]) for r in later.collect()) == sorted([(d, 0) for d in range(1, 40)] + [(d, 1) for d in range(3, 40, 2)])
    assert "(strategy=merge)" in plans[-1]
