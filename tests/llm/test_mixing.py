"""Mixes: targets by water filling, thresholds by histograms, against plain sorting."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from agoraflow.llm import mixing


def brute_targets(sizes, weights, share, cap):
    """Share by weight; cut what is above its cap; share the excess again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, free = sum(sizes.values()) * share[0] / share[1], {}, set(names)
    while free:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        for s in over or free:
            target[s] = cap * sizes[s] if over else level * weight[s]
        budget -= sum(cap * sizes[s] for s in over)
        free = free - over if over else set()
    return target


def brute_taken(rows, target, sizes, seed=7):
    """{place of the row: times} from a sort by key."""
    by_source = defaultdict(list)
    for i, (doc_id, text, source) in enumerate(rows):
        key = hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{text or ''}".encode()).hexdigest()
        by_source[source].append((key, i, len((text or "").split(" ")) if text else 0))
    times = {}
    for s, members in by_source.items():
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        need, before = target[s] - epochs * sizes[s], 0
        for _, i, n in sorted(members):
            more = n > 0 and before <= need and (before + n <= need or 2 * (need - before) >= n)
            times[i] = epochs + (1 if more else 0)
            before += n
    return times


def make(spark, rows):
    return spark.createDataFrame([(d, t, s, i) for i, (d, t, s) in enumerate(rows)], "doc_id long, text string, source string, place int")


@pytest.mark.parametrize("share", [(3, 2), (1, 4), (19, 10)])
def test_against_sorting(spark, share):
    rng = random.Random(share[0])
    names = ["b", "a", None, "Z", "é", "\U0001f600", "￿"]
    counts = [900, 5, 40, 300, 1, 80, 0]
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 3, 20, 200]))), s) for s, n in zip(names, counts) for i in range(n)]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    target = brute_targets(sizes, (3, 1, 2), share, 2)
    times = brute_taken(rows, target, sizes)
    out = mixing.mix(make(spark, rows), share=share).collect()
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        assert r.size == len(r.text.split()) and r.source_size == sizes[r.source] and r.taken == r.times * r.size
        assert r.target == pytest.approx(target[r.source], rel=1e-12) and 0 <= r.times <= 2
        assert r.times == times[r.place]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 100  # half of the longest text
    assert sum(target.values()) == pytest.approx(sum(sizes.values()) * share[0] / share[1])


def test_larger_budgets_include_smaller_ones(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(400)]
    small = {r.place: r.times for r in mixing.mix(make(spark, rows), share=(1, 5)).collect()}
    large = {r.place: r.times for r in mixing.mix(make(spark, rows), share=(4, 5)).collect()}
    assert all(large[p] >= small[p] for p in small) and sum(large.values()) > sum(small.values())


def test_copies_are_cut_like_other_rows(spark):
    """A third of all rows are one row: their keys differ only in the digits of the place."""
    rows = [(None, "a b c", "x")] * 3000 + [(i, "q r", "x") for i in range(2000)] + [(i, "q", "y") for i in range(3000)]
    out = mixing.mix(make(spark, rows), share=(1, 3), weights=(1, 1)).collect()
    target = {r.source: r.target for r in out}
    taken = {s: sum(r.taken for r in out if r.source == s) for s in target}
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 2 for s in target)


def test_reruns_and_other_files_agree(spark):
    rows = [(i % 90, "w " * (i % 13), ["s", None, "t"][i % 3]) for i in range(500)]
    docs = make(spark, rows)
    bag = lambda df: sorted((r.doc_id, r.size, r.taken) for r in df.collect())
    one = bag(mixing.mix(docs))
    assert one == bag(mixing.mix(docs)) == bag(mixing.mix(docs.repartition(13)))


def test_odd_rows(spark):
    rows = [(1, None, "a"), (None, "", "a"), (2, "\t\n x y  z ", "a"), (3, "w " * 50_000, None), (3, "w " * 50_000, None)]
    docs = make(spark, rows).selectExpr("*", "'own' as size", "1 as key", "2 as row", "3 as threshold")
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "text", "source", "place", "key", "row", "threshold", "size", "source_size", "target", "times", "taken"]
    out = {r.place: r for r in got.collect()}
    assert len(out) == 5 and {out[p].size for p in (0, 1)} == {0} and out[2].size == 2 and out[3].size == 50_000
    assert {(r.key, r["row"], r.threshold) for r in out.values()} == {(1, 2, 3)}
    assert out[2].target == 4.0 and out[2].taken == 4  # never above twice the source
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.mix(make(spark, rows[:2])).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0)] * 2


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(make(spark, [(1, "a", "x"), (2, "b c", "y")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_write(spark, tmp_path):
    rows = [(i, "w " * 3, "ab"[i % 2]) for i in range(60)]
    mixed = mixing.mix(make(spark, rows))
    mixing.write_mix(mixed, str(tmp_path / "mix"))
    total = sum(r.times for r in mixed.collect())
    assert spark.read.parquet(str(tmp_path / "mix")).count() == total == 90
