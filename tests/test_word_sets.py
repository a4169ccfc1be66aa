"""Set joins with words that very many sets have, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from agoraflow.operators import similarity


def brute(sets, threshold):
    """All pairs that share a word, by counting shared words."""
    by_word, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for w in s:
            by_word[w].append(i)
    for members in by_word.values():
        for x in range(len(members)):
            for y in members[:x]:
                shared[y, members[x]] += 1
    out = set()
    for (i, j), n in shared.items():
        if n / (len(sets[i]) + len(sets[j]) - n) >= threshold:
            out.add(tuple(sorted((tuple(sorted(sets[i])), tuple(sorted(sets[j]))))))
    return out


def frame(spark, sets):
    return spark.createDataFrame([(sorted(s),) for s in sets], "words array<string>")


@pytest.mark.parametrize("threshold, hot", [(0.3, 5), (0.3, 1000), (0.6, 3), (1.0, 2)])
def test_equals_brute_force(spark, threshold, hot):
    rng = random.Random(int(threshold * 10))
    vocabulary = [f"w{i}" for i in range(60)]
    sets = {frozenset(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 9))) for _ in range(260)}
    sets = [set(s) for s in sets]
    got = similarity.similar_word_sets(frame(spark, sets), threshold, hot).collect()
    assert len({(tuple(r.a), tuple(r.b)) for r in got}) == len(got)
    want = brute(sets, threshold)
    assert {(tuple(r.a), tuple(r.b)) for r in got} == want and (want or threshold == 1.0)


def test_a_word_in_a_third_of_all_sets(spark):
    """20,000 sets of ten words; the hot word's sets do not meet each other under it."""
    rng = random.Random(3)
    sets = set()
    for i in range(20_000):
        words = {f"t{rng.randrange(6000)}" for _ in range(9)} | ({"hot"} if i % 3 == 0 else {f"t{rng.randrange(6000)}"})
        sets.add(frozenset(words))
    base = sorted(sets, key=sorted)[:60]
    sets |= {frozenset(sorted(s)[:8] + ["hot", "more"]) for s in base}  # similar ones
    sets = [set(s) for s in sets]
    df = frame(spark, sets)
    got = {(tuple(r.a), tuple(r.b)) for r in similarity.similar_word_sets(df, 0.3, 500).collect()}
    # shared words of the sets that have no hot word in common are few enough to count
    by_word, shared = defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for w in s - {"hot"}:
            by_word[w].append(i)
    for members in by_word.values():
        for x in range(len(members)):
            for y in members[:x]:
                shared[y, members[x]] += 1
    want = set()
    for (i, j), n in shared.items():
        n += "hot" in sets[i] and "hot" in sets[j]
        if n / (len(sets[i]) + len(sets[j]) - n) >= 0.3:
            want.add(tuple(sorted((tuple(sorted(sets[i])), tuple(sorted(sets[j]))))))
    assert got == want and len(want) >= 60
