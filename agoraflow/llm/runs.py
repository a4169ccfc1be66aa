"""Periodic runs of words by a suffix automaton with link-cut access.

The prefixes of a text are leaves of the tree of its automaton's suffix links. As each word is
appended, the path from its prefix to the root is taken as one path (access of a link-cut
tree) and coloured with the word's place. The path falls into segments by the colour they had,
the place where the segment's strings ended last. Where that distance is within the
segment's length, the two ends overlap in a square; its period is the distance, the start of its
run follows from the length, and the end by comparing words one period apart.

Only stretches that can hold a run are put into an automaton. A run of period q and length
L has L - q - m + 1 consecutive word sequences of m words that stood at most q words before, for
every m up to q; stretches without that many are left out, which loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoraflow.llm.common import SLICE_ROWS, utf8

#: Words of the sequences by which longer periods are sought; shorter periods are compared word by word.
GRAM = 8
#: Words of the texts that are searched together.
SEARCH_WORDS = 500_000
_FACTOR = 0x9E3779B97F4A7C15


def suffix_automaton(words: Sequence) -> tuple[list[int], list[int], list[int]]:
    """(suffix links, lengths of the longest strings, states of the prefixes); state 0 is the root."""
    moves: list[dict] = [{}]
    link, length, prefixes = [-1], [0], []
    last = 0
    for w in words:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                split = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = split
                    p = link[p]
                link[q] = link[new] = split
        prefixes.append(new)
        last = new
    return link, length, prefixes


class Paths:
    """A tree cut into coloured paths, each kept as a splay tree by depth.

    All nodes of a path have its colour, which is held at the root of its splay tree. Node 0 stands for none.
    """

    def __init__(self, parents: Sequence[int]):
        n = len(parents) + 1
        self.parent = [0] + [p + 1 for p in parents]
        self.above, self.below, self.colour = [0] * n, [0] * n, [-1] * n

    def _rotate(self, x: int) -> None:
        parent, above, below = self.parent, self.above, self.below
        y = parent[x]
        z = parent[y]
        if above[y] == x:
            b = below[x]
            above[y], below[x] = b, y
        else:
            b = above[x]
            below[y], above[x] = b, y
        if b:
            parent[b] = y
        parent[y], parent[x] = x, z
        if z and above[z] == y:
            above[z] = x
        elif z and below[z] == y:
            below[z] = x
        else:
            self.colour[x] = self.colour[y]

    def _splay(self, x: int) -> None:
        parent, above, below = self.parent, self.above, self.below
        while True:
            y = parent[x]
            if not y or (above[y] != x and below[y] != x):
                return
            z = parent[y]
            if z and (above[z] == y or below[z] == y):
                self._rotate(y if (above[y] == x) == (above[z] == y) else x)
            self._rotate(x)

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Colour the path from ``node`` to the root; (lowest node, colour it had) of each segment, upwards."""
        parent, below, colours = self.parent, self.below, self.colour
        segments = []
        x, lower = node + 1, 0
        while x:
            self._splay(x)
            old = colours[x]
            segments.append((x - 1, old))
            rest = below[x]
            if rest:
                colours[rest] = old
            below[x] = lower
            lower, x = x, parent[x]
        colours[lower] = colour
        return segments


def runs_of(words: Sequence, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words``: length at least ``least`` and ``times`` periods."""
    link, length, prefixes = suffix_automaton(words)
    paths = Paths(link)
    n = len(words)
    known: dict[tuple[int, int], int] = {}
    for end, state in enumerate(prefixes):
        for node, before in paths.access(state, end):
            if before < 0:
                continue
            period, common = end - before, length[node]
            if common + period < least or common < (times - 1) * period:
                continue
            start = end - common - period + 1
            if (start, period) not in known:
                stop = end + 1
                while stop < n and words[stop] == words[stop - period]:
                    stop += 1
                known[start, period] = stop - start
    return sorted((start, size, period) for (start, period), size in known.items())


def _stretches(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches of consecutive numbers in an ascending array."""
    breaks = np.flatnonzero(np.diff(marks) != 1) + 1
    first = np.concatenate(([0], breaks))
    return marks[first], np.diff(np.concatenate((first, [len(marks)])))


def _gram_distances(hashes: np.ndarray, text: np.ndarray, place: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose next ``GRAM`` words stood before in the same text, and the distance to the last time."""
    with np.errstate(over="ignore"):
        factor = np.uint64(_FACTOR)
        gram, width = hashes.view(np.uint64), 1
        while width < GRAM:
            gram = gram[:-width] + factor * gram[width:]
            factor, width = factor * factor, width * 2
        whole = np.flatnonzero(left[: len(gram)] >= GRAM)
        key = (gram[whole] + text[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(_FACTOR)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    at = whole[order[same + 1]]
    distance = at - whole[order[same]]
    by_place = np.argsort(at)
    return at[by_place], distance[by_place]


def regions(hashes: np.ndarray, sizes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of the joined texts that hold all their runs; none crosses a text's border."""
    total = len(hashes)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(total) - starts[text]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for q in range(1, GRAM):
        equal = np.flatnonzero((hashes[q:] == hashes[:-q]) & (place[q:] >= q)) + q
        if len(equal):
            first, size = _stretches(equal)
            enough = size >= max(least, times * q) - q
            found.append((first[enough] - q, first[enough] + size[enough]))
    if total >= GRAM:
        at, distance = _gram_distances(hashes, text, place, sizes[text] - place)
        q = GRAM
        while len(at) and q * times <= int(sizes.max()):
            near = at[distance < 2 * q]
            if len(near):
                first, size = _stretches(near)
                enough = size >= (times - 1) * q - GRAM + 1
                low = np.maximum(first - (2 * q - 1), starts[text[first]])
                found.append((low[enough], (first + size + GRAM - 1)[enough]))
            q *= 2
    if not found:
        return []
    low = np.concatenate([f[0] for f in found])
    high = np.concatenate([f[1] for f in found])
    merged: list[tuple[int, int]] = []
    for i in np.argsort(low, kind="stable"):
        a, b = int(low[i]), int(high[i])
        if merged and a < merged[-1][1] and text[a] == text[merged[-1][0]]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def find_runs(texts: Sequence[list], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, by start, then period."""
    result: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not sizes.sum():
        return result
    hashes = np.fromiter((hash(w) for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    ends = np.cumsum(sizes)
    for a, b in regions(hashes, sizes, least, times):
        i = int(np.searchsorted(ends, a, side="right"))
        begin = a - int(ends[i] - sizes[i])
        words = texts[i][begin : begin + b - a]
        result[i] += [(begin + start, size, period) for start, size, period in runs_of(words, least, times)]
    return result


def collapsed(words: list[bytes], runs: Sequence[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)])


def _groups(texts: list[list]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``SEARCH_WORDS`` words."""
    a, held = 0, 0
    for i, words in enumerate(texts):
        held += len(words)
        if held >= SEARCH_WORDS:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _worker(text_col: str, kept: list[str], least: int, times: int) -> Callable:
    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE_ROWS):
                row = whole.slice(first, SLICE_ROWS).column(0)
                texts = [(t or b"").split() for t in utf8(row.field(text_col))]
                runs: list[list[tuple[int, int, int]]] = []
                for a, b in _groups(texts):
                    runs += find_runs(texts[a:b], least, times)
                flat = np.array([r for found in runs for r in found], dtype=np.int64).reshape(-1, 3)
                offsets = np.cumsum([0] + [len(found) for found in runs]).astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.StructArray.from_arrays([row.field(c) for c in kept], names=kept),
                        pa.array([len(w) for w in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), struct),
                        pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string()),
                    ],
                    names=["row", "n_words", "runs", "collapsed"],
                )

    return run


def periodic_runs(
    docs: DataFrame, text_col: str = "text", least: int = 6, times: int = 4, keep: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, runs and collapsed.

    ``runs`` lists (start, length, period) of all runs by start, then period; places are word
    numbers from 0, words are what ASCII white space separates. A run is as long as ``least`` words and ``times``
    (2 or more) of its smallest period, and no neighbouring word extends it. ``collapsed`` is the text
    with its white space as single spaces and without the words that a run has after its first period.

    A null or empty text has no words, no runs and an empty ``collapsed``. A row is worked on by
    itself, whatever ids or other columns hold; memory grows with the longest repetitive stretch of one text. An
    empty table gives none. Columns named like a new one are replaced.
    """
    if times < 2:
        raise ValueError("times must be 2 or more: a run repeats its period at least once")
    new = StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    kept = [c for c in docs.columns if (keep is None or c in keep) and c not in new.names]
    inputs = [c for c in docs.columns if c in kept or c == text_col]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in inputs]).alias("row"))
    row = StructType([f for f in base.schema["row"].dataType if f.name in kept])
    schema = StructType().add("row", row)
    for field in new:
        schema.add(field)
    found = base.mapInArrow(_worker(text_col, kept, least, times), schema)
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], *new.names)


def with_repeated_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which the texts of a tenth of the ids end in a repeated passage.

    With h = crc32 of the decimal id, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0, every word
    i >= a is replaced by word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    Null ids and texts stay as they are. Extra columns pass.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row").getField(text_col)
    h = F.crc32(F.col("row").getField(id_col).cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    chosen = inner.withColumn("words", words).withColumn("g", F.floor(h / 10)).withColumn("n", F.size("words"))
    a = F.pmod(F.col("g"), F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    left = F.col("n") - F.col("a")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    ended = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    placed = chosen.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    return placed.select(
        *[
            (F.when(F.col("n") > 0, ended).otherwise(F.col("row").getField(c)) if c == text_col else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )


#: Pairs of equal three-word sequences by distance, put together to stretches.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda crc, b: xor(xor(crc, b) >> 1, 3988292384 * (xor(crc, b) & 1)), 4294967295), 4294967295) AS h
  FROM documents),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM docs),
placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sized),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w
  FROM periods),
words AS MATERIALIZED (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts),
grams AS MATERIALIZED (
  SELECT * FROM (
    SELECT doc_id, n, i, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM words
    WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  WHERE third IS NOT NULL),
equal AS (
  SELECT y.doc_id, y.i, y.i - x.i AS q
  FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.word = y.word AND x.second = y.second AND x.third = y.third
    AND x.i < y.i AND 4 * (y.i - x.i) <= y.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
stretches AS (
  SELECT doc_id, q, min(i) - q AS start, max(i) + 3 - (min(i) - q) AS length FROM islands GROUP BY doc_id, q, island),
runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(q) AS period FROM stretches
  WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
lists AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS list,
    max(length) AS longest FROM runs GROUP BY doc_id),
first AS (
  SELECT doc_id, start, length, period FROM runs JOIN lists USING (doc_id) WHERE length = longest
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start, period) = 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN lists USING (doc_id) LEFT JOIN first USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
