"""Near-duplicate passages by compact windows.

Words are lower-cased, white-space separated; the tokens are shingles of ``SHINGLE`` words. For a
hash function, all subsequences [i, j] of a document whose smallest token hash stands at c form
one *compact window* (l, c, r) with l <= i <= c <= j <= r: a node of the Cartesian tree over the
hashes. Only windows that hold a passage of ``MIN_WORDS`` words are made, about two per such length.

* Windows of all documents that share function and min-hash are grouped. A group is
  represented by its first document; every other member is linked to it, so a passage that a
  third of the corpus has costs one link per window, not pairs.
* Links of two documents are joined on overlapping intervals: a place counts when windows of
  enough hash functions, with about the same shift, agree on it.
* Word for word repeats do not hang on that first document, which may share no more than the words of the
  minimum. For the first function a window carries a fingerprint of what it holds: members with the same one are
  linked to their first document. The first documents of a min-hash with several fingerprints are compared by
  every run of ``MIN_WORDS`` words around the minimum, and linked to the first document that has the run.
* A group of three or more documents may have several passages around one minimum. Its windows that no verified
  passage covers are grouped again, by their content and by ``MARKS`` smallest hashes of each side, and linked to the first document
  of each such smaller group whose sketch is alike: first to the most alike, then, where that was not verified, to all. A
  window has at most one link per smaller group, however large that is. No function else has to agree.
* What agrees is verified on the words: the passage is grown over shared shingles, and must reach
  ``MIN_WORDS`` words and a Jaccard similarity of ``SIMILARITY`` with the passage of the representative.

Each run of ``MIN_WORDS`` words has one minimum. So a passage that repeats word for word is linked to an
earlier document that has it, whatever other documents share parts of it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoraflow.functions.scale import broadcast_checked, materialize, release
from agoraflow.llm.common import LOWER, sorted_runs

SHINGLE = 5
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 4
#: Hash functions that have to agree on a place.
ENOUGH = 2
#: Words that the shift of two windows may differ by and still support each other.
SLACK = 8
BLOCK = 64
#: Longs of the sketch of a window, and the share of a shortest passage that two sketches have to have in common. A passage
#: of the least similarity shares 0.89 of its tokens; the rest is for edits that crowd around the minimum and bits that coincide.
SKETCH = 8
ALIKE = 0.65
#: Hash functions for each side of a minimum that group its windows again.
MARKS = 8
#: Windows sketched at once.
_SLICE = 4096
_CHUNK_WORDS = 500_000
#: Bytes of text hashed at once.
_PIECE = 1 << 21
_SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
          0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]

_BASE = 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)

_SPACE_BYTE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_IS_WORD = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8), invert=True)


# constants of XXH64
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))


def _xxh64(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 of many short stretches of bytes at once; those of 32 bytes or more go to the library."""
    size = end - start
    h = _P5 + size.astype(np.uint64)
    at, left = start.copy(), np.where(size < 32, size, 0)
    while len(some := np.flatnonzero(left >= 8)):
        lane = flat[at[some, None] + np.arange(8)].view("<u8")[:, 0]
        h[some] = _turned(h[some] ^ _turned(lane * _P2, 31) * _P1, 27) * _P1 + _P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    lane = flat[at[some, None] + np.arange(4)].view("<u4")[:, 0].astype(np.uint64)
    h[some] = _turned(h[some] ^ lane * _P1, 23) * _P2 + _P3
    at[some] += 4
    left[some] -= 4
    while len(some := np.flatnonzero(left > 0)):
        h[some] = _turned(h[some] ^ flat[at[some]].astype(np.uint64) * _P5, 11) * _P1
        at[some] += 1
        left[some] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(flat[start[i] : end[i]].tobytes())
    return h


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of the words of bytes that begin and end with a space."""
    flat = np.frombuffer(data, dtype=np.uint8)
    word = _IS_WORD[flat]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    return start, _xxh64(flat, start, end)


def hash_texts(texts: list[bytes | None]) -> list[np.ndarray]:
    """The 64-bit hashes of the words of each text; a null text has none."""
    out, group, size = [], [], 0

    def flush():
        start, hashes = _hash_piece(b" " + b" ".join(group) + b" ")
        ends = np.cumsum([len(t) + 1 for t in group])
        out.extend(np.split(hashes, np.searchsorted(start, ends + 1)[:-1]))
        group.clear()

    for text in texts:
        text = (text or b"").translate(LOWER)
        if group and size + len(text) > _PIECE:
            flush()
            size = 0
        if len(text) <= _PIECE:
            group.append(text)
            size += len(text)
            continue
        # a long text is cut behind the word that reaches over a piece
        parts, at = [], 0
        while at < len(text):
            space = _SPACE_BYTE.search(text, at + _PIECE)
            cut = space.start() if space else len(text)
            parts.append(_hash_piece(b" " + text[at:cut] + b" ")[1])
            at = cut
        out.append(np.concatenate(parts))
    if group:
        flush()
    return out


def hash_text(text: bytes | None) -> np.ndarray:
    return hash_texts([text])[0]


def _shingles(words: np.ndarray) -> np.ndarray:
    """One hash per run of SHINGLE words; none for a shorter text."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9DDFEA08EB382D69) + words[k : n + k].astype(np.uint64)
    return out ^ (out >> np.uint64(32))


def _sliding_min(a: np.ndarray, t: int) -> np.ndarray:
    """Minimum of each ``t`` consecutive entries, from block-wise running minima."""
    n = len(a)
    blocks = np.full(-(-n // t) * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = a
    blocks = blocks.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - t + 1], ahead[t - 1 : n])


def compact_windows(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of every Cartesian-tree node at least ``t`` wide; zeros in ``h`` part documents.

    Such a node is the minimum of some ``t`` consecutive entries, and so are the smaller entries
    that bound it. The tree is therefore built over those minima alone.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(h) < t:
        return none, none, none
    low = _sliding_min(h, t)
    padded = np.zeros(len(low) + 2 * (t - 1), dtype=np.uint64)
    padded[t - 1 : t - 1 + len(low)] = low
    highest = ~_sliding_min(~padded, t)  # the largest of the minima of all windows over an entry
    place = np.flatnonzero((highest == h) | (h == 0))
    values = h[place].tolist()
    left, right = [-1] * len(values), [len(values)] * len(values)
    stack: list[int] = []
    for i, value in enumerate(values):
        while stack and values[stack[-1]] > value:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1]
        stack.append(i)
    bounds = np.concatenate([place, [len(h), -1]])
    l = bounds[np.array(left, dtype=np.int64)] + 1  # index -1 is the -1 at the end
    r = bounds[np.array(right, dtype=np.int64)] - 1
    wide = (h[place] != 0) & (r - l + 1 >= t)
    return l[wide], place[wide], r[wide]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class RunHashes:
    """Hashes of any stretch of ``tokens`` from running sums."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens) + 1
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(tokens * _powers(_BASE, n)[:-1], out=self.sums[1:])
        self.back = _powers(_UNBASE, n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Signed hash of tokens start to end - 1, the same wherever they stand."""
        h = (self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return (h ^ (h >> np.uint64(33))).view(np.int64)


def _written(df: DataFrame) -> DataFrame:
    """``df`` written, after which the shuffle files of the write go: the steps here would else pile theirs up."""
    conf = df.sparkSession.conf
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return materialize(df)
    finally:
        conf.set(name, before)


def _doc_key(docs: DataFrame, id_col: str, text_col: str) -> F.Column:
    """The id, or for a null id a number from the text that comes after all usual ids."""
    own = F.lit(1 << 62) + F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), own)


def windows(keyed: DataFrame, min_words: int, hashes: int) -> DataFrame:
    """key, doc, at, held, sides: the compact windows of all documents of ``keyed`` (doc, text).

    ``at`` packs the place of the minimum, the function, and how far the window reaches to
    either side (up to 255 tokens; a passage needs fewer). ``held`` is a hash of the tokens that
    a passage around the minimum can have; only windows of the first function have it. ``sides`` has 14 bits of the
    smallest hash on each side of the minimum, among the tokens a passage can have there; zeros where these are few.
    """
    t = min_words - SHINGLE + 1

    def hashed(texts):
        for a in range(0, len(texts), 64):
            yield from hash_texts(texts[a : a + 64])

    def run(batches):
        for batch in batches:
            docs = batch.column(0).to_numpy()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            part: list[np.ndarray] = []
            owners: list[int] = []
            size = 0
            for i, words in enumerate(hashed(texts)):
                if len(words) >= min_words:
                    part.append(_shingles(words))
                    owners.append(i)
                    size += len(words)
                if part and (size >= _CHUNK_WORDS or i == len(texts) - 1):
                    yield from emit(part, docs[owners])
                    part, owners, size = [], [], 0

    def emit(part, owners):
        sizes = np.array([len(p) for p in part])
        border = np.zeros(1, dtype=np.uint64)
        flat = np.concatenate([x for p in part for x in (border, p)] + [border])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1
        apart = np.append(starts - 1, len(flat) - 1)
        run_hashes = RunHashes(flat)
        for f in range(hashes):
            h = (flat ^ np.uint64(_SEEDS[f])) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            h = (h ^ (h >> np.uint64(29))) | np.uint64(1)
            h[apart] = 0
            l, c, r = compact_windows(h, t)
            doc = np.searchsorted(starts, c, side="right") - 1
            at = ((c - starts[doc]) << 20) | (f << 16) | (np.minimum(c - l, 255) << 8) | np.minimum(r - c, 255)
            held = np.zeros(len(c), dtype=np.int64)
            if f == 0:
                held = run_hashes.of(np.maximum(l, c - t + 1), np.minimum(r, c + t - 1) + 1)
            sides = (_side(h, np.maximum(l, c - t + 1), c, t // 2) << 16) | _side(h, c + 1, np.minimum(r, c + t - 1) + 1, t // 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[c].view(np.int64)), pa.array(owners[doc]), pa.array(at), pa.array(held), pa.array(sides.astype(np.int32))],
                names=["key", "doc", "at", "held", "sides"],
            )

    return keyed.select("doc", "text").mapInArrow(run, "key long, doc long, at long, held long, sides int")


def _side(h: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """14 bits and a one for the smallest of entries start to end - 1, none of them 0; 0 where there are less than ``least``."""
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    last = len(h) - 1
    bounds = np.stack([np.minimum(start, last), np.minimum(end, last)], axis=1).ravel()
    low = np.minimum.reduceat(h, bounds)[::2]
    low = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    return np.where(end - start >= least, low.astype(np.int64) | 1, 0)


def first_windows(found: DataFrame) -> DataFrame:
    """key, rep, rep_at, n: the first document with a function and min-hash that others have, too, and the windows in all."""
    # written, so that the join reads two plain exchanges and a hot group can be split among tasks
    return _written(
        found.groupBy("key")
        .agg(F.min(F.struct("doc", "at")).alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
        .filter("first.doc < last")
        .select("key", F.col("first.doc").alias("rep"), F.col("first.at").alias("rep_at"), "n")
    )


def grouped_windows(found: DataFrame, groups: DataFrame) -> DataFrame:
    """key, doc, at, sides, rep, rep_at, n: the windows with the first document of their function and min-hash.

    Written, as both ``links`` and ``sketches`` read it.
    """
    return _written(found.join(groups, "key").select("key", "doc", "at", "sides", "rep", "rep_at", "n"))


def links(grouped: DataFrame) -> DataFrame:
    """doc, rep, at, rep_at: each window linked to the first document with the same function and min-hash.

    ``later_links`` links what is not verified by these.
    """
    return grouped.filter("doc != rep").select("doc", "rep", "at", "rep_at")


def _open(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The windows of ``rows`` (doc, at, ...) whose minimum no verified passage covers."""
    own = spans.select(F.col("doc").alias("_doc"), F.col("start").alias("_start"), F.col("end").alias("_end")).distinct()
    place = F.shiftright("at", 20)
    covered = (F.col("doc") == F.col("_doc")) & (place >= F.col("_start")) & (place + SHINGLE <= F.col("_end"))
    return rows.join(own, covered, "left_anti")


def sketches(grouped: DataFrame, light: DataFrame, spans: DataFrame, min_words: int):
    """Windows of the min-hashes that have open ones, and the texts of their documents; None where none is open.

    doc, at, open, same, marks, s0, s1, ...: the sketch is a set of bits, one for each token a passage around the minimum can have. ``same``
    is a hash of these tokens, and each of ``marks`` one of the min-hash and the smallest hash of a function on a side; sides too short for
    half a passage have none. A group of two windows has no other representative to try, nor has its first document.
    """
    t = min_words - SHINGLE + 1
    crowded = grouped.filter("n > 2").select("key", "doc", "at", "sides", (F.col("doc") != F.col("rep")).alias("later"))
    left = _written(_open(crowded.filter("later").select("key", "doc", "at").distinct(), spans).withColumn("open", F.lit(True)))
    if left.isEmpty():
        return None
    # most share no more than the words of the minimum: of the tokens on one side, too, the smallest has to agree
    sided = crowded.select("key", "doc", "at", F.explode(F.array(F.shiftright("sides", 16), -F.col("sides").bitwiseAND(0xFFFF))).alias("side"))
    sided = sided.filter("side != 0")
    shared = _written(
        sided.join(left, ["key", "doc", "at"], "left")
        .groupBy("key", "side")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("open").alias("open"))
        .filter("low < high and open")
        .select("key", "side")
    )
    marked = _written(
        sided.join(shared, ["key", "side"], "left_semi")
        .select("key", "doc", "at")
        .distinct()
        .join(left, ["key", "doc", "at"], "left")
    )
    if marked.isEmpty():
        return None
    # at most one entry per compact window of the document
    places = _written(
        marked.groupBy("doc").agg(F.collect_list(F.struct("key", "at", F.coalesce("open", F.lit(False)).alias("open"))).alias("places"))
    )
    few = broadcast_checked(places.select("doc"))
    texts = _written(light.join(few, "doc", "left_semi"))

    names = ["doc", "at", "open", "same", "marks", *(f"s{k}" for k in range(SKETCH))]
    kinds = "doc long, at long, open boolean, same long, marks array<long>, " + ", ".join(f"s{k} long" for k in range(SKETCH))

    def run(batches):
        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for i, (doc, places) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                tokens = _shingles(hash_text(column[i].as_py()))
                keys, at, opened = (places.values.field(f).to_numpy(zero_copy_only=False) for f in ("key", "at", "open"))
                kept = (at >> 20) < len(tokens)
                keys, at, opened = keys[kept], at[kept], opened[kept]
                if not len(at):
                    continue
                runs = RunHashes(tokens)
                for a in range(0, len(at), _SLICE):
                    part = slice(a, a + _SLICE)
                    same, marks, bits = _sketch(tokens, runs, keys[part], at[part], t)
                    arrays = [np.full(len(same), doc), at[part], opened[part], same, marks, *(np.ascontiguousarray(bits[:, k]) for k in range(SKETCH))]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=names)

    rows = texts.hint("merge").join(places, "doc").select("doc", "text", "places")
    return _written(rows.mapInArrow(run, kinds)), texts


def _sketch(tokens: np.ndarray, runs: RunHashes, keys: np.ndarray, at: np.ndarray, t: int):
    """(same, marks, bits) of windows of a text, as ``sketches`` has them."""
    c = at >> 20
    low = np.maximum(c - np.minimum((at >> 8) & 255, t - 1), 0)
    high = np.minimum(c + np.minimum(at & 255, t - 1) + 1, len(tokens))
    width = high - low
    row = np.repeat(np.arange(len(c)), width)
    token = np.arange(len(row)) + np.repeat(low - np.append(0, np.cumsum(width)[:-1]), width)
    bit = ((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(64 * SKETCH)
    flags = np.zeros((len(c), 64 * SKETCH), dtype=bool)
    flags[row, bit[token]] = True
    group = keys.view(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    same = (runs.of(low, high).view(np.uint64) ^ group).view(np.int64)
    marks, has = [], []
    for start, end in ((low, c), (c + 1, high)):
        # an entry behind the last token, so that a side may begin there
        bounds = np.stack([start, np.maximum(end, start)], axis=1).ravel()
        for f in range(MARKS):
            h = (tokens ^ np.uint64(_SEEDS[-1 - f])) * np.uint64(0xFF51AFD7ED558CCD)
            h = np.append(h ^ (h >> np.uint64(32)), np.uint64(0))
            smallest = np.minimum.reduceat(h, bounds)[::2]
            mark = (smallest + np.uint64(len(marks))) * np.uint64(0xC4CEB9FE1A85EC53)
            marks.append(((mark ^ (mark >> np.uint64(29))) + group).view(np.int64))
            has.append(end - start >= t // 2)
    has = np.stack(has, axis=1)
    ends = np.append(0, np.cumsum(has.sum(axis=1))).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack(marks, axis=1)[has]))
    return same, listed, np.packbits(flags, axis=1).view(np.int64)


def later_links(sketched: DataFrame, min_words: int) -> DataFrame:
    """doc, at, rep, rep_at, shared: the open windows with earlier ones whose surroundings are alike, and the bits they share.

    Windows that hold the same are one class, for which the first document stands. Classes meet in groups by their marks, where the
    first document stands for the others again: a window has no more links than marks, and no group is held.
    """
    bits = [f"s{k}" for k in range(SKETCH)]
    classes = _written(sketched.groupBy("same").agg(F.min(F.struct("doc", "at", "marks", *bits)).alias("first")).select("same", "first.*"))
    every = F.explode(F.concat(F.array("same"), "marks")).alias("mark")
    firsts = classes.select("doc", "at", every).groupBy("mark").agg(F.min(F.struct("doc", "at")).alias("first"))
    firsts = firsts.select("mark", F.col("first.doc").alias("rep"), F.col("first.at").alias("rep_at"))
    opened = sketched.filter("open")
    # merged in any case: the planner sizes a window with its marks like one row, and would send them to the driver
    marked = opened.select("doc", "at", every).hint("merge")
    met = marked.join(firsts, "mark").filter("rep < doc").select("doc", "at", "rep", "rep_at").distinct()
    theirs = classes.select(F.col("doc").alias("rep"), F.col("at").alias("rep_at"), *[F.col(b).alias(f"_{b}") for b in bits])
    shared = sum((F.bit_count(F.col(b).bitwiseAND(F.col(f"_{b}"))) for b in bits), F.lit(0))
    scored = met.join(opened.select("doc", "at", *bits), ["doc", "at"]).join(theirs, ["rep", "rep_at"]).withColumn("shared", shared)
    return _written(scored.filter(F.col("shared") >= int(ALIKE * (min_words - SHINGLE + 1))).select("doc", "at", "rep", "rep_at", "shared"))


def most_alike(linked: DataFrame) -> DataFrame:
    """Of the links of each window the one with the most bits, ties to the first document."""
    best = F.max_by(F.struct("rep", "rep_at"), F.struct("shared", -F.col("rep"), -F.col("rep_at")))
    return linked.groupBy("doc", "at").agg(best.alias("_b")).select("doc", "at", "_b.*")


def blocks_to_compare(linked: DataFrame) -> DataFrame:
    """doc, rep, block: the blocks of the representative around the minimum of each link."""
    reach = lambda bits: F.shiftright("rep_at", bits).bitwiseAND(255) + SLACK
    middle = F.shiftright("rep_at", 20)
    before = F.least(reach(8), middle)
    return linked.select("doc", "rep", _covered(middle, before, reach(0)).alias("block")).distinct()


def _covered(place, before, behind) -> F.Column:
    """The blocks from ``before`` tokens ahead of a token to the words of the one ``behind`` it."""
    first = F.floor((place - before) / BLOCK)
    last = F.floor((place + behind + F.lit(SHINGLE - 1)) / BLOCK)
    return F.explode(F.sequence(first.cast("int"), last.cast("int")))


def exact_links(found: DataFrame, light: DataFrame, min_words: int) -> DataFrame:
    """doc, rep, block: for every run of ``min_words`` words that an earlier document has, such a document.

    A window is resolved by an earlier document whose window holds the same. What is left, the first document
    of each such class, is compared run by run, where the min-hash has other classes.
    """
    t = min_words - SHINGLE + 1
    reach = lambda at, bits: F.least(F.shiftright(at, bits).bitwiseAND(255), F.lit(t - 1))
    own = found.filter(F.shiftright("at", 16).bitwiseAND(15) == 0)
    # written, as in links
    held = _written(
        own.groupBy("key", "held")
        .agg(F.min(F.struct("doc", "at")).alias("first"), F.max("doc").alias("last"))
        .select("key", "held", F.col("first.doc").alias("rep"), F.col("first.at").alias("rep_at"), "last")
    )
    at = F.col("rep_at")
    same = _written(
        own.join(held.filter("rep < last").drop("last"), ["key", "held"])
        .filter("doc != rep")
        .select("doc", "rep", _covered(F.shiftright(at, 20), reach(at, 8), reach(at, 0)).alias("block"))
        .distinct()
    )
    mixed = _written(
        held.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("rep").alias("low"), F.max("rep").alias("high"))
        .filter("n > 1 and low < high")
        .select("key")
    )
    # at most one entry per compact window of the document
    places = _written(
        held.join(mixed, "key").groupBy(F.col("rep").alias("doc")).agg(F.collect_list("rep_at").alias("places"))
    )

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, (doc, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                tokens = _shingles(hash_text(texts[i].as_py()))
                at = np.array(packed, dtype=np.int64)
                c = at >> 20
                # a row whose document key is shared may belong to another text
                at, c = at[c < len(tokens)], c[c < len(tokens)]
                low = np.maximum(c - np.minimum((at >> 8) & 255, t - 1), 0)
                high = np.minimum(np.minimum(c, c + np.minimum(at & 255, t - 1) - t + 1), len(tokens) - t)
                times = np.maximum(high - low + 1, 0)
                start = np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(RunHashes(tokens).of(start, start + t)), pa.array(np.full(len(start), doc)), pa.array(start)],
                    names=["run", "doc", "place"],
                )

    runs = _written(
        light.hint("merge").join(places, "doc").select("doc", "text", "places").mapInArrow(run, "run long, doc long, place long")
    )
    firsts = _written(
        runs.groupBy("run")
        .agg(F.min(F.struct("doc", "place")).alias("first"), F.max("doc").alias("last"))
        .filter("first.doc < last")
        .select("run", F.col("first.doc").alias("rep"), F.col("first.place").alias("rep_place"))
    )
    alike = (
        runs.join(firsts, "run")
        .filter("doc != rep")
        .select("doc", "rep", _covered(F.col("rep_place"), F.lit(0), F.lit(t - 1)).alias("block"))
    )
    linked = _written(same.union(alike))
    release(held, same, mixed, places, runs, firsts)
    return linked


def candidates(linked: DataFrame, enough: int, min_words: int) -> DataFrame:
    """doc, rep, blocks: pairs whose windows agree, with the blocks of the representative to compare.

    An interval join of the links of a pair: windows that overlap with about the same shift support
    each other (inside one passage their minima are less than ``min_words`` apart); a link counts when
    ``enough`` functions, its own included, support it.
    """
    parts = int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for rows in sorted_runs(batches, 2):
            doc, rep, at, rep_at = (rows.column(i).to_numpy() for i in range(4))
            c, f = at >> 20, (at >> 16) & 15
            shift = (rep_at >> 20) - c
            low, high = c - ((at >> 8) & 255), c + (at & 255)
            support = np.int64(1) << f
            alive, d = np.arange(len(doc)), 1
            while True:
                alive = alive[alive + d < len(doc)]
                other = alive + d
                near = (doc[alive] == doc[other]) & (rep[alive] == rep[other]) & (c[other] - c[alive] < min_words)
                alive, other = alive[near], other[near]
                if not len(alive):
                    break
                agree = (low[other] <= high[alive]) & (low[alive] <= high[other])
                agree &= np.abs(shift[alive] - shift[other]) <= SLACK
                a, b = alive[agree], other[agree]
                np.bitwise_or.at(support, a, np.int64(1) << f[b])
                np.bitwise_or.at(support, b, np.int64(1) << f[a])
                d += 1
            kept = np.flatnonzero(np.bitwise_count(support.view(np.uint64)) >= enough)
            if not len(kept):
                continue
            doc, rep, rep_at = doc[kept], rep[kept], rep_at[kept]
            middle = rep_at >> 20
            first = np.maximum(middle - ((rep_at >> 8) & 255) - SLACK, 0) // BLOCK
            last = (middle + (rep_at & 255) + SHINGLE + SLACK) // BLOCK
            new = np.append(True, (doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1]))
            begin = np.flatnonzero(new)
            blocks = [
                np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(first[a:b], last[a:b])]))
                for a, b in zip(begin, np.append(begin[1:], len(doc)))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[begin]), pa.array(rep[begin]), pa.array(blocks, pa.list_(pa.int32()))],
                names=["doc", "rep", "blocks"],
            )

    return (
        linked.repartition(parts, "doc")
        .sortWithinPartitions("doc", "rep", "at")
        .mapInArrow(run, "doc long, rep long, blocks array<int>")
    )


def _blocks_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, block, words: the hashed words of the wanted blocks, with the four words behind each."""

    def run(batches):
        for batch in batches:
            reps, numbers, pieces = [], [], []
            texts = batch.column(1).cast(pa.binary())
            for i, (doc, blocks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                words = hash_text(texts[i].as_py()).astype("<u4")
                for b in blocks:
                    piece = words[b * BLOCK : (b + 1) * BLOCK + SHINGLE - 1].tobytes()
                    if piece:
                        reps.append(doc)
                        numbers.append(b)
                        pieces.append(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, pa.int64()), pa.array(numbers, pa.int32()), pa.array(pieces, pa.binary())],
                names=["rep", "block", "words"],
            )

    # merged in any case: a corpus is not to be planned one way when small and another when large
    joined = docs.hint("merge").join(wanted, "doc")
    return joined.select("doc", "text", "blocks").mapInArrow(run, "rep long, block int, words binary")


def _grown(mark: np.ndarray) -> list[list[tuple[int, int]]]:
    """Groups of runs of marked tokens, joined while enough of what they span is marked.

    With a share c marked on both sides the Jaccard similarity is c / (2 - c).
    """
    share = 2 * SIMILARITY / (1 + SIMILARITY)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    out: list[list[tuple[int, int]]] = []
    hits = 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if out and hits + b - a >= share * (b - out[-1][0][0]):
            out[-1].append((a, b))
            hits += b - a
        else:
            out.append([(a, b)])
            hits = b - a
    return out


def _similar(own: np.ndarray, theirs: np.ndarray, place: np.ndarray, start: int, size: int) -> bool:
    """Whether the tokens ``own`` are similar to those of the other text from about ``start`` on."""
    shared = np.isin(theirs, own) & (place >= start - SLACK) & (place < start + size + SLACK)
    if not shared.any():
        return False
    low, high = place[shared].min(), place[shared].max()
    passage, mine = np.unique(theirs[(place >= low) & (place <= high)]), np.unique(own)
    both = np.isin(mine, passage).sum()
    return both >= SIMILARITY * (len(mine) + len(passage) - both)


def verify(words: np.ndarray, evidence: list[tuple[int, int, bytes]], min_words: int) -> list[tuple[int, int, int]]:
    """(rep, start, end) word spans of ``words`` that repeat a passage of a representative.

    ``evidence`` has (rep, block, hashed words with those behind).
    """
    own = _shingles(words.astype(np.uint32))
    by_rep: dict[int, dict[int, bytes]] = {}
    for rep, block, data in evidence:
        by_rep.setdefault(rep, {})[block] = data
    found = []
    for rep in sorted(by_rep):
        theirs, place = [], []
        for block, data in sorted(by_rep[rep].items()):
            s = _shingles(np.frombuffer(data, dtype="<u4"))
            theirs.append(s)
            place.append(block * BLOCK + np.arange(len(s)))
        theirs, place = np.concatenate(theirs), np.concatenate(place)
        if not len(theirs):
            continue
        order = np.argsort(theirs, kind="stable")
        at = np.minimum(np.searchsorted(theirs[order], own), len(theirs) - 1)
        hit = theirs[order][at] == own
        aligned = place[order][at] - np.arange(len(own))
        todo = _grown(hit)
        while todo:
            runs = todo.pop()
            a, b = runs[0][0], runs[-1][1]
            if b - a + SHINGLE - 1 < min_words:
                continue
            # where the other passage starts: the shift most tokens have, else the next one
            shift, votes = np.unique(aligned[a:b][hit[a:b]], return_counts=True)
            shifts = shift[np.lexsort((-shift, -votes))].tolist()
            if any(_similar(own[a:b], theirs, place, a + x, b - a) for x in shifts):
                found.append((rep, a, b + SHINGLE - 1))
            elif len(runs) > 1:  # part it at its widest gap
                gaps = [y[0] - x[1] for x, y in zip(runs, runs[1:])]
                cut = gaps.index(max(gaps)) + 1
                todo += [runs[:cut], runs[cut:]]
    return found


def _verified(pairs: DataFrame, light: DataFrame, min_words: int) -> DataFrame:
    """doc, mark, source, start, end: the passages of each row of ``light`` that the linked blocks bear out."""
    wanted = (
        pairs.select(F.col("rep").alias("doc"), "block")
        .distinct()
        .groupBy("doc")
        .agg(F.collect_list("block").alias("blocks"))  # at most one per BLOCK words of the document
    )
    held = pairs.join(_blocks_of(light, wanted), ["rep", "block"])
    evidence = held.groupBy("doc").agg(F.collect_list(F.struct("rep", "block", "words")).alias("e"))
    joined = light.hint("merge").join(evidence, "doc").select("doc", "text", "mark", "e")

    def run(batches):
        for batch in batches:
            found = _found_in(batch.column(3), batch.column(1).cast(pa.binary()), min_words)
            rows = [(d, m, *span) for d, m, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), found) for span in spans]
            columns = list(zip(*rows)) or [[], [], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "mark", "source", "start", "end"]
            )

    return joined.mapInArrow(run, "doc long, mark long, source long, start int, end int")


def _passages(light: DataFrame, min_words: int, hashes: int, enough: int) -> DataFrame:
    """doc, mark, source, start, end: the repeated passages of each row of ``light`` (doc, mark, text)."""
    found = _written(windows(light, min_words, hashes))
    exact = exact_links(found, light, min_words)
    groups = first_windows(found)
    grouped = grouped_windows(found, groups)
    release(found, groups)
    agreed = _written(candidates(links(grouped), enough, min_words)).select("doc", "rep", F.explode("blocks").alias("block"))
    pairs = _written(agreed.union(exact).distinct())
    release(exact)
    spans = _written(_verified(pairs, light, min_words))
    crowded = sketches(grouped, light, spans, min_words)
    release(grouped)
    if crowded is None:
        return spans
    sketched, texts = crowded
    later = later_links(sketched, min_words)
    release(sketched)
    for best in (True, False):
        pairs = _written(blocks_to_compare(most_alike(later) if best else _open(later, spans)))
        if not pairs.isEmpty():
            fresh = _written(_verified(pairs, texts, min_words))
            spans = spans.union(fresh.join(spans, fresh.columns, "left_anti"))
    return spans


def _found_in(column: pa.Array, texts: pa.Array, min_words: int) -> list[list[tuple[int, int, int]]]:
    """The verified spans of each text of a batch, from its evidence."""
    sizes = np.diff(column.offsets.to_numpy())
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    parts = column.flatten()  # of the rows that are not null
    reps, blocks = parts.field("rep").to_numpy(), parts.field("block").to_numpy()
    words = parts.field("words")
    out, at = [], 0
    for i in range(len(column)):
        n = int(sizes[i]) if valid[i] else 0
        if n:
            own = hash_text(texts[i].as_py()).astype(np.uint32)
            given = zip(reps[at : at + n].tolist(), blocks[at : at + n].tolist(), words.slice(at, n).to_pylist())
            out.append(verify(own, list(given), min_words))
        else:
            out.append([])
        at += n
    return out


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    hashes: int = HASHES,
    enough: int = ENOUGH,
) -> DataFrame:
    """doc_id, source_id, start, end: one row per repeated passage, places in words of the document.

    Classes are given by their representative, the source: a document with a smaller id. Documents without a
    repeat have no row. Rows that share an id count as one document: repeats between them are not sought.
    Null ids are told apart by their texts, come last, and are given as null. Null, empty and short texts
    have no repeats; an empty table gives none.
    """
    text = F.col(f"`{text_col}`")
    light = docs.select(_doc_key(docs, id_col, text_col).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    found = _passages(light, min_words, hashes, enough)
    given = lambda c: F.when(F.col(c) < F.lit(1 << 62), F.col(c))
    return found.select(
        given("doc").alias("doc_id"), given("source").alias("source_id"), "start", "end"
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    hashes: int = HASHES,
    enough: int = ENOUGH,
) -> DataFrame:
    """``docs`` without the repeated passages; documents of which no word is left are dropped.

    The representative keeps its passage, and a document without repeats its text, byte for byte. Rows
    are as for ``repeated_passages``. Names that start with an underscore are taken for the working columns.
    """
    names = docs.columns
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumn("_doc", _doc_key(docs, id_col, text_col)).withColumn("_mark", F.xxhash64(text))
    found = _passages(keyed.select(F.col("_doc").alias("doc"), F.col("_mark").alias("mark"), text.alias("text")), min_words, hashes, enough)
    # those of one text, once
    spans = found.groupBy(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    joined = keyed.hint("merge").join(spans, ["_doc", "_mark"], "left").select(*[F.col(f"`{c}`") for c in names], "_spans")
    text_at = names.index(text_col)
    schema = T.StructType([*docs.schema, T.StructField("_emptied", T.BooleanType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            cut, emptied = [], []
            for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                was = texts[i].as_py()
                left = _cut(was, sorted((x["start"], x["end"]) for x in spans or ()))
                cut.append(left)
                emptied.append(bool(spans) and not left)
            arrays = [batch.column(i) for i in range(len(names))]
            arrays[text_at] = pa.array(cut, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(emptied)], names=schema.names)

    return joined.mapInArrow(run, schema).filter("not _emptied").select(*[F.col(f"`{c}`") for c in names])


def _cut(text: bytes | None, spans: list[tuple[int, int]]) -> bytes | None:
    """The text without the words of the spans; what stays on either side is put on lines of its own."""
    if text is None or not spans:
        return text
    flat = np.isin(np.frombuffer(text, dtype=np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8), invert=True)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    kept, at = [], 0
    for a, b in spans:
        if end[b - 1] <= at:
            continue
        kept.append(text[at : max(at, begin[a])].strip())
        at = end[b - 1]
    kept.append(text[at:].strip())
    return b"\n".join(p for p in kept if p)
