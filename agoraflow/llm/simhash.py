"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are linked at ``THRESHOLD`` or fewer differing bits. The
anchors are the codewords of a covering code: each 32-bit half of a fingerprint is
covered by the perfect Hamming code of 31 bits (covering radius 1) with one free
bit. Two fingerprints that differ in 3 bits or fewer differ in at most 1 bit on one
half. On that half the nearest anchor of the one (distance at most 1, the covering
radius) lies within 1 + 1 = 2 bits of the other. So every fingerprint is replicated to
all anchors within radius plus threshold, 2 bits, of each half (at most 17 of them),
and each pair in question meets at an anchor. No pair is lost, whatever the data.

Copies of a fingerprint are one row before anything is replicated, and an anchor with
very many fingerprints is dealt out as pairs of blocks. From an anchor come only the
edges of a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraflow.functions.scale import materialize
from agoraflow.llm.common import LOWER, append_columns, pick, sorted_runs
from agoraflow.operators.graph import connected_components

THRESHOLD = 3
SEED = 42
#: Fingerprints of one anchor that are compared in one piece; larger anchors go in pairs of blocks.
BLOCK = 2048
_CHUNK = 100_000


def _bits(digests: bytes, counts: np.ndarray) -> np.ndarray:
    """Fingerprints from the 8-byte hashes of consecutive documents."""
    out = np.zeros(len(counts), dtype=np.uint64)
    rows = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    ends = np.cumsum(counts)
    held = np.flatnonzero(counts)
    i = 0
    while i < len(held):
        first = ends[held[i]] - counts[held[i]]
        j = max(i + 1, int(np.searchsorted(ends[held], first + _CHUNK, side="right")))
        part = held[i:j]
        ones = np.zeros((len(part), 64), dtype=np.int64)
        if j == i + 1:  # one long document in pieces
            for a in range(first, ends[part[0]], _CHUNK):
                piece = np.unpackbits(rows[a : min(a + _CHUNK, ends[part[0]])], axis=1)
                ones[0] += piece.sum(axis=0, dtype=np.int64)
        else:
            bits = np.unpackbits(rows[first : ends[part[-1]]], axis=1)
            ones = np.add.reduceat(bits, ends[part] - counts[part] - first, axis=0, dtype=np.int32)
        set_ = ones * 2 > counts[part][:, None]
        out[part] = np.packbits(set_, axis=1).view(">u8").ravel()
        i = j
    return out


def fingerprints_of(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    """Signed 64-bit fingerprints; no word gives 0."""
    digest = xxhash.xxh64_digest
    parts, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.translate(LOWER).split() if text else []
        if not words:
            continue
        if len(words) <= shingle:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        joined = b"".join(map(digest, grams, repeat(SEED)))
        counts[i] = len(joined) // 8
        parts.append(joined)
    return _bits(b"".join(parts), counts).view(np.int64)


def add_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of the whole text as a signed long."""

    def make():
        return lambda texts: [fingerprints_of(texts, shingle)]

    return append_columns(docs, text_col, [(out, "long")], make)


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the masks of 31 bits with at most 2 bits and that syndrome, padded with the first."""
    lists = [[0]] + [
        [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)]
        for s in range(1, 32)
    ]
    sizes = np.array([len(x) for x in lists])
    table = np.array([x + x[:1] * (16 - len(x)) for x in lists], dtype=np.int64)
    return table, sizes


_FLIPS, _N_FLIPS = _flips()
_EXTRA = np.int64(1 << 31)


def _syndrome(half: np.ndarray) -> np.ndarray:
    s = np.zeros(len(half), dtype=np.int64)
    for i in range(31):
        s ^= ((half >> i) & 1) * (i + 1)
    return s


def anchors_of(fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for every anchor within 2 bits of each half."""
    index, anchor = [], []
    rows = np.arange(len(fingerprint))
    for side in (0, 1):
        half = (fingerprint >> np.int64(32 * side)) & np.int64(0xFFFFFFFF)
        s = _syndrome(half)
        tag = np.int64(side << 32)
        for k in range(16):
            has = np.flatnonzero(_N_FLIPS[s] > k)
            index.append(has)
            anchor.append((half[has] ^ _FLIPS[s[has], k]) | tag)
        # the free bit flipped, and at most one more
        index.append(rows)
        anchor.append((half ^ _FLIPS[s, 0] ^ _EXTRA) | tag)
    return np.concatenate(index), np.concatenate(anchor)


def replicate(distinct: DataFrame) -> DataFrame:
    """(anchor, fingerprint) for each fingerprint of the column ``fingerprint``."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), 20_000):
                part = fp[a : a + 20_000]
                index, anchor = anchors_of(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(part[index])], names=["anchor", "fingerprint"]
                )

    return distinct.select("fingerprint").mapInArrow(run, "anchor long, fingerprint long")


def _forest(group: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each group; rows are sorted by group."""
    left, right = [], []
    ends = np.concatenate([np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    end_of = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    unsigned = fp.view(np.uint64)
    alive, d = np.arange(len(fp)), 1
    while True:
        alive = alive[alive + d < end_of[alive]]
        if not len(alive):
            break
        near = np.bitwise_count(unsigned[alive] ^ unsigned[alive + d]) <= threshold
        left.append(alive[near])
        right.append(alive[near] + d)
        d += 1
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    child = np.flatnonzero((label != np.arange(len(fp))) & (fp != fp[label]))
    return fp[child], fp[label[child]]


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """source, target: links that connect the same fingerprints as all pairs within ``threshold`` bits.

    ``threshold`` may be 0 to 3; the anchors cover 3.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover up to 3 differing bits")
    near = replicate(distinct)
    sizes = near.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), blocks).cast("int")
    # merged in any case: the planner sizes ``near`` like its input, 33 times too small, and would send it to the driver
    placed = (
        near.hint("merge").join(sizes, "anchor")
        .withColumn("_blocks", blocks)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "anchor",
            F.least("_own", "_other").alias("low"),
            F.greatest("_own", "_other").alias("high"),
            "fingerprint",
        )
    )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for rows in sorted_runs(batches, 3):
            anchor, low, high, fp = (rows.column(i).to_numpy() for i in range(4))
            change = (np.diff(anchor) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
            group = np.concatenate([[0], np.cumsum(change)])
            source, target = _forest(group, fp, threshold)
            if len(source):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(source), pa.array(target)], names=["source", "target"]
                )

    return (
        placed.repartition(parts, "anchor", "low", "high")
        .sortWithinPartitions("anchor", "low", "high")
        .mapInArrow(run, "source long, target long")
        .distinct()
    )


def classes(marked: DataFrame, id_col: str, threshold: int = THRESHOLD) -> DataFrame:
    """fingerprint, component_id: the smallest id reachable over links, for each distinct fingerprint."""
    distinct = materialize(marked.groupBy("fingerprint").agg(F.min(id_col).alias("first")))
    components = connected_components(links(distinct, threshold))
    joined = distinct.join(components.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint")
    )
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    return joined.join(smallest, "component").select("fingerprint", "component_id")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD
) -> DataFrame:
    """doc_id, fingerprint (long), component_id for every row.

    Null and wordless texts have fingerprint 0 and are linked like any other. Repeated
    rows are kept. A null id never becomes a component_id unless no id of its component
    is known. An empty table gives an empty result.
    """
    marked = materialize(
        add_fingerprint(pick(docs, doc_id=id_col, text=text_col), "text", shingle).select("doc_id", "fingerprint")
    )
    return marked.join(classes(marked, "doc_id", threshold), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def keep_one_per_class(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD
) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, then the smallest text hash.

    Rows that agree in both are the same row; one stays. Columns are those of ``docs``.
    Only hashes travel to find the row that stays; its text is moved once.
    """
    columns = docs.columns
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    marked = add_fingerprint(keyed, text_col, shingle, "_fingerprint")
    light = materialize(
        marked.select(F.col(f"`{id_col}`").alias("id"), "_text_hash", F.col("_fingerprint").alias("fingerprint"))
    )
    rows = light.join(classes(light, "id", threshold), "fingerprint")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_text_hash")).alias("k"))
    keep = first.select(F.col("k.id").alias("_id"), F.col("k._text_hash").alias("_hash"))
    return (
        keyed.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
        .dropDuplicates([id_col, "_text_hash"])
        .select(*[F.col(f"`{c}`") for c in columns])
    )
