"""Training-order materialisation: fixed-stride shards in a keyed global order.

1. Texts become token ids, cut into sequences of ``SEQUENCE`` ids (the last one padded), and each
   sequence a record of fixed size: document id, chunk, length, ids. They are written once,
   with the task that made them and their number inside it.
2. The tasks' totals give each sequence an index 0..n-1. A keyed Feistel permutation over the
   smallest even number of bits that holds n, with cycle-walking (values beyond n go through again),
   maps the index to its slot: a bijection of 0..n-1 that needs no sort, no shuffle and no table.
3. Slots go to shards by range. A shard holds ``stride`` slots in order as one binary value, so
   slot s is at byte (s mod stride) * record size of shard s div stride. A reader resumes
   at any slot without reading what lies before.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraflow.functions.scale import broadcast_checked, global_running_sum, materialize
from agoraflow.llm.bpe import read_ranks
from agoraflow.llm.common import pick

SEQUENCE = 512
STRIDE = 2048
ROUNDS = 6
#: Document id, chunk number and count of real ids in front of the ids of a record.
HEADER = "<qii"
HEADER_BYTES = struct.calcsize(HEADER)


class RankEncoder:
    """Ids of a byte-level BPE by its public library, and an end mark behind every text."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = read_ranks(file.read())
        self.end = max(ranks.values()) + 1
        self.pad = self.end
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text with the end mark behind; strings of special tokens are ordinary text."""
        return np.append(self.library.encode_to_numpy(text, disallowed_special=()), np.uint32(self.end))


_ENCODERS: dict[tuple[str, str], RankEncoder] = {}


def encoder(path: str, pattern: str) -> RankEncoder:
    """The encoder of a rank file, once per worker process."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = RankEncoder(path, pattern)
    return _ENCODERS[key]


def make_sequences(
    docs: DataFrame, path: str, pattern: str, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """task, number, record: one row per sequence, the number counting from 0 inside each task.

    A null or empty text is one sequence with the end mark alone; a null id is written as -1.
    Repeated rows are sequences of their own.
    """
    rows = pick(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("long"), F.lit(-1)), "text")

    def run(batches):
        tool, task, number = encoder(path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(ids), 200):
                records = []
                for doc, text in zip(ids[a : a + 200], texts[a : a + 200]):
                    tokens = _narrow(tool.encode(text or ""))
                    for chunk, start in enumerate(range(0, len(tokens), sequence)):
                        part = tokens[start : start + sequence]
                        pad = np.full(sequence - len(part), tool.pad, dtype="<u2")
                        records.append(struct.pack(HEADER, doc, chunk, len(part)) + part.tobytes() + pad.tobytes())
                numbers = np.arange(number, number + len(records))
                number += len(records)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(records), task, dtype=np.int32)), pa.array(numbers), pa.array(records, pa.binary())],
                    names=["task", "number", "record"],
                )

    return rows.mapInArrow(run, "task int, number long, record binary")


def _narrow(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned 16-bit numbers; a vocabulary beyond that is refused."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("records hold ids of 16 bits")
    return ids.astype("<u2")


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of ``index`` under the keyed permutation of 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [int(k) for k in _mix(np.arange(rounds, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), key & (2**64 - 1))]
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= n]  # cycle-walking: outside values go through again
    return out.astype(np.int64)


def assign_slots(sequences: DataFrame, key: int) -> DataFrame:
    """slot, record for each row of ``make_sequences``, which is written once so that its numbers hold."""
    held = materialize(sequences)
    totals = held.groupBy("task").agg(F.count("*").alias("rows"))
    offsets = materialize(
        global_running_sum(totals, [F.col("task")], "rows", "end").select("task", (F.col("end") - F.col("rows")).alias("before"))
    )
    n = offsets.join(totals, "task").agg(F.max(F.col("before") + F.col("rows"))).first()[0] or 0
    # one row per task of the first pass
    indexed = held.join(broadcast_checked(offsets, max_rows=4_000_000), "task").select((F.col("before") + F.col("number")).alias("index"), "record")

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    return indexed.select(slot("index").alias("slot"), "record")


def to_shards(slotted: DataFrame, stride: int = STRIDE) -> DataFrame:
    """shard, first_slot, n_slots, record_bytes, data: one row per range of ``stride`` slots, in order.

    Every range but the last is full, so shards are even whatever the documents are.
    """
    ranged = slotted.withColumn("shard", F.floor(F.col("slot") / stride).cast("long"))
    parts = int(slotted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        shard, held, first = None, [], None

        def close():
            data = b"".join(held)
            columns = [[shard], [first], [len(held)], [len(held[0])], [data]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["shard", "first_slot", "n_slots", "record_bytes", "data"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for s, slot, record in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != shard:
                    if held:
                        yield close()
                    shard, held, first = s, [], slot
                held.append(record)
        if held:
            yield close()

    return (
        ranged.select("shard", "slot", "record")
        .repartition(parts, "shard")
        .sortWithinPartitions("shard", "slot")
        .mapInArrow(run, "shard long, first_slot long, n_slots long, record_bytes long, data binary")
    )


def training_order(
    docs: DataFrame,
    path: str,
    pattern: str,
    key: int = 20240229,
    sequence: int = SEQUENCE,
    stride: int = STRIDE,
    **columns: str,
) -> DataFrame:
    """The shards of all documents. The same files, splits and key give the same order."""
    return to_shards(assign_slots(make_sequences(docs, path, pattern, sequence, **columns), key), stride)


def write_training_order(docs: DataFrame, out: str, path: str, pattern: str, **options) -> None:
    """Write the shards as Parquet; ``read_slots`` reads ranges of them."""
    training_order(docs, path, pattern, **options).write.mode("overwrite").parquet(out)


def records(shards: DataFrame) -> DataFrame:
    """slot, shard, byte_offset, doc_id, chunk, n_tokens, tokens: the records of shards, cut at the stride."""

    def run(batches):
        for batch in batches:
            for shard, first, n, size, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                kind = np.dtype([("doc", "<i8"), ("chunk", "<i4"), ("n", "<i4"), ("ids", "<u2", ((size - HEADER_BYTES) // 2,))])
                rows = np.frombuffer(data, dtype=kind)
                for a in range(0, n, 512):
                    part = rows[a : a + 512]
                    place = np.arange(a, a + len(part))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(first + place),
                            pa.array(np.full(len(part), shard)),
                            pa.array(place * size),
                            pa.array(part["doc"].astype(np.int64)),
                            pa.array(part["chunk"].astype(np.int32)),
                            pa.array(part["n"].astype(np.int32)),
                            pa.array([r["ids"][: r["n"]].astype("<u2").tobytes() for r in part], pa.binary()),
                        ],
                        names=["slot", "shard", "byte_offset", "doc_id", "chunk", "n_tokens", "tokens"],
                    )

    schema = "slot long, shard long, byte_offset long, doc_id long, chunk int, n_tokens int, tokens binary"
    return shards.select("shard", "first_slot", "n_slots", "record_bytes", "data").mapInArrow(run, schema)


def read_slots(shards: DataFrame, start: int, n: int, stride: int = STRIDE) -> DataFrame:
    """The records of slots start..start+n-1 in order; only the shards that hold them are read."""
    end = start + n
    wanted = shards.filter((F.col("shard") >= start // stride) & (F.col("shard") <= max(end - 1, start) // stride))
    return records(wanted).filter((F.col("slot") >= start) & (F.col("slot") < end)).orderBy("slot")
