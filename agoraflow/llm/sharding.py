"""Two-pass external shuffle into shards.

Pass one scatters the rows uniformly into buckets by a seeded hash; a bucket is sized to
fit in a task's memory. Pass two runs Fisher-Yates over each bucket and writes it out.
The order of the buckets, and of the rows inside, is the order of the shuffled whole, so a
shard is a run of consecutive places of it: counts differ by one at most.

The hash is over the id and the text, so the result does not depend on how the input is
split into files. Rows that agree in both are interchangeable; where so many of them
share a bucket that it outgrows its size, that bucket is scattered further by row place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoraflow.functions.scale import global_running_sum, materialize

#: Bytes of text in a bucket, about.
BUCKET_BYTES = 8 << 20
#: A bucket is scattered further beyond this many times its size.
OVERFULL = 4


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of n places; numpy's generator shuffles by Fisher-Yates."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, bucket])).shuffle(order)
    return order


def _size(text_col: str):
    return (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("long")


def scatter(docs: DataFrame, id_col: str, text_col: str, seed: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(docs with ``_bucket``, one row per bucket: ``_bucket``, ``_rows``, ``_offset``).

    The number of buckets grows with the bytes of the input, and is never below the number
    of shuffle partitions, so that all cores have work.
    """
    spark = docs.sparkSession
    sized = docs.withColumn("_size", _size(text_col))
    total = sized.agg(F.sum("_size")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes), 1)
    content = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    bucket = F.pmod(F.xxhash64(F.lit(seed), *content), F.lit(n))
    placed = sized.withColumn("_first", bucket)

    # buckets that repeated rows have filled beyond their size
    limit = OVERFULL * max(bucket_bytes, -(-total // n))
    over = (
        placed.groupBy("_first")
        .agg(F.sum("_size").alias("bytes"))
        .filter(F.col("bytes") > limit)
        .select("_first", F.ceil(F.col("bytes") / bucket_bytes).cast("long").alias("_ways"))
    )
    over = materialize(over)
    if over.limit(1).count():  # at most total / limit rows
        numbered = placed.withColumn("_place", F.monotonically_increasing_id())
        way = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_place")), F.col("_ways"))
        placed = (
            numbered.join(over, "_first", "left")
            .withColumn("_bucket", F.col("_first") + F.lit(n) * F.coalesce(way, F.lit(0)))
            .drop("_place", "_ways", "_first")
        )
        placed = materialize(placed)  # the row places hold for one reading only
    else:
        placed = placed.withColumnRenamed("_first", "_bucket")
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    offsets = global_running_sum(counts, [F.col("_bucket")], "_rows", "_end").select(
        "_bucket", "_rows", (F.col("_end") - F.col("_rows")).alias("_offset")
    )
    return placed.drop("_size"), materialize(offsets)


def shuffle_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES
) -> tuple[DataFrame, int]:
    """``docs`` with ``position``, a random place 0..n-1 that no other row has, and n.

    Null ids and texts, repeated rows and further columns are kept as they are (a column
    named position is replaced); an empty table gives none. Inside a task the rows of a
    bucket come out in the order of their places.
    """
    base = docs.drop("position")
    placed, offsets = scatter(base, id_col, text_col, seed, bucket_bytes)
    n = offsets.agg(F.sum("_rows")).first()[0] or 0
    columns = base.columns
    by_content = [c for c in (id_col, text_col) if c in columns]
    schema = StructType(list(base.schema)).add("position", "long")

    def shuffled(rows: pa.Table, offset: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return pa.table([pa.array([], f.type) for f in rows.select(columns).schema] + [pa.array([], pa.int64())],
                            names=schema.names)
        bucket = rows.column("_bucket")[0].as_py()
        start = offset.column("_offset")[0].as_py()
        # rows arrive in any order: put them in one of their own before they are shuffled
        ordered = rows.sort_by([(c, "ascending") for c in by_content]).select(columns)
        order = fisher_yates(ordered.num_rows, seed, bucket)
        return ordered.take(pa.array(order)).append_column(
            "position", pa.array(np.arange(start, start + len(order), dtype=np.int64))
        )

    grouped = placed.groupBy("_bucket").cogroup(offsets.groupBy("_bucket"))
    return grouped.applyInArrow(shuffled, schema), n


def assign_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` with ``shard`` (0..shards-1) and ``slot`` (0.. without gaps inside a shard).

    Law: the numbers of rows of any two shards differ by one at most.
    """
    shuffled, n = shuffle_rows(docs.drop("shard", "slot"), id_col, text_col, seed, bucket_bytes)
    # the first n % shards shards have one row more
    low, more = divmod(n, shards)
    border = more * (low + 1)
    p = F.col("position")
    shard = F.when(p < border, F.floor(p / (low + 1))).otherwise(more + F.floor((p - border) / max(low, 1)))
    first = F.when(F.col("shard") < more, F.col("shard").cast("long") * (low + 1)).otherwise(
        border + (F.col("shard").cast("long") - more) * low
    )
    return shuffled.withColumn("shard", shard.cast("int")).withColumn("slot", p - first).drop("position")


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write the shuffled rows under ``path/shard=K``; inside a file rows follow their slots.

    A bucket lies in one shard, or in two where it holds a border, so a task writes few files.
    """
    assign_shards(docs, shards, **options).write.mode("overwrite").partitionBy("shard").parquet(path)

