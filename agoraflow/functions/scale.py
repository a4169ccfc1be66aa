"""Helpers that keep a plan bounded: lineage cuts, checked broadcasts, global order.

None of these change a result; they only decide where data is written, whether a
side may be broadcast, and how a total order is computed without one big task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    It is the cluster's ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="agoraflow-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate of this application under the checkpoint folder."""
    folder = checkpoint_dir(spark).rstrip("/")
    return f"{folder}/agoraflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def storage_of(path: str):
    """(pyarrow file system, path in it) for tasks that read or write files themselves: mounted folders, hdfs, s3, gs."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), path if not colon else "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    Cuts the lineage, survives the loss of any executor, and gives the planner
    real sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Overwrites written intermediates with empty tables, so that their files go before the job ends.

    Only for tables of ``materialize`` that nothing reads any more, later actions included.
    """
    for df in tables:
        files = df.inputFiles()
        if files:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash the rows over all cores when the scan gives fewer partitions than cores.

    For heavy work per row on a table that lies in a few unsplittable files. A
    scan with enough partitions, the normal case, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def deal(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` + ``_deal``: the rows dealt evenly by a hash of all plain columns of ``df``, over all shuffle partitions.

    For heavy work per row behind a join: what the join finds may lie in a few of its partitions, and partitions are
    merged by their bytes, which do not tell the work. Rows with one ``_deal`` are in one task, so counts that have it
    as a key are combined there without a shuffle.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    plain = [f"`{f.name}`" for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    # several numbers a partition, so that partitions come out even
    place = F.pmod(F.xxhash64(*plain), F.lit(16 * parts)).cast("int")
    return df.select(*columns, place.alias("_deal")).repartition(parts, "_deal")


def row_bytes(df: DataFrame) -> Column:
    """Approximate bytes of a row: text by length, numbers 8, arrays by element."""
    total = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "string":
            width = F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        elif kind == "array":
            width = F.greatest(F.size(f.name), F.lit(0)) * 8 + 16
        else:
            width = F.lit(8)
        total = total + width
    return total


def broadcast_checked(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only after measuring that ``df`` is within both limits.

    For lists of names and terms and for small lookup tables. A larger side stays
    unhinted and is joined by shuffle (or whatever adaptive execution picks from
    the measured sizes).
    """
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(row_bytes(df))).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        return F.broadcast(df)
    return df


def _range_partitioned(df: DataFrame, order: Sequence[Column], value: Column, partitions: int | None):
    """Freeze a range partitioning of ``df`` and the total of ``value`` before each partition."""
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    )
    # one row per partition, so this window and this broadcast hold at most `parts` rows
    before = (
        ranged.groupBy("_part")
        .agg(F.sum(value).alias("_total"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_total").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    return ranged.join(F.broadcast(before), "_part")


def global_row_number(
    df: DataFrame, order: Sequence[Column], out: str, partitions: int | None = None
) -> DataFrame:
    """Number the rows 1..n in ``order`` without sorting them in one task.

    The order must be total (end with a unique key): range partitions are then
    even, each is numbered on its own and shifted by the rows before it.
    """
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        _range_partitioned(df, order, F.lit(1), partitions)
        .withColumn(out, (F.col("_before") + local).cast("long"))
        .drop("_part", "_before")
    )


def global_running_sum(
    df: DataFrame, order: Sequence[Column], value: str, out: str, partitions: int | None = None
) -> DataFrame:
    """Running total of ``value`` in a total ``order``, range partition by range partition."""
    frame = (
        Window.partitionBy("_part")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _range_partitioned(df, order, F.col(value), partitions)
        .withColumn(out, F.col("_before") + F.sum(value).over(frame))
        .drop("_part", "_before")
    )
