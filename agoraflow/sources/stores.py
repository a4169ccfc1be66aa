"""Stage tables on shared storage: write, replace one scope, deduplicate, keep state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoraflow.functions.text import safe_name
from agoraflow.operators.sampling import top_per_group

SCOPE = ("scope_type", "scope_value")


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace exactly the partitions that ``df`` holds; a repeated run changes nothing."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def append_rows(df: DataFrame, path: str, source_col: str = "source_file") -> None:
    """Append the rows of new source files; loading a file again replaces its rows."""
    write_partitions(df, path, [source_col])


def write_scope(df: DataFrame, path: str) -> None:
    """Store topic rows per scope, replacing the scopes that ``df`` holds."""
    named = df.withColumn("scope_dir", safe_name(F.col("scope_value")))
    write_partitions(named, path, ["scope_type", "scope_dir"])


def read_scope(spark: SparkSession, path: str, scope_type: str, scope_value: str) -> DataFrame:
    """The stored rows of one scope; only its partition is read."""
    return (
        spark.read.parquet(path)
        .filter(F.col("scope_type") == scope_type)
        .filter(F.col("scope_dir") == safe_name(F.lit(scope_value)))
        .filter(F.col("scope_value") == scope_value)
        .drop("scope_dir")
    )


def replace_scope(old: DataFrame, new: DataFrame, scope: Sequence[str] = SCOPE) -> DataFrame:
    """``old`` without the scopes of ``new``, plus ``new``."""
    replaced = new.select(*scope).distinct()
    return old.join(replaced, list(scope), "left_anti").unionByName(new, allowMissingColumns=True)


def union_centroids(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of the centroid tables that exist; a missing scope is taken from ``cluster_id``."""
    if not frames:
        raise ValueError("no centroid table found")
    scoped = []
    for df in frames:
        if "scope_type" not in df.columns:
            df = df.withColumn("scope_type", F.lit("cluster")).withColumn(
                "scope_value", F.col("cluster_id").cast("string")
            )
        scoped.append(df)
    out = scoped[0]
    for df in scoped[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def load_centroids(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``union_centroids`` over the paths that exist."""
    from pyspark.errors import AnalysisException

    frames = []
    for path in paths:
        try:
            frames.append(spark.read.parquet(path))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return union_centroids(frames)


def dedup_by_id(df: DataFrame, keys: Sequence[str] = ("id",), order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key, by default the one retrieved last.

    A key repeated in a third of all rows leaves each map task as one row.
    """
    if order is None:
        order = [F.col("retrieved_on").desc_nulls_last()] + [
            F.col(c) for c in df.columns if c not in (*keys, "retrieved_on")
        ]
    return top_per_group(df, 1, list(keys), list(order))


def duplicate_keys(df: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Keys that occur more than once; empty when the key is unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def latest_state(states: DataFrame) -> DataFrame:
    """Current ingestion state per file out of all recorded changes."""
    return top_per_group(
        states, 1, ["filepath"], [F.desc("updated_at"), F.col("status")]
    )


def upsert_state(current: DataFrame, changes: DataFrame) -> DataFrame:
    return latest_state(current.unionByName(changes))


def state_change(spark: SparkSession, filepaths: Sequence[str], status: str) -> DataFrame:
    """State rows of ``filepaths`` stamped with the current time."""
    rows = [(p,) for p in filepaths]
    return spark.createDataFrame(rows, "filepath string").select(
        "filepath",
        F.lit(0).cast("long").alias("last_line"),
        F.lit(status).alias("status"),
        F.current_timestamp().alias("updated_at"),
    )


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined to text first."""
    flat = [
        F.concat_ws(", ", f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
