"""Compressed newline-JSON archives of posts and comments."""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoraflow.functions.scale import storage_of
from agoraflow.schemas import BY_KIND

# fixed values: archive name prefix per content kind
PREFIX = {"comments": "RC", "posts": "RS"}

# fixed value: largest frame window of the public archives (2 ** 31 bytes)
MAX_WINDOW = 2**31

_LINES_PER_BATCH = 20_000


def archive_pattern(kind: str) -> str:
    return rf"(?i){PREFIX[kind]}_(\d{{4}})-(\d{{2}})\.zst$"


def is_archive(path: Column, kind: str, years: Sequence[int]) -> Column:
    """True for archive paths of ``kind`` whose year is wanted."""
    year = F.regexp_extract(path, archive_pattern(kind), 1)
    return year.isin(*[str(y) for y in years])


def discover_archives(spark: SparkSession, roots: Sequence[str], kind: str, years: Sequence[int]) -> list[str]:
    """Sorted paths of the archives below ``roots``; roots that do not exist are skipped.

    Only the path column is read, so no file content is touched.
    """
    from pyspark.errors import AnalysisException

    found: list[str] = []
    for root in roots:
        try:
            files = (
                spark.read.format("binaryFile")
                .option("recursiveFileLookup", True)
                .option("pathGlobFilter", "*.zst")
                .load(root)
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found += [r["path"] for r in files.filter(is_archive(F.col("path"), kind, years)).select("path").collect()]
    return sorted(found)


def project(df: DataFrame, kind: str, strict: bool = True) -> DataFrame:
    """Cast every column to the schema of ``kind``; ``strict=False`` turns bad values into null."""
    fields = BY_KIND[kind].fields
    if strict:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def read_archives(spark: SparkSession, paths: Sequence[str], kind: str, partitions: int | None = None) -> DataFrame:
    """Scan archives with the explicit schema, the file name as ``source_file``.

    One compressed file is one task, so the rows are spread right after the read, over
    ``partitions`` or as many as the session shuffles to.
    """
    df = spark.read.schema(BY_KIND[kind]).json(list(paths))
    df = df.select("*", F.col("_metadata.file_name").alias("source_file"))
    return _spread(df, partitions)


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _open_stream(path: str):
    """A byte stream of a file on mounted or remote storage."""
    storage, inner = storage_of(path)
    return storage.open_input_stream(inner, compression=None)


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    for batch in batches:
        for path in batch["path"]:
            with _open_stream(path) as raw:
                unpacked = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).stream_reader(raw)
                lines = io.TextIOWrapper(unpacked, encoding="utf-8", errors="replace", newline="\n")
                while some := list(itertools.islice(lines, _LINES_PER_BATCH)):
                    yield pd.DataFrame({"path": path, "line": some})


def read_large_window_archives(spark: SparkSession, paths: Sequence[str], kind: str, partitions: int | None = None) -> DataFrame:
    """``read_archives`` for frames whose window is too large for the built-in reader.

    One task streams one file in batches of lines, which are spread like those of ``read_archives``;
    JSON is parsed in the JVM. Bytes that are not UTF-8 become replacement characters.
    """
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    lines = _spread(listed.mapInPandas(_decode, "path string, line string"), partitions)
    return lines.select(
        F.from_json("line", BY_KIND[kind]).alias("row"),
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
    ).select("row.*", "source_file")


def decode_large_windows(paths: DataFrame, kind: str) -> DataFrame:
    """The rows of the archives a table or stream of paths (column ``path``) names."""
    lines = paths.mapInPandas(_decode, "path string, line string")
    return lines.select(F.from_json("line", BY_KIND[kind]).alias("row")).select("row.*")


def to_json_lines(df: DataFrame, schema: StructType) -> DataFrame:
    """Rows as JSON text, the form the archives hold."""
    return df.select(F.to_json(F.struct(*[F.col(f.name) for f in schema.fields])).alias("value"))

