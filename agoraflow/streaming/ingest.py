"""The ingestion filters on Structured Streaming.

The file source with a checkpoint replaces a hand-kept state table: a file is
loaded once, and a restarted run continues where the last one stopped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from agoraflow.functions.scale import materialize, row_bytes
from agoraflow.operators.combine import whitelist_join
from agoraflow.operators.filters import keyword_filter
from agoraflow.schemas import BY_KIND
from agoraflow.sources.archives import PREFIX, decode_large_windows

#: Bytes of a bucket of a deduplicated store, about; a batch has a power of two of them.
BUCKET_BYTES = 64 << 20
#: Bits of a block of an id filter (what one bitmap aggregate holds), bits per id, and bits set for an id.
BLOCK_BITS, BITS_PER_ID, PROBES = 32_768, 12, 5


def archive_glob(kind: str, years: Sequence[int] | None = None) -> str:
    """Name pattern of the archives of a kind, in either case, of some years or all."""
    either = lambda text: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)
    year = "{" + ",".join(str(y) for y in years) + "}" if years else "[0-9][0-9][0-9][0-9]"
    return f"{either(PREFIX[kind])}_{year}-[0-9][0-9].{either('zst')}"


def stream_ingest(
    spark: SparkSession,
    roots: str | Sequence[str],
    kind: str,
    years: Sequence[int] | None = None,
    names: str | None = None,
    max_files: int | None = None,
    large_windows: bool = False,
) -> DataFrame:
    """New archives of ``kind`` below ``roots`` as a stream with the explicit schema.

    Only archives of the kind and years are taken, by name (``names`` is another pattern);
    posts and comments may share a folder. ``large_windows`` decodes frames that the built-in reader
    cannot hold. All roots have to exist when the stream starts.
    """
    listed = [roots] if isinstance(roots, str) else list(roots)

    def one(root: str) -> DataFrame:
        reader = spark.readStream.option("recursiveFileLookup", True)
        reader = reader.option("pathGlobFilter", names or archive_glob(kind, years))
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        if not large_windows:
            return reader.schema(BY_KIND[kind]).json(root)
        files = "path string, modificationTime timestamp, length long, content binary"
        return decode_large_windows(reader.format("binaryFile").schema(files).load(root).select("path"), kind)

    return reduce(DataFrame.unionByName, map(one, listed))


def stream_table(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def stream_whitelist(stream: DataFrame, whitelist: DataFrame, col: str = "subreddit") -> DataFrame:
    """Stream-static semi join with the whitelist."""
    return whitelist_join(stream, whitelist, col)


def stream_keyword_filter(stream: DataFrame, terms: Sequence[str], kind: str, **options) -> DataFrame:
    """The batch filter; it keeps no state."""
    return keyword_filter(stream, terms, kind, **options)


def _id_hash(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def _probes(id_col: str) -> Column:
    return F.array(*[F.pmod(_id_hash(id_col, 2 + i), F.lit(BLOCK_BITS)).cast("int") for i in range(PROBES)])


def _write_filter(rows: DataFrame, path: str, id_col: str) -> None:
    """Write the id filters of a batch: per bucket some blocks of bits, in which every id has set its own.

    Columns: _bucket, _of (buckets of the batch), blocks (of the bucket), block, bits.
    """
    sizes = rows.groupBy("_bucket").agg(F.ceil(F.count("*") * BITS_PER_ID / BLOCK_BITS).alias("blocks"))
    placed = rows.join(F.broadcast(sizes), "_bucket")  # one row per bucket
    block = F.pmod(_id_hash(id_col, 1), F.col("blocks")).alias("block")
    bit = placed.select("_bucket", "_of", "blocks", block, F.explode(_probes(id_col)).alias("bit"))
    bits = bit.groupBy("_bucket", "_of", "blocks", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits.write.mode("overwrite").parquet(path)


def _bit_is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, place % 8).bitwiseAND(1) == 1


def files_to_open(ids: DataFrame, path: str, before: int, id_col: str = "id") -> list[str]:
    """Folders of the store that may hold one of ``ids``, by the filters of the batches before number ``before``.

    Each block of a filter meets the ids that would be in it as one row. A folder that holds an id is always named; one that
    holds none is named by chance, rarely while few ids meet it.
    """
    spark = ids.sparkSession
    filters = _read_batches(spark, f"{path}/_filters", before)
    if filters is None:
        return []
    shapes = F.broadcast(filters.select("_batch", "_bucket", "_of", "blocks").distinct())  # one row per folder
    # ids find their folder of every batch by the low bits of their hash
    counts = [r["_of"] for r in filters.select("_of").distinct().collect()]  # powers of two: a few numbers
    if not counts:
        return []
    bucket = F.explode(F.array(*[F.struct(F.lit(n).alias("_of"), _id_hash(id_col, 0).bitwiseAND(n - 1).cast("int").alias("_bucket")) for n in counts]))
    asked = ids.select(id_col, bucket.alias("_b")).select(id_col, "_b.*").join(shapes, ["_of", "_bucket"])
    block = F.pmod(_id_hash(id_col, 1), F.col("blocks")).alias("block")
    keys = ["_batch", "_bucket", "block"]
    asked = asked.select("_batch", "_bucket", block, _probes(id_col).alias("probes")).groupBy(*keys).agg(F.collect_set("probes").alias("ids"))
    met = asked.join(filters.select(*keys, "bits"), keys).filter(
        F.exists("ids", lambda probes: F.forall(probes, lambda place: _bit_is_set(F.col("bits"), place)))
    )
    names = met.select("_batch", "_bucket").distinct().collect()  # names of folders, not rows
    return sorted(f"{path}/_batch={r['_batch']}/_bucket={r['_bucket']}" for r in names)


def stream_dedup(
    stream: DataFrame, path: str, checkpoint: str, id_col: str = "id", time_col: str = "created_utc", bucket_bytes: int = BUCKET_BYTES
) -> StreamingQuery:
    """Load everything that is new into a store that holds each id once, then stop.

    However late or far apart repeats arrive, the row stored first stays; inside a batch it is the one
    with the smallest time, then the smallest row. A batch is stored in buckets of about ``bucket_bytes`` by the hash of
    the id, with a filter of the ids of each. A later batch opens only the buckets whose filters may hold its ids.
    It overwrites its own folders, so a repeated batch changes nothing. Read the store with ``read_deduplicated``.
    """
    rest = [c for c in stream.columns if c not in (id_col, time_col)]

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(id_col).agg(F.min(F.struct(time_col, *rest)).alias("_row"))
        rows = materialize(first.select(id_col, "_row.*").select(*stream.columns))
        held = files_to_open(rows, path, number, id_col)
        if held:
            known = spark.read.option("basePath", path).schema(rows.select(id_col).schema).parquet(*held)
            known = known.select(F.col(id_col).alias("_id"))
            rows = rows.join(known, F.col(id_col).eqNullSafe(F.col("_id")), "left_anti")
        size = rows.agg(F.sum(row_bytes(rows))).first()[0] or 0
        of = 1 << max(0, math.ceil(math.log2(max(1, size / bucket_bytes))))
        bucket = _id_hash(id_col, 0).bitwiseAND(of - 1).cast("int")
        placed = rows.withColumn("_bucket", bucket)
        own = f"{path}/_batch={number}"
        placed.repartition(of, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(own)
        stored = spark.read.schema(placed.schema).parquet(own)
        _write_filter(stored.withColumn("_of", F.lit(of)), f"{path}/_filters/_batch={number}", id_col)

    query = (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _read_batches(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """What batches before number ``before`` have written below ``path``; None when there is nothing."""
    from pyspark.errors import AnalysisException

    try:
        held = spark.read.option("basePath", path).parquet(f"{path}/_batch=*")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return held.filter(F.col("_batch") < before)


def read_deduplicated(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a store that ``stream_dedup`` has written."""
    held = _read_batches(spark, path, 2**62)
    return spark.createDataFrame([], schema) if held is None else held.select(*schema.names)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Load everything that is new into a Parquet folder, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
