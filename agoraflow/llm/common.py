"""Shared helpers of the training-data operators.

Text functions here work on UTF-8 bytes: separators are ASCII, so splitting bytes
gives the same words as splitting characters, without decoding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that are worked on at once: bounds what a worker holds beside the batch.
SLICE_ROWS = 2000
#: A-Z to a-z, every other byte unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; nulls stay None."""
    return column.cast(pa.binary()).to_pylist()


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that extra columns can't clash."""
    return docs.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(fn, schema)


def append_columns(
    df: DataFrame, source: str, fields: Sequence[tuple[str, str]], make: Callable[[], Callable]
) -> DataFrame:
    """``df`` with columns computed from the text column ``source``.

    ``make()`` runs once per task and returns a function from a list of UTF-8
    texts to one sequence per field. A column of ``df`` that bears the
    name of a new one is replaced.
    """
    names = [name for name, _ in fields]
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names or c == source])
    position = base.columns.index(source)
    kept = [i for i, c in enumerate(base.columns) if c not in names]
    added = T._parse_datatype_string(", ".join(f"`{name}` {kind}" for name, kind in fields))
    schema = T.StructType([base.schema[i] for i in kept] + list(added))
    kinds = [_arrow_type(f.dataType) for f in added]

    def run(batches):
        compute = make()
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(a, SLICE_ROWS)
                results = compute(utf8(batch.column(position)))
                arrays = [batch.column(i) for i in kept] + [pa.array(v, k) for v, k in zip(results, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return base.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        "long": pa.int64(),
        "integer": pa.int32(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "string": pa.string(),
        "binary": pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return simple[kind.typeName()]


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 200_000) -> Iterator[pa.Table]:
    """Whole runs of equal keys (the first ``keys`` columns) from sorted batches.

    The rows of a task arrive sorted by key. Tables of about ``rows`` rows are cut
    where the key changes, so no run is split; memory is bounded by ``rows`` plus
    the longest run.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def key(batch, i):
        return tuple(batch.column(k)[i].as_py() for k in range(keys))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and size >= rows:
            last = key(held[-1], held[-1].num_rows - 1)
            low, high = 0, batch.num_rows  # rows of the last run are a prefix of this batch
            while low < high:
                mid = (low + high) // 2
                if key(batch, mid) == last:
                    low = mid + 1
                else:
                    high = mid
            if low:
                held.append(batch.slice(0, low))
                batch = batch.slice(low)
            if batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
