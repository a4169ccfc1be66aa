"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, so a dimension has few occurring values. Each round tabulates, for
every dimension, occurring value and centroid, the squared difference; the distances of a batch
are gathers from these tables, added up over the dimensions. All arithmetic is exact.

A round is one pass over the written integer vectors: a task returns one row of sums per
cluster and dimension, Spark adds them, and only the totals (clusters x dimensions) reach the
driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agoraflow.functions.scale import materialize
from agoraflow.llm.common import SLICE_ROWS

#: Components are at most this large, so that squared distances of up to 512 dimensions fit in a long.
LARGEST = 1 << 26


def integer_vectors(vectors: DataFrame, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``row`` (all columns) and ``ints`` of the vectors with ``dims`` components, none null or non-finite."""
    v = F.col(f"`{vector_col}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    small = lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(-LARGEST - 1)), F.lit(LARGEST + 1))
    row = F.struct(*[F.col(f"`{c}`") for c in vectors.columns])
    return vectors.filter((F.size(v) == dims) & ~odd).select(
        row.alias("row"), F.transform(v, lambda x: small(x).cast("int")).alias("ints")
    )


def first_centroids(kept: DataFrame, key: Column, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest ``key`` (null last, ties by components), in that order."""
    rows = kept.select(key.alias("key"), "ints").orderBy(F.col("key").asc_nulls_last(), "ints").limit(k).collect()
    return np.array([r.ints for r in rows], dtype=np.int64)


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values that occur, in order; the place of each element among them)."""
    low, high = int(column.min()), int(column.max())
    if high - low > 8 * len(column) + 1024:
        return np.unique(column, return_inverse=True)
    present = np.zeros(high - low + 1, dtype=bool)
    present[column - low] = True
    return np.flatnonzero(present) + low, (np.cumsum(present) - 1)[column - low]


def nearest(ints: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centroid of every row, ties to the smaller number; its squared distance)."""
    if len(ints) and np.abs(ints).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling: squared distances would not fit in a long")
    distances = np.zeros((len(ints), len(centroids)), dtype=np.int64)
    for d in range(ints.shape[1]):
        values, codes = occurring(ints[:, d])
        table = (values[:, None] - centroids[None, :, d]) ** 2
        distances += table[codes]
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(ints)), best]


def _slices(batches: Iterator[pa.RecordBatch], dims: int):
    """(slice of a batch, its vectors as a matrix); the vectors are the last column."""
    for whole in batches:
        for a in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(a, SLICE_ROWS)
            ints = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            yield batch, ints.reshape(-1, dims).astype(np.int64)


def _total(values: np.ndarray) -> int:
    """The exact sum of non-negative longs: halves are added apart."""
    return (int((values >> 32).sum()) << 32) + int((values & 0xFFFFFFFF).sum())


def cluster_sums(kept: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Totals by (cluster, dimension); dimension -1 has the number of vectors, -2 their distances."""
    k, dims = centroids.shape

    def sums(batches):
        total = np.zeros((k, dims), dtype=np.int64)  # a task has fewer than 2^36 vectors
        counts, inertia = [0] * k, [0] * k
        for _, ints in _slices(batches, dims):
            best, distance = nearest(ints, centroids)
            for c in range(k):
                mine = best == c
                total[c] += ints[mine].sum(axis=0)
                counts[c] += int(mine.sum())
                inertia[c] += _total(distance[mine])
        used = [c for c in range(k) if counts[c]]
        rows = [(c, d, int(total[c, d])) for c in used for d in range(dims)]
        rows += [(c, -1, counts[c]) for c in used] + [(c, -2, inertia[c]) for c in used]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([Decimal(r[2]) for r in rows], pa.decimal128(38, 0)),
            ],
            names=["cluster", "dim", "total"],
        )

    parts = kept.select("ints").mapInArrow(sums, "cluster int, dim int, total decimal(38,0)")
    rows = parts.groupBy("cluster", "dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    return {(r.cluster, r.dim): int(r.total) for r in rows}


def moved(centroids: np.ndarray, totals: dict[tuple[int, int], int]) -> np.ndarray:
    """Every centroid with vectors becomes their floored mean; the others stay."""
    new = centroids.copy()
    for c in range(len(centroids)):
        n = totals.get((c, -1), 0)
        if n:
            new[c] = [totals[c, d] // n for d in range(centroids.shape[1])]
    return new


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: str = "3",
    keep: Sequence[str] | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(the kept vectors with their cluster, the final centroids).

    Columns: those of ``vectors`` (or ``keep``), then cluster, distance, cluster_inertia, inertia and
    centroid_sha256; an input column of such a name is replaced. Vectors of another length, or with a null
    or non-finite component, are left out. The first centroids are the vectors with the smallest
    sha256 of ``seed:id`` (a null id comes last, equal ids by their components); with fewer than ``k`` vectors
    there is one centroid for each, with none the result is empty. Equal vectors are counted as often as
    they occur and share a cluster. A component beyond 2^26 after scaling is an error.
    """
    kept_columns = [c for c in vectors.columns if keep is None or c in keep]
    new = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in kept_columns])
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("row").getField(id_col).cast("string")), 256)
    whole = integer_vectors(vectors, vector_col, dims, scale)
    kept = materialize(whole.select(row.alias("row"), key.alias("key"), "ints"))
    centroids = first_centroids(kept, F.col("key"), k)
    kept = kept.select("row", "ints")
    schema = StructType([kept.schema["row"]]).add("cluster", "integer").add("distance", "long")
    if len(centroids) == 0:
        centroids = np.zeros((0, dims), dtype=np.int64)
        found = kept.limit(0).select("row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        inertia = [0]
        digests = [""]
    else:
        for _ in range(rounds):
            centroids = moved(centroids, cluster_sums(kept, centroids))
        totals = cluster_sums(kept, centroids)
        inertia = [totals.get((c, -2), 0) for c in range(len(centroids))]
        digests = [digest(c) for c in centroids]
        final = centroids

        def assign(batches):
            for batch, ints in _slices(batches, dims):
                best, distance = nearest(ints, final)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["row", "cluster", "distance"]
                )

        found = kept.mapInArrow(assign, schema)
    place = F.col("cluster") + 1
    long = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    result = (
        found.withColumn("cluster_inertia", F.element_at(long(inertia), place))
        .withColumn("inertia", F.lit(sum(inertia)).cast("long"))
        .withColumn("centroid_sha256", F.element_at(F.array(*[F.lit(d) for d in digests]), place))
        .select(*[F.col("row").getField(c).alias(c) for c in kept_columns if c not in new], *new)
    )
    return result, centroids


def _oracle(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> str:
    """The rounds as a chain of tables in SQL."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (
  SELECT rid, d, floor({scale} * embedding[d]::DOUBLE)::BIGINT AS x FROM kept, range(1, {dims + 1}) t(d)),
seeds AS MATERIALIZED (
  SELECT rid, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS cluster FROM kept
  QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, d, x AS c FROM seeds JOIN v USING (rid))"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT rid, cluster, distance FROM (
    SELECT rid, cluster, sum((x - c) * (x - c)) AS distance FROM v JOIN c{r} USING (d) GROUP BY rid, cluster)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS MATERIALIZED (SELECT cluster, d, sum(x) AS s, count(*) AS n FROM a{r} JOIN v USING (rid) GROUP BY cluster, d),
c{r + 1} AS MATERIALIZED (
  SELECT cluster, d, CASE WHEN n IS NULL THEN c WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END::BIGINT AS c
  FROM c{r} LEFT JOIN m{r} USING (cluster, d))"""
            )
    chain = ",\n".join(parts)
    return f"""WITH {chain},
shas AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
  (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN shas USING (cluster)"""


ORACLE = _oracle()
