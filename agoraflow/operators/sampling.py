"""Exact-size samples, top-n and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agoraflow.functions.scale import global_row_number

# fixed value: hexadecimal digits of the hash that form a bucket (16 ** 4 buckets)
_BUCKET_DIGITS = 4


def sample_order(keys: Sequence[str], seed: int) -> Column:
    """Repeatable pseudo-random order: the same on any cluster and in any engine with md5."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_n(
    df: DataFrame,
    n: int,
    keys: Sequence[str],
    by: Sequence[str] = (),
    seed: int = 42,
    max_groups: int | None = None,
) -> DataFrame:
    """Exactly ``n`` rows (per ``by`` group), or all rows of a smaller group.

    Rows are taken in hash order of their unique key. A first pass counts rows per
    hash bucket (at most 65,536 buckets per group), which tells how many rows each
    bucket gives; the second pass keeps whole buckets and orders only what they
    hold. No task sees more than one bucket and nothing is gathered.
    """
    by = list(by)
    tagged = df.withColumn("_order", sample_order(keys, seed)).withColumn(
        "_bucket", F.substring("_order", 1, _BUCKET_DIGITS)
    )
    counts = tagged.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        counts.withColumn("_take", F.lit(n) - F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter("_take > 0")
        .drop("_n")
    )
    if not by or (max_groups and max_groups <= 4):
        # proven size: 16 ** 4 rows per group
        quota = F.broadcast(quota)
    within = Window.partitionBy(*by, "_bucket").orderBy("_order", *keys)
    return (
        tagged.join(quota, [*by, "_bucket"])
        .withColumn("_pos", F.row_number().over(within))
        .filter("_pos <= _take")
        .select(*df.columns)
    )


def balanced_sample(df: DataFrame, n: int, keys: Sequence[str] = ("type", "id"), by: str = "type", groups: int = 2, seed: int = 42) -> DataFrame:
    """``n / groups`` rows of every group."""
    return sample_n(df, n // groups, keys, [by], seed, max_groups=groups)


def top_per_group(df: DataFrame, n: int, by: Sequence[str], order: Sequence[Column], out: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    The rank filter is pushed below the shuffle as a group limit, so a hot group
    sends at most ``n`` rows per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    name = out or "_rank"
    kept = df.withColumn(name, rank).filter(F.col(name) <= n)
    return kept if out else kept.drop(name)


def head_counts(df: DataFrame, col: str, n: int, exclude: Sequence = (), out: str = "n") -> DataFrame:
    """The ``n`` most frequent values with their counts, ties by value."""
    rows = df.filter(F.col(col).isNotNull())
    if exclude:
        rows = rows.filter(~F.col(col).isin(*exclude))
    return rows.groupBy(col).agg(F.count("*").alias(out)).orderBy(F.desc(out), col).limit(n)


def paged(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """All rows with their ``page`` (from 0) of ``size`` rows in key order; the keys are unique.

    Written partitioned by page, or read page by page, this is the whole scan.
    """
    numbered = global_row_number(df, [F.col(k) for k in keys], "page")
    return numbered.withColumn("page", F.floor((F.col("page") - 1) / size).cast("long"))


def page_after(df: DataFrame, key: str, last, size: int) -> DataFrame:
    """The next page in key order after ``last``: a range filter instead of an offset."""
    rows = df if last is None else df.filter(F.col(key) > last)
    return rows.orderBy(key).limit(size)
