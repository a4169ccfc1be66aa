"""Ranks of communities and the running totals built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agoraflow.functions.scale import global_row_number

# fixed value: rank given to rows without a ranked community
UNRANKED = 999_999

# fixed value: most communities the reveal ever shows
MAX_VISIBLE = 100


def community_ranks(df: DataFrame, col: str = "subreddit", unknown: str = "Unknown", out: str = "sub_rank") -> DataFrame:
    """Communities numbered by document count, most frequent first, ties by name."""
    counts = (
        df.filter(F.col(col).isNotNull() & (F.col(col) != unknown))
        .groupBy(col)
        .agg(F.count("*").alias("n"))
    )
    return global_row_number(counts, [F.desc("n"), F.col(col)], out)


def frequency_rank(df: DataFrame, col: str = "subreddit", out: str = "sub_rank") -> DataFrame:
    """Add each row's community rank; unknown communities get ``UNRANKED``."""
    ranks = community_ranks(df, col, out=out).select(col, out)
    return df.join(ranks, col, "left").withColumn(out, F.coalesce(out, F.lit(UNRANKED)))


def cumulative_reveal(ranks: DataFrame, max_rank: int = MAX_VISIBLE, rank_col: str = "sub_rank") -> DataFrame:
    """Documents visible when the first n communities are shown, n up to ``max_rank``.

    The running sum reads at most ``max_rank`` rows.
    """
    frame = Window.orderBy(rank_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranks.filter(F.col(rank_col) <= max_rank).withColumn("visible", F.sum("n").over(frame))


def ramp_schedule(spark, frames: int, peak: int = MAX_VISIBLE) -> DataFrame:
    """Number of communities shown in each frame: up to ``peak`` at half time, then down."""
    half = frames // 2
    f = F.col("frame")
    up = 1 + (peak - 1) * (f / half)
    down = peak - (peak - 1) * ((f - half) / half)
    shown = F.when(f <= half, up).otherwise(down).cast("int")
    return spark.range(frames).select(
        F.col("id").alias("frame"), F.greatest(F.lit(1), F.least(F.lit(peak), shown)).alias("n_shown")
    )


def frame_reveal(ranks: DataFrame, frames: int, peak: int = MAX_VISIBLE) -> DataFrame:
    """Visible documents per frame: an equi-join of the schedule with the running totals.

    A frame that shows more communities than exist shows all of them.
    """
    reveal = cumulative_reveal(ranks, peak)
    last = reveal.agg(F.max("sub_rank")).first()[0]
    schedule = ramp_schedule(ranks.sparkSession, frames, peak).withColumn(
        "sub_rank", F.least(F.col("n_shown").cast("long"), F.lit(last))
    )
    return schedule.join(reveal, "sub_rank").select("frame", "n_shown", "visible")


def category_index(df: DataFrame, col: str, out: str = "category", modulo: int | None = None) -> DataFrame:
    """0-based position of each value among the sorted distinct values, optionally modulo."""
    index = global_row_number(df.select(col).distinct().filter(F.col(col).isNotNull()), [F.col(col)], out)
    index = index.withColumn(out, F.col(out) - 1)
    if modulo:
        index = index.withColumn(out, F.pmod(F.col(out), F.lit(modulo)))
    return df.join(index, col, "left")
