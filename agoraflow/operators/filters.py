"""Predicates and row filters.

All are column expressions, so they stay in generated code and, where the source
format allows it, reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoraflow.functions.scale import broadcast_checked
from agoraflow.functions.text import bounded_pattern, bounded_pattern_column, strip

# fixed values: text columns per content kind, and the ones the word match reads
PREFILTER_COLUMNS = {
    "posts": ("subreddit", "title", "selftext"),
    "comments": ("subreddit", "body"),
}
MATCH_COLUMNS = {"posts": ("title",), "comments": ("body",)}


def contains_any(terms: Sequence[str], columns: Sequence[str]) -> Column:
    """True when a lower-cased column contains one of the terms as literal text."""
    used = sorted(set(terms))
    if not used:
        return F.lit(False)

    def hit(column: str) -> Column:
        # one element, so the lambda sees a text that is lower-cased once for all terms
        return F.exists(
            F.array(F.lower(column)), lambda text: reduce(or_, [F.contains(text, F.lit(t)) for t in used])
        )

    return reduce(or_, [F.coalesce(hit(c), F.lit(False)) for c in columns])


def matches_any_term(terms: Sequence[str], columns: Sequence[str]) -> Column:
    """True when a lower-cased column holds one of ``terms`` as a whole word (ASCII boundaries)."""
    if not terms:
        return F.lit(False)
    pattern = bounded_pattern(terms)
    return F.coalesce(
        reduce(or_, [F.rlike(F.lower(c), F.lit(pattern)) for c in columns]), F.lit(False)
    )


def keyword_filter(
    df: DataFrame,
    terms: Sequence[str],
    kind: str = "posts",
    match_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Keep rows that hold one of ``terms`` as a whole word.

    A whole-word hit is also a substring hit in the same column, so the cheap substring
    test runs first, over the columns that are matched: the conjunction short-circuits,
    the pattern sees candidates only, and no other wide column is read.
    """
    columns = match_cols or MATCH_COLUMNS[kind]
    return df.filter(contains_any(terms, columns) & matches_any_term(terms, columns))


def match_terms_by_join(
    df: DataFrame,
    terms: DataFrame,
    columns: Sequence[str],
    id_col: str = "id",
    term_col: str = "term",
    pattern_col: str = "pattern",
) -> DataFrame:
    """Whole-word filter for term lists too long for one pattern.

    The distinct words of each row meet the first word of every term in an
    equi-join that carries only ids, which leaves the few candidate patterns of a
    row; the text is tested against these alone. A term without any word
    character meets the rows that hold its first character. Rows are told apart by a hash of
    id and text, so a null id is a row like any other.
    """
    first_word = F.regexp_extract(term_col, "([0-9A-Za-z_]+)", 1)
    first = F.when(first_word != "", first_word).otherwise(F.substring(term_col, 1, 1))
    keyed = broadcast_checked(
        terms.select(first.alias("_first"), bounded_pattern_column(F.col(pattern_col)).alias("_pattern"))
    )
    text = F.lower(F.concat_ws("\n", *[F.col(c) for c in columns]))
    signs = F.regexp_extract_all(text, F.lit("([^0-9A-Za-z_])"), F.lit(1))
    firsts = F.array_distinct(F.concat(F.split(text, "[^0-9A-Za-z_]+"), signs))
    row = F.xxhash64(id_col, *columns)
    candidates = (
        df.select(row.alias("_row"), F.explode(firsts).alias("_first"))
        .join(keyed, "_first")
        .groupBy("_row")
        .agg(F.concat_ws("|", F.collect_set("_pattern")).alias("_patterns"))
    )
    joined = df.withColumn("_row", row).join(candidates, "_row").withColumn("_text", text)
    return joined.filter(F.expr("_text rlike _patterns")).select(*df.columns)


def event_time_range(df: DataFrame, start: int, end: int, time_col: str = "created_utc") -> DataFrame:
    """start <= time < end on an epoch-second column; reaches the Parquet scan."""
    return df.filter((F.col(time_col) >= start) & (F.col(time_col) < end))


def drop_empty_tokens(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    return df.filter(F.size(tokens_col) > 0)


def drop_blank_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Strip the text and drop rows where nothing is left."""
    return df.withColumn(text_col, strip(F.col(text_col))).filter(
        F.col(text_col).isNotNull() & (F.col(text_col) != "")
    )


def exclude_noise(df: DataFrame, label_col: str = "cluster_id", noise: int = -1) -> DataFrame:
    return df.filter(F.col(label_col) != noise)


def fill_unknown(df: DataFrame, col: str = "subreddit", label: str = "Unknown") -> DataFrame:
    return df.fillna({col: label})


def filter_by_cluster(df: DataFrame, cluster_id: int, col: str = "cluster_id") -> DataFrame:
    return df.filter(F.col(col) == cluster_id)


def filter_by_subreddit(df: DataFrame, subreddit: str, col: str = "subreddit") -> DataFrame:
    return df.filter(F.col(col) == subreddit)


def min_similarity(df: DataFrame, threshold: float, col: str = "similarity") -> DataFrame:
    return df.filter(F.col(col) >= threshold)


def cross_scope(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("source_scope") != F.col("target_scope"))


def within_scope(edges: DataFrame, scope: str = "subreddit") -> DataFrame:
    return edges.filter((F.col("source_scope") == scope) & (F.col("target_scope") == scope))


def visible_ranks(df: DataFrame, n: int, rank_col: str = "sub_rank") -> DataFrame:
    return df.filter(F.col(rank_col).between(1, n))


def id_in_list(df: DataFrame, ids: DataFrame, keys: Sequence[str] = ("type", "id")) -> DataFrame:
    """Keep rows whose key is in ``ids``: a semi join, whatever the number of ids."""
    return df.join(ids.select(*keys), list(keys), "left_semi")


def min_group_size(df: DataFrame, keys: Sequence[str], minimum: int) -> DataFrame:
    """Keep the rows of groups with at least ``minimum`` rows.

    Counts are combined before the shuffle and joined back, so a group with a
    third of all rows is never gathered in one task.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= minimum).drop("_n")
    return df.join(large, list(keys), "left_semi")
