"""Word lists: the community whitelist and the keyword terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.functions.text import escape_regex, strip

# fixed values: shortest term, and the shorter term that is kept
MIN_TERM_LENGTH = 3
SHORT_TERM = "ai"


def clean_whitelist(lines: DataFrame, col: str = "value") -> DataFrame:
    """One row per listed community: stripped, lower-cased, without blanks or repeats."""
    return (
        lines.select(F.lower(strip(F.col(col))).alias("subreddit")).filter("subreddit != ''").distinct()
    )


def load_whitelist(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Read the first of ``paths`` that exists."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            return clean_whitelist(spark.read.text(path))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no whitelist at {list(paths)}")


def clean_terms(lines: DataFrame, col: str = "value", min_length: int = MIN_TERM_LENGTH) -> DataFrame:
    """term and its escaped pattern: stripped, lower-cased, unique, short terms dropped."""
    term = F.lower(strip(F.col(col)))
    return (
        lines.select(term.alias("term"))
        .filter((F.length("term") >= min_length) | (F.col("term") == SHORT_TERM))
        .distinct()
        .select("term", escape_regex(F.col("term")).alias("pattern"))
    )


def load_terms(spark: SparkSession, path: str, min_length: int = MIN_TERM_LENGTH) -> DataFrame:
    return clean_terms(spark.read.text(path), min_length=min_length)


def term_list(terms: DataFrame) -> list[str]:
    """The sorted terms as a Python list, for the pattern of ``keyword_filter``.

    For lists a person keeps. A generated list stays a table: ``match_terms_by_join``
    gives the same rows for any number of terms.
    """
    return sorted(r["term"] for r in terms.select("term").collect())
