"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the characters that count as white space when text is stripped
_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# fixed value: a word character is an ASCII letter, digit or underscore
WORD_CHARS = "0-9A-Za-z_"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of every kind, not only blanks."""
    return F.btrim(c, F.lit(_SPACE))


# fixed values: the characters that get a backslash when a term is escaped
_SPECIAL = "()[]{}?*+-|^$\\.&~# \t\n\r\v\f"


def escape_regex(c: Column) -> Column:
    """Escape the pattern characters of a term."""
    return F.regexp_replace(c, r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0b\f])", r"\\$1")


def escape_literal(term: str) -> str:
    """``escape_regex`` for a Python string."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in term)


def bounded_pattern(terms: Iterable[str]) -> str:
    """One alternation matching any of ``terms`` as whole words, longest first."""
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    body = "|".join(escape_literal(t) for t in ordered)
    return f"(?<![{WORD_CHARS}])(?:{body})(?![{WORD_CHARS}])"


def bounded_pattern_column(escaped: Column) -> Column:
    """The whole-word pattern of one escaped term held in a column."""
    return F.concat(F.lit(f"(?<![{WORD_CHARS}])"), escaped, F.lit(f"(?![{WORD_CHARS}])"))


def post_text(title: Column | str = "title", selftext: Column | str = "selftext") -> Column:
    """Title, one blank, body; a missing part counts as empty."""
    t = F.col(title) if isinstance(title, str) else title
    s = F.col(selftext) if isinstance(selftext, str) else selftext
    return F.concat(F.coalesce(t, F.lit("")), F.lit(" "), F.coalesce(s, F.lit("")))


def comment_text(body: Column | str = "body") -> Column:
    b = F.col(body) if isinstance(body, str) else body
    return F.coalesce(b, F.lit(""))


def safe_name(c: Column) -> Column:
    """A scope name usable as a path part."""
    return F.translate(c, "/\\", "__")


def drop_first_prefix(c: Column, prefix: str = "subreddit_") -> Column:
    """Remove the first occurrence of ``prefix`` and keep any later one."""
    return F.regexp_replace(c, f"^(.*?){prefix}", "$1")


def split_topic_key(c: Column) -> tuple[Column, Column]:
    """Split ``<scope>_topic<id>`` on its last ``_topic``."""
    pattern = r"^(.*)_topic(-?\d+)$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2).cast("int")


def join_sorted(c: Column, sep: str = ", ") -> Column:
    return F.concat_ws(sep, F.sort_array(c))
