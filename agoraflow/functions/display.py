"""Presentation columns of the reports: sizes, colours, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: code of each scope type in coloured output
SCOPE_CODES = {"cluster": 0, "subreddit": 1}

# fixed value: number of colours before the palette repeats
PALETTE_SIZE = 20


def scope_code(scope: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, code in SCOPE_CODES.items():
        out = F.when(scope == name, F.lit(code)).otherwise(out)
    return out


def marker_size(n_docs: Column, base: float = 3.0, low: float = 3.0, high: float = 15.0) -> Column:
    """Logarithmic marker size clipped to a range."""
    return F.greatest(F.least(F.log1p(n_docs) * 2 + base, F.lit(high)), F.lit(low))


def degree_size(degree: Column, factor: float, base: float) -> Column:
    return degree * factor + base


def palette_index(index: Column, size: int = PALETTE_SIZE) -> Column:
    return F.pmod(index, F.lit(size))


def scope_label(scope: Column, value: Column) -> Column:
    return F.concat(F.initcap(scope), F.lit(": "), value)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, rounded half to even."""
    return F.bround(part * F.lit(100.0) / whole, digits)


def preview(text: Column, length: int = 60) -> Column:
    return F.substring(text, 1, length)
