"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a uniform key: the hash of its content, and after it the hash of its place, so
that no two rows share a key. A source's part of the mix is the rows whose key lies below a
threshold. The threshold is found without sorting: words are summed by source and leading
digits of the key, the bucket in which the budget ends is cut by its next digits, and so on
until that bucket holds one row. Only the rows of boundary buckets are read again.

Thresholds are nested: a larger budget's rows include a smaller one's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agoraflow.functions.scale import broadcast_checked, global_row_number, materialize

#: Runs of characters that are neither a space nor one of the ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a key that one histogram resolves: 4096 buckets a source.
DIGITS = 3
#: Digits of a whole key: 32 of the content, 16 of the row's place.
KEY_DIGITS = 48
#: Sorts after every key.
ALL = "~"


def _key(id_col: str, text_col: str, seed: int) -> Column:
    content = F.concat_ws(
        ":", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")),
    )
    place = F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0")
    return F.concat(F.md5(content), F.lower(place))


def water_level(sources: DataFrame, share: tuple[int, int], cap: int) -> float:
    """The level up to which sources are filled by weight: target = min(cap * size, level * weight).

    Each round takes the sources that the level overfills out of the weights and shares their
    excess among the others, until none is above its cap. The driver sees three sums a round.
    """
    num, den = share
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while True:
        full = F.col("source_size") * cap < F.lit(level) * F.col("weight")
        capped, weight = sources.agg(
            F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)),
        ).first()
        if (capped, weight) == before or not weight:
            return level
        before = (capped, weight)
        level = (num * total - den * capped) / (den * weight)


def source_targets(
    rows: DataFrame, weights: Sequence[int], share: tuple[int, int], cap: int
) -> DataFrame:
    """Per source: source, source_size, weight, target, epochs (whole passes) and need (words beyond them)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_number(sizes, [F.col("source").asc_nulls_last()], "_rank")
    place = F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place + 1).cast("long")
    sources = materialize(ranked.withColumn("weight", weight).drop("_rank"))
    level = water_level(sources, share, cap)
    most = F.col("source_size") * cap
    asked = F.lit(level) * F.col("weight")
    target = F.when(most < asked, most.cast("double")).otherwise(asked)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        sources.withColumn("target", target)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("need", F.col("target") - F.col("epochs") * F.col("source_size"))
    )


def _shared_digits(low: Column, high: Column) -> Column:
    """Leading characters that two keys have in common."""
    same = F.filter(F.sequence(F.lit(0), F.lit(KEY_DIGITS)), lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n))
    return F.array_max(same)


def thresholds(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """Per source with a need above zero: ``threshold`` and whether the row that bears it is taken.

    ``rows`` has source, key and size, ``needs`` has source and need. A boundary row is
    taken when that brings the sum nearer to the need. A source smaller than its need has the
    threshold that sorts after every key.
    """
    open_ = needs.filter(F.col("need") > 0).select("source", "need", F.lit(0).alias("at"))
    open_ = materialize(open_.withColumn("prefix", F.lit("")))
    rows = rows.filter(F.col("size") > 0).select("source", "key", "size")
    found = []
    first = True
    while open_.limit(1).count():
        o = broadcast_checked(open_.withColumnRenamed("source", "_source"))
        inside = F.col("source").eqNullSafe(F.col("_source"))
        if not first:
            inside = inside & (F.substring(F.col("key"), F.lit(1), F.col("at")) == F.col("prefix"))
        rows = rows.join(o, inside).drop("_source")
        if not first:  # what is left of the boundary buckets, a small part of the rows
            rows = materialize(rows)
        digit = F.substring(F.col("key"), F.col("at") + 1, F.lit(DIGITS))
        histogram = rows.groupBy("source", "need", digit.alias("digit")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
        )
        # at most 4096 rows a source
        order = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = histogram.withColumn("upto", F.sum("words").over(order))
        edge = materialize(
            upto.filter((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("words") <= F.col("need")))
            .withColumn("left", F.col("need") - (F.col("upto") - F.col("words")))
        )
        found.append(
            edge.filter(F.col("n") == 1).select(
                "source", F.col("low").alias("threshold"), (F.col("left") * 2 >= F.col("words")).alias("inclusive")
            )
        )
        if first:
            whole = open_.select("source").join(
                edge.select(F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")), "left_anti"
            )
            found.append(whole.select("source", F.lit(ALL).alias("threshold"), F.lit(False).alias("inclusive")))
        at = _shared_digits(F.col("low"), F.col("high"))
        open_ = materialize(
            edge.filter(F.col("n") > 1)
            .select("source", F.col("left").alias("need"), at.alias("at"), "low")
            .select("source", "need", "at", F.substring(F.col("low"), F.lit(1), F.col("at")).alias("prefix"))
        )
        rows = rows.select("source", "key", "size")
        first = False
    if not found:
        return open_.select("source", F.lit("").alias("threshold"), F.lit(False).alias("inclusive"))
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    return materialize(all_)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """``row`` (all columns of ``docs``), source, size in words (null text: 0) and key."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{source_col}`").alias("source"),
        size.alias("size"),
        _key(id_col, text_col, seed).alias("key"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    cap: int = 2,
    keep: Sequence[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 7,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, source_size, target, times and taken.

    Sources in code point order, null last, get ``weights`` in turn and share
    ``share[0] / share[1]`` of all words; no target is above ``cap`` times its source. ``times``
    says how often the mix takes a row (0 to ``cap``), ``taken`` is that times its words.

    A null or empty text has no words and is taken as often as its key says, with 0 words; null sources are one
    source; repeated rows are told apart by their place, so a group of copies is cut like any other rows. An
    empty table gives none. Columns named like a new one are replaced, others pass. What is in ``keep`` is written
    once under the checkpoint folder; leave the text out where only the numbers are wanted.
    """
    kept = [c for c in docs.columns if keep is None or c in keep]
    measured = measure(docs, id_col, text_col, source_col, seed)
    row = F.struct(*[F.col("row").getField(c).alias(c) for c in kept])
    rows = materialize(measured.withColumn("row", row))  # row places hold for one reading only
    sources = source_targets(rows, weights, share, cap)
    cuts = thresholds(rows, sources).select(F.col("source").alias("_cut"), "threshold", "inclusive")
    plan = materialize(sources.join(cuts, F.col("source").eqNullSafe(F.col("_cut")), "left").drop("_cut", "weight", "need"))
    plan = broadcast_checked(plan.withColumnRenamed("source", "_source"))
    low = (F.col("key") < F.col("threshold")) | ((F.col("key") == F.col("threshold")) & F.col("inclusive"))
    times = F.col("epochs") + F.coalesce(low, F.lit(False)).cast("long")
    new = ["size", "source_size", "target", "times", "taken"]
    return (
        rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("times", times)
        .withColumn("taken", F.col("times") * F.col("size"))
        .select(*[F.col("row").getField(c).alias(c) for c in kept if c not in new], *new)
    )


def write_mix(mixed: DataFrame, path: str) -> None:
    """Write every row as often as its ``times`` says."""
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    repeated = mixed.filter(F.col("times") > 0).withColumn("_copy", copies).drop("_copy")
    repeated.write.mode("overwrite").parquet(path)


#: The mix by plain sorting: running sums in key order, and the level from the sources in order of cap by weight.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    md5(concat('7:', coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
    coalesce(sum(2 * source_size) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS gone
  FROM sources
  WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT arg_min(level, gone) AS level FROM (
    SELECT ((3 * total - 2 * capped)::DOUBLE / (2 * (weights - gone))::DOUBLE) AS level, source_size, weight, gone FROM ordered)
  WHERE 2 * source_size >= level * weight),
targets AS (
  SELECT source, source_size,
    CASE WHEN 2 * source_size < level * weight THEN (2 * source_size)::DOUBLE ELSE level * weight END AS target
  FROM sources, levels),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS need,
    sum(size) OVER (PARTITION BY s.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before
  FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN before + size <= need OR (before <= need AND 2 * (need - before) >= size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""
