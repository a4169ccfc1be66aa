"""All-pairs similarity: cosine over vectors and Jaccard over word sets."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from agoraflow.functions.scale import global_running_sum, materialize
from agoraflow.functions.vectors import l2_normalise
from agoraflow.operators.sampling import sample_n

TOPIC_KEY = ("scope_type", "scope_value", "topic_id")

# rows of one side of a block product: 4096 x 768 doubles are 25 MB
BLOCK_ROWS = 4096

# rows of the left block that are multiplied at once, so that what is sent on is bounded
PRODUCT_ROWS = 256

# tasks that tile pairs are spread over at most
MOST_TASKS = 20_000

# a tile, the blocks that one task has of a side: rows and bytes of vectors at most (one block, if that is more)
TILE_ROWS = 16_384
TILE_BYTES = 16 * 1024 * 1024

# fixed value: directions that rows are sorted by
MAX_PIVOTS = 256


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _tile_product(keys: Sequence[str], threshold: float, out: pa.Schema):
    """Similar pairs of two tiles: products of a few rows of a block with all blocks paired with it, each sent on at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        listed = table.column("_low").is_valid()
        asked = table.filter(listed)
        order = np.lexsort((asked.column("_high").to_numpy(), asked.column("_low").to_numpy()))
        low, high = (asked.column(c).to_numpy()[order] for c in ("_low", "_high"))
        table = table.filter(pc.invert(listed)).sort_by("_block")
        block = table.column("_block").to_numpy()
        unit = _matrix(table.column("_unit"))
        named = [table.column(k).combine_chunks() for k in keys]
        of = lambda b: np.arange(np.searchsorted(block, b), np.searchsorted(block, b, side="right"))
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else []
        for x, y in zip(first, np.append(first[1:], len(low))):
            left = of(low[x])
            right = np.concatenate([of(b) for b in high[x:y]])
            other = unit[right].T
            for a in range(0, len(left), PRODUCT_ROWS):
                part = left[a : a + PRODUCT_ROWS]
                scores = unit[part] @ other
                hit = scores >= threshold
                if high[x] == low[x]:  # a block with itself: each pair of rows once
                    hit &= (right > part[:, None]) | (block[right] != low[x])
                i, j = np.nonzero(hit)
                arrays = [c.take(pa.array(part[i])) for c in named]
                arrays += [c.take(pa.array(right[j])) for c in named]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores[i, j])], schema=out)

    return run


def _nearest_pivot(pivots: np.ndarray, keys: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = _matrix(pa.chunked_array([batch.column("_unit")])) @ pivots.T if batch.num_rows else np.zeros((0, len(pivots)))
            best = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(best)), best], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best.astype(np.int64)), pa.array(angle)], names=[*keys, "_unit", "_pivot", "_angle"]
            )

    return run


def block_pairs(rows: DataFrame, threshold: float, keys: Sequence[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``_block``, the pairs ``_low`` <= ``_high`` of blocks that may hold similar rows).

    Rows go to the nearest of n / ``block_rows`` pivots (at most ``MAX_PIVOTS``), and inside a pivot's cell to rings by their angle to
    it, of about ``block_rows`` rows; a fuller ring is dealt into pieces. Angles obey the triangle inequality, so the angles of two rings
    to their pivots and that between the pivots bound the angle of any two of their rows from below.
    """
    keys = list(keys)
    spark = rows.sparkSession
    wanted = min(MAX_PIVOTS, max(1, math.ceil(rows.count() / block_rows)))
    pivots = np.array([r["_unit"] for r in sample_n(rows, wanted, keys).select("_unit").collect()])
    if not len(pivots):
        none = rows.withColumn("_block", F.lit(0).cast("long"))
        return none, none.select(F.col("_block").alias("_low"), F.col("_block").alias("_high"))
    schema = StructType(list(rows.select(*keys, "_unit").schema.fields)).add("_pivot", "long").add("_angle", "double")
    near = materialize(rows.select(*keys, "_unit").mapInArrow(_nearest_pivot(pivots, keys), schema))
    cells = near.groupBy("_pivot").agg(F.count("*").alias("_n"), F.min("_angle").alias("_from"), F.max("_angle").alias("_to"))
    cells = F.broadcast(materialize(cells))  # one row per pivot
    rings = F.ceil(F.col("_n") / block_rows)
    ring = F.least(F.floor((F.col("_angle") - F.col("_from")) / (F.col("_to") - F.col("_from")) * rings), rings - 1)
    placed = near.join(cells, "_pivot").select(
        *keys, "_unit", "_pivot", "_angle", F.when(F.col("_to") > F.col("_from"), ring).otherwise(0).cast("long").alias("_ring")
    )
    held = placed.groupBy("_pivot", "_ring").agg(
        F.count("*").alias("_n"), F.min("_angle").alias("_from"), F.max("_angle").alias("_to")
    )
    held = materialize(held.withColumn("_pieces", F.ceil(F.col("_n") / block_rows)))
    number = F.shiftleft("_pivot", 44) + F.shiftleft("_ring", 22)
    piece = F.pmod(F.xxhash64(*keys), F.col("_pieces"))
    blocked = placed.join(held.select("_pivot", "_ring", "_pieces"), ["_pivot", "_ring"]).select(
        *keys, "_unit", (number + piece).alias("_block")
    )
    limit = math.acos(max(-1.0, min(1.0, threshold))) + 1e-7
    between = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    close = [(i, j, float(between[i, j]) if i != j else 0.0) for i in range(len(pivots)) for j in range(i, len(pivots))]
    close = spark.createDataFrame(close, "_p bigint, _q bigint, _between double")  # at most MAX_PIVOTS ** 2 / 2 rows

    def side(x: str, pivot: str) -> DataFrame:
        blocks = held.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
        return blocks.select(
            F.col("_pivot").alias(pivot), (number + F.col("_piece")).alias(x), F.col("_from").alias(f"{x}_from"), F.col("_to").alias(f"{x}_to")
        )

    least = F.greatest(
        F.col("_between") - F.col("_low_to") - F.col("_high_to"),
        F.col("_low_from") - F.col("_between") - F.col("_high_to"),
        F.col("_high_from") - F.col("_between") - F.col("_low_to"),
    )
    pairs = (
        side("_low", "_p").join(F.broadcast(close), "_p").join(side("_high", "_q"), "_q")
        .filter((least <= limit) & ((F.col("_p") < F.col("_q")) | (F.col("_low") <= F.col("_high"))))
        .select("_low", "_high")
    )
    return blocked, materialize(pairs)


def _tiles(blocked: DataFrame) -> DataFrame:
    """_block, _tile: neighbouring blocks put together, so that a row is sent once per tile and not once per block it meets.

    Tiles are as large as a task may hold, but there are enough of them to keep all cores busy.
    """
    blocks = materialize(blocked.groupBy("_block").agg(F.count("*").alias("_n"), F.max(F.size("_unit")).alias("_dims")))
    rows, dims = blocks.agg(F.sum("_n"), F.max("_dims")).first()
    held = min(TILE_ROWS, TILE_BYTES // (8 * max(1, dims or 1)))
    busy = math.ceil(math.sqrt(4 * blocked.sparkSession.sparkContext.defaultParallelism))
    wide = max(1, min(held, math.ceil((rows or 0) / busy)))
    summed = global_running_sum(blocks, [F.col("_block")], "_n", "_sum")
    return materialize(summed.select("_block", F.floor((F.col("_sum") - F.col("_n")) / wide).alias("_tile")))


def cosine_pairs(
    df: DataFrame,
    threshold: float,
    keys: Sequence[str] = TOPIC_KEY,
    vector_col: str = "centroid",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every unordered pair of rows with cosine >= ``threshold``: a_<key>, b_<key>, similarity.

    Rows are put into blocks of near directions; only pairs of blocks whose angles allow the threshold are multiplied. One
    task has two tiles, runs of blocks of bounded size, with the list of the block pairs between them, so a row is shuffled
    once per tile it meets. Only pairs above the threshold leave the task, a few rows' at a time. The a side is the smaller key.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = list(keys)
    rows = materialize(df.select(*keys, l2_normalise(F.col(vector_col)).alias("_unit")))
    blocked, near = block_pairs(rows, threshold, keys, block_rows)
    blocked = materialize(blocked)
    tiles = _tiles(blocked)
    met = materialize(
        near.join(tiles.select(F.col("_block").alias("_low"), F.col("_tile").alias("_a")), "_low")
        .join(tiles.select(F.col("_block").alias("_high"), F.col("_tile").alias("_b")), "_high")
        .select("_a", "_b", "_low", "_high")
    )
    wanted = met.select("_a", "_b", F.explode(F.array("_low", "_high")).alias("_block")).distinct()
    sent = blocked.join(wanted, "_block").select("_a", "_b", *keys, "_unit", "_block")
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType()
    for side in ("a", "b"):
        for k in keys:
            schema = schema.add(f"{side}_{k}", types[k])
    schema = schema.add("similarity", DoubleType())
    # tile pairs are small but heavy: they are not merged into fewer tasks
    tasks = max(1, min(met.select("_a", "_b").distinct().count(), MOST_TASKS))
    spread = sent.unionByName(met, allowMissingColumns=True).repartition(tasks, "_a", "_b")
    pairs = spread.groupBy("_a", "_b").applyInArrow(_tile_product(keys, threshold, to_arrow_schema(schema)), schema)
    a = F.struct(*[F.col(f"a_{k}").alias(k) for k in keys])
    b = F.struct(*[F.col(f"b_{k}").alias(k) for k in keys])
    first, second = F.when(a < b, a).otherwise(b), F.when(a < b, b).otherwise(a)
    return pairs.select(first.alias("_a"), second.alias("_b"), "similarity").select(
        *[F.col(f"_a.{k}").alias(f"a_{k}") for k in keys],
        *[F.col(f"_b.{k}").alias(f"b_{k}") for k in keys],
        "similarity",
    )


def cosine_edges(centroids: DataFrame, threshold: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The similarity edge list of topic centroids.

    Ends are ordered by (scope_type, scope_value, topic_id), so on an edge between
    a cluster topic and a community topic the cluster is the source.
    """
    pairs = cosine_pairs(centroids, threshold, TOPIC_KEY, "centroid", block_rows)
    return pairs.select(
        F.col("a_scope_type").alias("source_scope"),
        F.col("a_scope_value").alias("source_value"),
        F.col("a_topic_id").alias("source_topic"),
        F.col("b_scope_type").alias("target_scope"),
        F.col("b_scope_value").alias("target_value"),
        F.col("b_topic_id").alias("target_topic"),
        "similarity",
    )


def word_sets(words: DataFrame, keys: Sequence[str] = TOPIC_KEY, word_col: str = "word") -> DataFrame:
    """The case-folded word set of each topic as a sorted array ``words``."""
    return words.groupBy(*keys).agg(F.sort_array(F.collect_set(F.lower(word_col))).alias("words"))


def _prefix_keys(ordered: DataFrame, threshold: float, hot: int) -> DataFrame:
    """words, _n, _key, _last, _m: the keys under which a set has to meet the sets similar to it.

    ``ordered`` has words, _n, _need (the least number of words that any similar set shares) and _o, the words from rare to
    frequent. A key is one word of the prefix. A key with more than ``hot`` sets is split by the next word that two
    sets share, and again while it is hot: sets that must share more words than the key has meet under longer keys. Only
    pairs of sets so small that the words of the key already make them similar meet under the hot key itself: ``_m``
    then is the size of the sets that the row may meet; it is null under a key that is not hot.
    """
    slack = 1e-9

    def at(row: DataFrame, first, last) -> DataFrame:
        places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return row.withColumn("_last", F.explode(places)).withColumn(
            "_key", F.concat("_key", F.array(F.element_at("_o", F.col("_last") + 1)))
        )

    level = 1
    rows = ordered.withColumn("_key", F.array().cast("array<string>")).withColumn("_last", F.lit(-1))
    rows = at(rows, F.lit(0), (F.col("_n") - F.col("_need")).cast("int"))
    found = None
    while True:
        rows = materialize(rows)
        many = materialize(rows.groupBy("_key").agg(F.count("*").alias("_f")).filter(F.col("_f") > hot).select("_key"))
        out = ["words", "_n", "_key", "_last"]
        none = F.lit(None).cast("int").alias("_m")
        cold = rows.join(many, "_key", "left_anti").select(*out, none)
        found = cold if found is None else found.unionByName(cold)
        if many.limit(1).count() == 0:
            return found
        held = materialize(rows.join(many, "_key", "left_semi"))
        # sizes n + m up to which the words of the key are enough
        room = F.lit(math.floor(level * (1 + threshold) / threshold + slack)) - F.col("_n")
        small = held.filter(room >= level).select(*out, F.explode(F.sequence(F.lit(level), room)).alias("_m"))
        found = found.unionByName(small)
        end = (F.col("_n") - F.greatest(F.col("_need"), F.lit(level + 1)) + level).cast("int")
        rows = at(held.filter(F.col("_n") > level), F.col("_last") + 1, end)
        level += 1


# sets that may meet under one word before a second word splits them
HOT_SETS = 1000


def similar_word_sets(sets: DataFrame, threshold: float, hot: int = HOT_SETS) -> DataFrame:
    """Pairs of distinct word sets with Jaccard >= ``threshold`` > 0: a, b, jaccard (a < b).

    Exact. The words of each set go from rare to frequent; two sets that are similar enough share a word among the
    first size - ceil(threshold * size) + 1 of each. Under a word that more than ``hot`` sets have there, they have to share the
    next word too. Sizes outside [t * n, n / t] never meet; a pair is dropped where the words after the last one of
    the key cannot make up for what is missing; each candidate pair is verified once.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    distinct = sets.select("words").distinct().withColumn("_n", F.size("words"))
    single = distinct.select("words", "_n", F.explode("words").alias("word"))
    frequency = single.groupBy("word").agg(F.count("*").alias("_f"))
    rare_first = F.sort_array(F.collect_list(F.struct("_f", "word")))
    slack = 1e-9
    # a hair below the product, so rounding can only lengthen the prefix
    need = F.greatest(F.ceil(F.col("_n") * F.lit(threshold) - F.lit(slack)), F.lit(1)).cast("int")
    ordered = (
        single.join(frequency, "word")
        .groupBy("words", "_n")
        .agg(rare_first.alias("_pairs"))
        .select("words", "_n", need.alias("_need"), F.transform("_pairs", lambda p: p["word"]).alias("_o"))
    )
    keys = _prefix_keys(ordered, threshold, hot)

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select(F.col("words").alias(x), F.col("_n").alias(f"_n{x}"), F.col("_last").alias(f"_l{x}"), "_key", "_m")

    cold, under_hot = keys.filter("_m IS NULL"), keys.filter("_m IS NOT NULL")
    met = side(cold, "a").drop("_m").join(side(cold, "b").drop("_m"), "_key")
    small = under_hot.select("words", "_n", "_last", "_key", F.col("_n").alias("_m")).distinct()
    met = met.unionByName(side(under_hot, "a").withColumn("_nb", F.col("_m")).join(
        side(small, "b").drop("_m"), ["_key", "_nb"]).select(met.columns))
    asked = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("_na") + F.col("_nb")) - F.lit(slack))
    most = F.size("_key") + F.least(F.col("_na") - F.col("_la"), F.col("_nb") - F.col("_lb")) - 1
    candidates = (
        met.filter(F.col("a") < F.col("b"))
        .filter(
            (F.col("_nb") >= F.col("_na") * threshold - slack)
            & (F.col("_na") >= F.col("_nb") * threshold - slack)
            & (most >= asked)
        )
        .select("a", "b")
        .distinct()
    )
    shared = F.size(F.array_intersect("a", "b"))
    score = shared / (F.size("a") + F.size("b") - shared)
    return candidates.withColumn("jaccard", score).filter(F.col("jaccard") >= threshold)


def shared_topics(words: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Topic pairs of two different communities with Jaccard >= ``threshold``.

    Identical word sets are compared once and expanded to their topics at the end.
    """
    sets = materialize(word_sets(words))
    near = similar_word_sets(sets, threshold)
    same = sets.select("words").distinct().select(
        F.col("words").alias("a"), F.col("words").alias("b"), F.lit(1.0).alias("jaccard")
    )
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).unionByName(same)
    named = sets.select("scope_type", "scope_value", "topic_id", "words")
    one = named.select(
        F.col("scope_value").alias("subreddit_1"), F.col("topic_id").alias("topic_1"),
        F.col("scope_type").alias("_t1"), F.col("words").alias("a"),
    )
    two = named.select(
        F.col("scope_value").alias("subreddit_2"), F.col("topic_id").alias("topic_2"),
        F.col("scope_type").alias("_t2"), F.col("words").alias("b"),
    )
    return (
        both.join(one, "a")
        .join(two, "b")
        .filter((F.col("_t1") == F.col("_t2")) & (F.col("subreddit_1") < F.col("subreddit_2")))
        .select("subreddit_1", "topic_1", "subreddit_2", "topic_2", "jaccard")
    )


def shared_topic_counts(words: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Number of similar topic pairs per community pair (first < second).

    Topics of a community with the same word set are counted before any pairing,
    so pairs of sets are weighted instead of pairs of topics being listed.
    """
    sets = materialize(
        word_sets(words).groupBy("scope_value", "words").agg(F.count("*").alias("_w"))
    )
    near = similar_word_sets(sets, threshold).select("a", "b")
    same = sets.select(F.col("words").alias("a"), F.col("words").alias("b")).distinct()
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    one = sets.select(F.col("scope_value").alias("subreddit_1"), F.col("words").alias("a"), F.col("_w").alias("_w1"))
    two = sets.select(F.col("scope_value").alias("subreddit_2"), F.col("words").alias("b"), F.col("_w").alias("_w2"))
    return (
        both.join(one, "a")
        .join(two, "b")
        .filter(F.col("subreddit_1") < F.col("subreddit_2"))
        .groupBy("subreddit_1", "subreddit_2")
        .agg(F.sum(F.col("_w1") * F.col("_w2")).alias("shared_topics"))
    )
