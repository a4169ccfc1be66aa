"""Words, vocabularies, token arrays, pooled vectors and n-gram counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType
from pyspark.sql.window import Window

from agoraflow.functions.scale import broadcast_checked, deal, global_row_number, materialize, scratch_path, storage_of

# fixed values: special token ids, and the first id of a word
UNKNOWN_ID, BEGIN_ID, END_ID, FIRST_WORD_ID = 0, 1, 2, 3

# fixed value: dimensions of a document vector
VECTOR_DIMS = 768

# documents that are counted or made dense at once
COUNTED_ROWS = 1024

# words of texts whose terms are counted at once; a longer text counts alone
BATCH_WORDS = 1 << 21


def words_of(text: Column, word_chars: str = r"\p{L}\p{N}", min_length: int = 1) -> Column:
    """Lower-cased words of a text: the longest runs of ``word_chars`` of sufficient length."""
    if min_length <= 1:
        return F.array_remove(F.split(F.lower(text), f"[^{word_chars}]+"), "")
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{word_chars}]{{{min_length},}}"), F.lit(0))


def build_vocabulary(df: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """word, n, token: ids by frequency, most frequent first, ties by word."""
    counts = (
        df.select(F.explode(words_of(F.col(text_col))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
    )
    ids = global_row_number(counts, [F.desc("n"), F.col("word")], "token")
    return ids.withColumn("token", (F.col("token") + (FIRST_WORD_ID - 1)).cast("int"))


# words of one file of a lookup: 80 MB
_LOOKUP_WORDS = 4_000_000


def _word_hashes(word: Column) -> Column:
    return F.struct(F.xxhash64(word).alias("one"), F.xxhash64(F.lit(1), word).alias("two"))


def _write_part(folder: str):
    """Write the rows of a task as plain arrays, sorted by hash: all first hashes, all second ones, all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("one", "ascending"), ("two", "ascending")])
        one, two, token = (table.column(c).to_numpy() for c in ("one", "two", "token"))
        storage, inner = storage_of(folder)
        # a name for each attempt: only the files of attempts that succeed are listed
        name = f"{uuid.uuid4().hex}.words"
        storage.create_dir(inner, recursive=True)
        with storage.open_output_stream(f"{inner}/{name}") as out:
            out.write(one.tobytes() + two.tobytes() + token.astype(np.int32).tobytes())
        names = ["name", "n", "first"]
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(one)], pa.int64()), pa.array([int(one[0])], pa.int64())], names=names)

    return run


class WordLookup:
    """Ids of words by two hashes from sorted arrays in shared storage.

    Files on a mounted folder are memory-mapped, so the workers of a machine share them and read only the pages they
    touch; from other storage each worker reads a file when it first needs it.
    """

    def __init__(self, folder: str, parts: Sequence[tuple[str, int, int]]):
        self.folder, self.parts = folder, sorted(parts, key=lambda p: p[2])
        self._open: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return {"folder": self.folder, "parts": self.parts, "_open": {}}

    def _arrays(self, i: int):
        if i not in self._open:
            name, n, _ = self.parts[i]
            storage, inner = storage_of(self.folder)
            if storage.type_name == "local":
                raw = np.memmap(f"{inner}/{name}", dtype=np.uint8, mode="r")
            else:
                with storage.open_input_stream(f"{inner}/{name}") as file:
                    raw = np.frombuffer(file.read(), dtype=np.uint8)
            self._open[i] = raw[: 8 * n].view(np.int64), raw[8 * n : 16 * n].view(np.int64), raw[16 * n :].view(np.int32)
        return self._open[i]

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        found = np.full(len(one), UNKNOWN_ID, dtype=np.int32)
        if not self.parts:
            return found
        firsts = np.array([p[2] for p in self.parts])
        part = np.searchsorted(firsts, one, side="right") - 1
        for i in np.unique(part[part >= 0]):
            first, second, token = self._arrays(int(i))
            rows = np.flatnonzero(part == i)
            at = np.searchsorted(first, one[rows])
            while len(rows):  # once, but for words whose first hashes are equal
                inside = at < len(first)
                rows, at = rows[inside], at[inside]
                same = first[at] == one[rows]
                rows, at = rows[same], at[same]
                hit = second[at] == two[rows]
                found[rows[hit]] = token[at[hit]]
                rows, at = rows[~hit], at[~hit] + 1
        return found


def write_lookup(vocabulary: DataFrame) -> WordLookup:
    """Write the words of ``vocabulary`` (word, token) as sorted hash arrays under the checkpoint folder."""
    spark = vocabulary.sparkSession
    folder = scratch_path(spark, "words")
    rows = vocabulary.select(_word_hashes(F.col("word")).alias("h"), F.col("token").cast("int")).select("h.*", "token")
    rows = materialize(rows)
    parts = max(1, -(-rows.count() // _LOOKUP_WORDS))
    written = rows.repartitionByRange(parts, "one").mapInArrow(_write_part(folder), "name string, n bigint, first bigint")
    return WordLookup(folder, [tuple(r) for r in written.collect()])  # one row per file


def tokenize(
    df: DataFrame,
    vocabulary: DataFrame | WordLookup,
    keys: Sequence[str] = ("type", "id"),
    text_col: str = "text",
    max_len: int | None = None,
) -> DataFrame:
    """keys + ``tokens``: begin id, word ids, end id, without padding, one row per row of ``df``.

    One pass without a shuffle: words are cut and hashed in the JVM, and looked up in sorted arrays that ``write_lookup`` has put
    into shared storage (done here when ``vocabulary`` is a table). A null text has no words. ``max_len`` is the limit of an
    encoder, special ids included: words past it are left out. ``tokenize_chunks`` keeps them all.
    """
    keys = list(keys)
    lookup = vocabulary if isinstance(vocabulary, WordLookup) else write_lookup(vocabulary)
    words = words_of(F.col(text_col))
    if max_len is not None:
        words = F.slice(words, 1, max_len - 2)
    hashes = F.coalesce(F.transform(words, _word_hashes), F.array().cast("array<struct<one: bigint, two: bigint>>"))
    hashed = df.select(F.struct(*keys).alias("_keys"), hashes.alias("_words"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            found = lookup.find(*(flat.field(c).to_numpy(zero_copy_only=False) for c in (0, 1)))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
            tokens = np.insert(found, np.concatenate((begins, ends)), [BEGIN_ID] * len(begins) + [END_ID] * len(ends))
            # where a text ends and the next begins, the end id comes first
            offsets = np.concatenate(([0], ends + 2 * np.arange(1, len(ends) + 1))).astype(np.int32)
            tokens[offsets[:-1]], tokens[offsets[1:] - 1] = BEGIN_ID, END_ID
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))], names=["_keys", "tokens"]
            )

    schema = StructType().add(hashed.schema["_keys"]).add("tokens", ArrayType(IntegerType()))
    return hashed.mapInArrow(ids, schema).select("_keys.*", "tokens")


def tokenize_chunks(
    df: DataFrame,
    vocabulary: DataFrame,
    chunk_len: int,
    keys: Sequence[str] = ("type", "id"),
    text_col: str = "text",
) -> DataFrame:
    """keys + ``chunk`` + ``tokens``: whole texts in chunks of at most ``chunk_len`` ids, special ids included.

    For encoders with a limit: no word is left out. A text without words has one chunk.
    """
    inner = chunk_len - 2
    if inner < 1:
        raise ValueError("a chunk holds at least one word")
    keys = list(keys)
    body = F.slice("tokens", 2, F.size("tokens") - 2)
    n = F.greatest(F.ceil((F.size("tokens") - 2) / inner), F.lit(1)).cast("int")
    part = F.slice(F.col("_body"), F.col("chunk") * inner + 1, F.lit(inner))
    return (
        tokenize(df, vocabulary, keys, text_col)
        .select(*keys, body.alias("_body"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
        .select(*keys, "chunk", F.concat(F.array(F.lit(BEGIN_ID)), part, F.array(F.lit(END_ID))).alias("tokens"))
    )


def tokenize_with(
    df: DataFrame, tokenizer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: StructType | str
) -> DataFrame:
    """Tokenize with a user function over Arrow batches; it loads its model once per task."""
    return df.mapInPandas(tokenizer, schema)


def embed_with(
    df: DataFrame,
    encoder: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    keys: Sequence[str] = ("type", "id"),
    schema: StructType | str = "type string, id string, vector array<float>",
) -> DataFrame:
    """Encode each key exactly once with a user function over Arrow batches.

    Of rows that share a key the smallest one, column by column, is encoded.
    """
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else df.distinct()
    return once.select(*df.columns).mapInPandas(encoder, schema)


def mean_pool_tokens(
    df: DataFrame,
    token_vectors: DataFrame,
    keys: Sequence[str] = ("type", "id"),
    tokens_col: str = "tokens",
    out: str = "vector",
) -> DataFrame:
    """Mean of the vectors of each document's tokens; tokens without a vector are left out.

    Repeated tokens are counted first and enter the mean as weights.
    """
    keys = list(keys)
    counted = (
        df.select(*keys, F.explode(tokens_col).alias("token"))
        .groupBy(*keys, "token")
        .agg(F.count("*").cast("double").alias("_w"))
    )
    vectors = broadcast_checked(token_vectors.select("token", "vector"))
    mean = Summarizer.mean(array_to_vector(F.col("vector")), F.col("_w"))
    return (
        counted.join(vectors, "token").groupBy(*keys).agg(vector_to_array(mean).alias(out))
    )


def embed_documents(
    df: DataFrame, dims: int = VECTOR_DIMS, keys: Sequence[str] = ("type", "id"), text_col: str = "text", min_docs: int = 1
) -> DataFrame:
    """One unit vector of ``dims`` numbers per document, exactly once per key.

    The built-in encoder hashes words to dimensions (md5, so any engine can repeat it) and
    weights the counts by inverse document frequency, ln((n + 1) / (f + 1)) with f the documents
    that use the dimension. Of rows that share a key the smallest text counts. Words are counted
    inside their document, so texts are shuffled once and nothing after that; the counts are written, and read
    for the frequencies and for the vectors. A document without words, or whose every weight is 0, has no vector.
    """
    keys = list(keys)
    once = df.groupBy(*keys).agg(F.min(text_col).alias("_text"))
    dim = lambda word: F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % dims
    dims_of = F.transform(words_of(F.col("_text")), lambda w: dim(w).cast("int"))
    hashed = once.select(*keys, F.coalesce(dims_of, F.array().cast("array<int>")).alias("_dims"))
    named = [hashed.schema[k] for k in keys]
    sparse = StructType([*named]).add("dims", ArrayType(IntegerType())).add("counts", ArrayType(IntegerType()))

    def count(batches):
        for batch in batches:
            for part in (batch.slice(i, COUNTED_ROWS) for i in range(0, batch.num_rows, COUNTED_ROWS)):
                column = part.column(len(keys))
                row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
                used, n = np.unique(row * dims + column.flatten().to_numpy(), return_counts=True)
                some, size = np.unique(used // dims, return_counts=True)
                ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (used % dims, n)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(some)) for i in range(len(keys))), *lists], names=sparse.names)

    counted = materialize(hashed.mapInArrow(count, sparse))
    docs = counted.count()
    frequency = counted.select(F.explode("dims").alias("dim")).groupBy("dim").agg(F.count("*").alias("f")).filter(F.col("f") >= min_docs)
    # one row per dimension
    weight = np.zeros(dims)
    for r in frequency.select("dim", F.log((F.lit(docs) + 1) / (F.col("f") + 1)).alias("idf")).collect():
        weight[r["dim"]] = r["idf"]
    schema = StructType([*named]).add("vector", ArrayType(DoubleType()))

    def unit(batches):
        for batch in batches:
            for part in (batch.slice(i, COUNTED_ROWS) for i in range(0, batch.num_rows, COUNTED_ROWS)):
                used, n = part.column(len(keys)), part.column(len(keys) + 1)
                row = np.repeat(np.arange(len(used)), used.value_lengths().to_numpy())
                dense = np.zeros((len(used), dims))
                at = used.flatten().to_numpy()
                dense[row, at] = n.flatten().to_numpy() * weight[at]
                norm = np.linalg.norm(dense, axis=1)
                some = np.flatnonzero(norm > 0)
                flat = (dense[some] / norm[some, None]).ravel()
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dims), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(some)) for i in range(len(keys))), vectors], names=schema.names)

    return counted.mapInArrow(unit, schema)


def _with_terms(
    df: DataFrame, columns: Sequence[str], text_col: str, max_n: int, stop_words: Sequence[str] | None, word_chars: str, min_length: int
) -> DataFrame:
    """columns + ``_g1`` .. ``_gn``: the word terms of each length once stop words are gone.

    They stay columns of their own and are put together inside the generator: a column of all terms would
    make the optimizer compute them again in a filter on its size. Texts are dealt evenly first, as a short text
    has hundreds of terms.
    """
    stops = list(stop_words) if stop_words is not None else StopWordsRemover.loadDefaultStopWords("english")
    dealt = deal(df, [*columns, text_col])
    words = dealt.select(*columns, words_of(F.col(text_col), word_chars, min_length).alias("_words"))
    words = StopWordsRemover(inputCol="_words", outputCol="_g1", stopWords=stops).transform(words)
    for n in range(2, max_n + 1):
        words = NGram(n=n, inputCol="_g1", outputCol=f"_g{n}").transform(words)
    return words


def _all_terms(max_n: int) -> Column:
    return F.concat(*[F.col(f"_g{n}") for n in range(1, max_n + 1)])


def document_terms(
    df: DataFrame,
    by: Sequence[str] = ("scope_type", "scope_value", "topic_id", "type", "id"),
    text_col: str = "text",
    max_n: int = 3,
    stop_words: Sequence[str] | None = None,
    word_chars: str = r"\p{L}\p{N}_",
    min_length: int = 2,
) -> DataFrame:
    """by..., term: the terms ``ngram_counts`` counts, once per document."""
    rows = _with_terms(df, by, text_col, max_n, stop_words, word_chars, min_length)
    return rows.select(*by, F.explode(F.array_distinct(_all_terms(max_n))).alias("term"))


def _count_terms(terms: DataFrame, by: list[str], max_n: int) -> DataFrame:
    """by..., term, n: the terms of ``_with_terms``, counted over the texts of a batch.

    Terms are numbered in the batch; only different ones become rows. The same term can come from several batches.
    """

    def count(part: pa.RecordBatch):
        group = np.zeros(part.num_rows, dtype=np.int64)
        for i in range(len(by)):
            column = part.column(i).dictionary_encode(null_encoding="encode")
            group = np.unique(group * (len(column.dictionary) + 1) + column.indices.to_numpy(), return_inverse=True)[1]
        for used in part.columns[len(by) :]:
            numbered = used.flatten().dictionary_encode()
            row, size = np.repeat(np.arange(len(used)), used.value_lengths().fill_null(0).to_numpy()), len(numbered.dictionary)
            if not size:
                continue
            key, first, times = np.unique(group[row] * size + numbered.indices.to_numpy(), return_index=True, return_counts=True)
            keys = [part.column(i).take(pa.array(row[first])) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays(
                [*keys, numbered.dictionary.take(pa.array(key % size)), pa.array(times.astype(np.int64))], names=[*by, "term", "n"]
            )

    def run(batches):
        for batch in batches:
            lengths = batch.column(len(by)).value_lengths().fill_null(0).to_numpy()
            piece = np.cumsum(lengths, dtype=np.int64) // BATCH_WORDS
            bounds = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(piece)]
            for begin, end in zip(bounds, bounds[1:]):
                if begin < end:
                    yield from count(batch.slice(begin, end - begin))

    fields = [f"`{c}` {terms.schema[c].dataType.simpleString()}" for c in by]
    grams = [f"_g{n}" for n in range(1, max_n + 1)]
    return terms.select(*by, *grams).mapInArrow(run, ", ".join([*fields, "term string", "n long"]))


def ngram_counts(
    df: DataFrame,
    by: Sequence[str] = ("scope_type", "scope_value", "topic_id"),
    text_col: str = "text",
    max_n: int = 3,
    stop_words: Sequence[str] | None = None,
    min_df: int = 2,
    word_chars: str = r"\p{L}\p{N}_",
    min_length: int = 2,
) -> DataFrame:
    """Occurrences of each 1..``max_n`` word term per topic: by..., term, n, total.

    Stop words go first, then n-grams are formed inside each document. A term
    counts only if it occurs in at least ``min_df`` topics of its scope (all of
    ``by`` but the last column); ``total`` is its count over those topics.
    """
    by = list(by)
    # most terms are rare: they are counted inside the task and shuffled once, by scope and term, for all that follows
    terms = _with_terms(df, by, text_col, max_n, stop_words, word_chars, min_length)
    counts = _count_terms(terms, by, max_n).repartition(*by[:-1], "term").withColumn("_hash", F.xxhash64("term"))
    # a few rows per topic of the scope, so this window group is small for any term; the hash tells most rows apart in the sort.
    # Terms of too few topics, most of all, go before what is left is added up.
    across = Window.partitionBy("_hash", "term", *by[:-1])
    return (
        counts.withColumn("_topic", F.dense_rank().over(across.orderBy(by[-1])))
        .withColumns({"_df": F.max("_topic").over(across), "total": F.sum("n").over(across)})
        .filter(F.col("_df") >= min_df)
        .groupBy(*by, "term", "total")
        .agg(F.sum("n").alias("n"))
        .select(*by, "term", "n", "total")
    )
