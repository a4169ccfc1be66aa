"""A corpus from raw documents to token ids, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; it is
written as Parquet and read again before the next. All but the last return the columns of documents.

1. language_id: documents of unknown language, or of which no language makes up half, go.
2. simhash_near_dedup: one document of each class of near-duplicates stays.
3. substring_dedup: passages of 50 words or more that an earlier document has are cut out.
4. decontamination: words inside benchmark passages are cut out.
5. byte_bpe: the token ids of each text, decoded again as a check.

A document whose text is cut gets its new length in ``n_chars``; one of which no word is left goes.
Clean documents pass every stage byte for byte.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoraflow.functions.scale import materialize
from agoraflow.llm import bpe, fm_index, languages, simhash, substrings
from agoraflow.llm.common import table

#: Words of a shingle in near-duplicate stages.
SHINGLE = 5
RANKS = "byte_bpe_multi_50k.tiktoken"


def _with_length(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with n_chars of the text it has now, where documents have that column."""
    if "n_chars" not in before.columns:
        return after
    kind = before.schema["n_chars"].dataType
    return after.withColumn("n_chars", F.length("text").cast(kind)).select(*before.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the input that are not held out; null texts go."""
    return languages.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Classes are linked at 3 differing bits over five-word shingles; the smallest doc_id stays."""
    return simhash.keep_one_per_class(docs, shingle=SHINGLE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id keeps a repeated passage."""
    return _with_length(docs, substrings.remove_repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all windows of the benchmark table out of the texts."""
    return _with_length(docs, fm_index.remove_hits(docs, table(spark, sf_dir, "benchmark")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens and decoded_sha256, the hash of the bytes the ids decode to."""
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode_and_verify(docs, path, public_tokenizers.PATTERN)
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return encoded.select(*kept, "token_ids", "n_tokens", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Fingerprints, passages and merges cannot be written in SQL; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
