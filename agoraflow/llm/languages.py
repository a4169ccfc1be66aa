"""Language identification as inference of a mixture.

A document is a draw of letter n-grams from a mixture of languages. Expectation-maximisation
finds the proportions of the languages in each document; the set of languages is grown one by
one while the penalised likelihood gains. The prediction is the language with the largest
proportion, which is the score.

The language models are hashed byte trigrams of letters (everything that is not a letter of
ASCII or a byte beyond it counts as a space), counted over all labelled rows given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraflow.llm.common import append_columns, pick

BUCKETS = 4096
SMOOTHING = 0.5
EM_ROUNDS = 8
#: Log-likelihood that one more language has to gain, times the log of the number of n-grams.
PENALTY = 1.5
UNKNOWN = "und"
_ROWS = 128
_SEGMENT = 1 << 20

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """One row of bucket counts per text; trigrams of spaces alone are left out."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    held: list[bytes] = []
    rows: list[int] = []
    size = 0
    for row, text in enumerate(texts):
        letters = b"  " + text.translate(_LETTERS)  # the spaces part it from the text before
        if len(letters) > _SEGMENT:  # by itself, in pieces that share two bytes
            letters += b"  "
            for a in range(0, len(letters) - 2, _SEGMENT):
                piece = letters[a : a + _SEGMENT + 2]
                _add(out, np.full(len(piece) - 2, row), piece)
        else:
            held.append(letters)
            rows.append(row)
            size += len(letters)
        if held and (size >= _SEGMENT or row == len(texts) - 1):
            _add(out, np.repeat(rows, [len(h) for h in held]), b"".join(held) + b"  ")
            held, rows, size = [], [], 0
    return out


def _add(out: np.ndarray, owner: np.ndarray, letters: bytes) -> None:
    """Add the trigrams that start in all but the last two bytes to the rows of their owners."""
    flat = np.frombuffer(letters, dtype=np.uint8).astype(np.uint32)
    key = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
    bucket = (key * np.uint32(2654435761)) >> np.uint32(20)
    used = key != 0x202020
    owner = owner[: len(key)]
    out += np.bincount(owner[used] * BUCKETS + bucket[used], minlength=out.size).reshape(out.shape)


def has_letter(text: bytes) -> bool:
    """Whether a text has any Unicode letter."""
    return any(map(str.isalpha, text.decode()))


@dataclass
class LanguageModels:
    """Trigram probabilities, a row per language in alphabetical order."""

    langs: list[str]
    probabilities: np.ndarray

    def _em(self, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions over the allowed languages, and their log-likelihood."""
        share = allowed / allowed.sum(axis=1, keepdims=True)
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        for _ in range(EM_ROUNDS):
            ratio = counts / (share @ self.probabilities)
            share = share * (ratio @ self.probabilities.T) / total
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
        mixed = np.log(np.maximum(share @ self.probabilities, 1e-30))
        return share, (counts * mixed).sum(axis=1, dtype=np.float64)

    def infer(self, counts: np.ndarray) -> np.ndarray:
        """Proportions of the languages of each row of trigram counts."""
        counts = counts.astype(np.float32)
        n, k = len(counts), len(self.langs)
        penalty = PENALTY * np.log(np.maximum(counts.sum(axis=1), 2))
        single = counts.astype(np.float64) @ np.log(self.probabilities.T.astype(np.float64))
        best = single.argmax(axis=1)
        chosen = np.zeros((n, k), dtype=np.float32)
        chosen[np.arange(n), best] = 1
        shares, score = chosen.copy(), single[np.arange(n), best]
        if k == 1:
            return shares
        everything, _ = self._em(counts, np.ones((n, k), dtype=np.float32))
        open_ = np.arange(n)
        for _ in range(k - 1):
            # the strongest language that is not in the set yet
            rest = np.where(chosen[open_] > 0, -1, everything[open_])
            trial = chosen[open_].copy()
            trial[np.arange(len(open_)), rest.argmax(axis=1)] = 1
            share, value = self._em(counts[open_], trial)
            better = value - penalty[open_] > score[open_]
            open_, share, trial, value = open_[better], share[better], trial[better], value[better]
            if not len(open_):
                break
            shares[open_], chosen[open_], score[open_] = share, trial, value
        return shares


def _count_task(batches):
    """lang, bucket, n of one task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        langs = batch.column(0).to_pylist()
        for a in range(0, len(texts), _ROWS):
            counts = trigram_counts(texts[a : a + _ROWS])
            part = np.array(langs[a : a + _ROWS], dtype=object)
            for lang in set(part):
                totals[lang] = totals.get(lang, 0) + counts[part == lang].sum(axis=0)
    for lang, counts in totals.items():
        bucket = np.flatnonzero(counts)
        columns = [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket), pa.array(counts[bucket])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModels:
    """Count the models over all rows with a text and a language.

    The driver receives at most ``BUCKETS`` numbers per language, whatever the number of rows.
    """
    known = pick(rows, lang=lang_col, text=text_col).filter("lang is not null and text is not null")
    counted = (
        known.mapInArrow(_count_task, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = counted.column("lang").to_pylist()
    langs = sorted(set(names))
    totals = np.full((len(langs), BUCKETS), SMOOTHING)
    place = {lang: i for i, lang in enumerate(langs)}
    rows_ = np.array([place[x] for x in names], dtype=np.int64)
    totals[rows_, counted.column("bucket").to_numpy()] += counted.column("n").to_numpy()
    return LanguageModels(langs, (totals / totals.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, models: LanguageModels, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the proportion of that language, 0 to 1).

    ``und`` with score 0 for a null text, a text without a letter, or where no language is
    known. Ties go to the language that is first in the alphabet. Row by row on the whole text;
    other columns stay, one that bears a result's name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # BUCKETS numbers per language

    def make():
        model = shared.value

        def compute(texts):
            names, scores = [], []
            for a in range(0, len(texts), _ROWS):
                part = [t or b"" for t in texts[a : a + _ROWS]]
                if model.langs:
                    shares = model.infer(trigram_counts(part))
                    best = shares.argmax(axis=1)
                for i, t in enumerate(part):
                    if model.langs and has_letter(t):
                        names.append(model.langs[best[i]])
                        scores.append(min(1.0, max(0.0, float(shares[i, best[i]]))))
                    else:
                        names.append(UNKNOWN)
                        scores.append(0.0)
            return [names, scores]

        return compute

    return append_columns(docs, text_col, [("lang_pred", "string"), ("score", "double")], make)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def keep_identified(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_score: float = 0.5,
) -> DataFrame:
    """``docs`` without rows of unknown language, or of which no language makes up ``min_score``.

    Learns from the labelled rows that are not held out; where none is labelled every row
    is unknown and the result is empty.
    """
    models = learn(docs.filter(~held_out(id_col)), text_col, lang_col)
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # no name can clash with a result's
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = identify(renamed, models, names[text_col])
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
