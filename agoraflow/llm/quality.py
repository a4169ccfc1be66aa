"""Quality rules: base counts of a document, and its divergence from language references.

The references are, per language of the corpus, a histogram of character classes and one of
the ``COMMON`` most frequent words (all other words are one more bin), counted over all
documents. A document is compared with every language by the Jensen-Shannon distance
(base 2, so 0 to 1) and judged by the nearest. Short documents have noisy
histograms, so each comparison has a least length below which it gives no verdict.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agoraflow.llm.common import append_columns, pick
from agoraflow.llm.fm_index import words_of

WINDOW = 8
COMMON = 40
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.42
MIN_CHARS = 100
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_CHUNK_BYTES = 4 << 20

#: Class of each UTF-8 byte: space, a-z, A-Z, 0-9, symbol, common punctuation, other ASCII, and the
#: first byte of characters of 2, 3 and 4 bytes. Continuation bytes are in the last class, left out.
CLASSES = 10
_CLASS = np.array(
    [
        0 if b in _SPACE
        else 1 if 97 <= b <= 122
        else 2 if 65 <= b <= 90
        else 3 if 48 <= b <= 57
        else 4 if b in SYMBOLS
        else 5 if b in b".,;:!?'\"()-"
        else 6 if b < 0x80
        else 7 if 0xC0 <= b <= 0xDF
        else 8 if 0xE0 <= b <= 0xEF
        else 9 if b >= 0xF0
        else CLASSES
        for b in range(256)
    ],
    dtype=np.int64,
)


def repeated_window_words(ids: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a ``window``-word window found twice or more in it.

    ``ids`` are the word numbers of all texts in a row. Windows are found by a 64-bit hash;
    those that share one are compared word by word.
    """
    n = len(ids)
    out = np.zeros(len(sizes), dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    per_text = np.maximum(sizes - window + 1, 0)
    if not per_text.sum():
        return out
    text = np.repeat(np.arange(len(sizes)), per_text)
    begin = np.repeat(starts - np.append(0, np.cumsum(per_text)[:-1]), per_text) + np.arange(per_text.sum())
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n - window + 1, dtype=np.uint64)
    for k in range(window):
        key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - window + 1 + k]
    key = key[begin] ^ (text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    shared = order[np.append(False, same) | np.append(same, False)]
    if not len(shared):
        return out
    columns = [ids[begin[shared] + k] for k in range(window)] + [text[shared]]
    order = np.lexsort(columns)
    equal = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    found = begin[shared[order[np.append(False, equal) | np.append(equal, False)]]]
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, found, 1)
    np.add.at(depth, found + window, -1)
    inside = np.append(0, np.cumsum(np.cumsum(depth[:-1]) > 0))
    return inside[ends] - inside[starts]


def base_counts(texts: list[bytes]) -> list[list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts."""
    word_lists = [t.split() for t in texts]
    sizes = np.array([len(w) for w in word_lists], dtype=np.int64)
    numbers: dict[bytes, int] = {}
    fresh = count()
    ids = np.fromiter(
        (numbers.setdefault(w, k) for words in word_lists for w, k in zip(words, fresh)), np.int64, int(sizes.sum())
    )
    chars, symbols, lines = [], [], []
    for t in texts:
        points = len(t.decode())
        chars.append(points - (len(t) - len(t.translate(None, _SPACE))))
        symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
        filled = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines.append(len(filled) - len(set(filled)))
    return [sizes.tolist(), chars, symbols, lines, repeated_window_words(ids, sizes).tolist()]


def class_histograms(texts: list[bytes]) -> np.ndarray:
    sizes = [len(t) for t in texts]
    cls = _CLASS[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    width = CLASSES + 1
    return np.bincount(owner * width + cls, minlength=len(texts) * width).reshape(-1, width)[:, :CLASSES]


def word_histograms(word_lists: list[list[bytes]], numbers: dict[bytes, int]) -> np.ndarray:
    """Counts of the numbered words (from 1); column 0 has all others."""
    width = len(numbers) + 1
    out = np.zeros((len(word_lists), width), dtype=np.int64)
    for row, words in zip(out, word_lists):
        row += np.bincount(np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words)), minlength=width)
    return out


def js_distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from a reference; rows without counts give 0."""
    total = rows.sum(axis=1, keepdims=True)
    p = rows / np.maximum(total, 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2

    def term(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    out = np.sqrt(np.clip((term(p) + term(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    return np.where(total[:, 0] > 0, out, 0)


@dataclass
class References:
    """Per language: character-class counts, and counts of its common words (first the other words)."""

    langs: list[str]
    classes: np.ndarray
    words: list[list[bytes]]
    counts: list[np.ndarray]

    def distances(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distance from the nearest language by character classes, and by common words."""
        hist = class_histograms(texts)
        by_class = np.min([js_distance(hist, ref) for ref in self.classes], axis=0)
        numbers = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for words in self.words for w in words))}
        word_lists = [words_of(t) for t in texts]
        hist = word_histograms(word_lists, numbers)
        total = hist.sum(axis=1)
        by_word = []
        for words, ref in zip(self.words, self.counts):
            own = hist[:, [numbers[w] for w in words]]
            by_word.append(js_distance(np.column_stack([total - own.sum(axis=1), own]), ref))
        return by_class, np.min(by_word, axis=0)


def _partial_counts(batches):
    """lang, kind, key, n: counts of one task, written whenever there are many."""
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def flush():
        rows = [(lang, "word", w, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, "class", b"%d" % k, int(n)) for lang, c in classes.items() for k, n in enumerate(c) if n]
        rows += [(lang, "total", b"", sum(c.values())) for lang, c in words.items()]
        words.clear()
        classes.clear()
        if rows:
            columns = list(zip(*rows))
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "kind", "key", "n"]
            )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(text))
            part = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
            classes[lang] = classes.get(lang, 0) + part
        if sum(map(len, words.values())) > 400_000:
            yield from flush()
    yield from flush()


def learn_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> References:
    """Count the references over all rows with a text and a language.

    What reaches the driver is ``common`` words and ten classes per language. Ties among
    words go to the smaller word.
    """
    rows = pick(docs, lang=lang_col, text=text_col).filter("lang is not null and text is not null")
    counted = (
        rows.mapInArrow(_partial_counts, "lang string, kind string, key binary, n long")
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    top = counted.withColumn("_rank", rank).filter(F.col("_rank") <= max(common, CLASSES)).collect()
    langs = sorted({r.lang for r in top})
    classes = np.zeros((len(langs), CLASSES))
    totals = dict.fromkeys(langs, 0)
    words: dict[str, list[tuple[int, bytes, int]]] = {lang: [] for lang in langs}
    for r in top:
        if r.kind == "class":
            classes[langs.index(r.lang), int(bytes(r.key))] = r.n
        elif r.kind == "total":
            totals[r.lang] = r.n
        elif r["_rank"] <= common:
            words[r.lang].append((r["_rank"], bytes(r.key), r.n))
    counts = []
    for lang in langs:
        words[lang].sort()
        own = [n for _, _, n in words[lang]]
        counts.append(np.array([totals[lang] - sum(own), *own], dtype=float))
    return References(langs, classes, [[w for _, w, _ in words[lang]] for lang in langs], counts)


def judge(
    docs: DataFrame,
    references: References,
    text_col: str = "text",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` with the base counts, base_failed, char_distance, word_distance and kept.

    A null text has no words. A distance is null where the text is shorter than its least
    length (``min_chars`` characters in words, ``min_words`` words) or no reference exists,
    and then gives no verdict. Columns that bear a result's name are replaced.
    """
    fields = [(c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [("base_failed", "boolean"), ("char_distance", "double"), ("word_distance", "double"), ("kept", "boolean")]
    shared = docs.sparkSession.sparkContext.broadcast(references)

    def make():
        def chunk(texts):
            counts = base_counts(texts)
            n_words, chars, repeats = np.array(counts[0]), np.array(counts[1]), np.array(counts[4])
            failed = (n_words < 20) | (100 * repeats > 30 * n_words)
            if shared.value.langs:
                by_class, by_word = shared.value.distances(texts)
                long_chars, long_words = chars >= min_chars, n_words >= min_words
            else:
                by_class = by_word = np.zeros(len(texts))
                long_chars = long_words = np.zeros(len(texts), dtype=bool)
            far = (long_chars & (by_class > max_char_distance)) | (long_words & (by_word > max_word_distance))
            distances = [
                [float(d) if ok else None for d, ok in zip(values, known)]
                for values, known in ((by_class, long_chars), (by_word, long_words))
            ]
            return [*counts, failed.tolist(), *distances, (~failed & ~far).tolist()]

        def compute(texts):
            out = [[] for _ in fields]
            part, size = [], 0
            for i, t in enumerate(texts):
                part.append(t or b"")
                size += len(part[-1])
                if size >= _CHUNK_BYTES or i == len(texts) - 1:
                    for column, values in zip(out, chunk(part)):
                        column.extend(values)
                    part, size = [], 0
            return out

        return compute

    return append_columns(docs, text_col, fields, make)
