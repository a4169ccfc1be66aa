"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents of one task. Its words are indexed: suffix order,
a wavelet tree over the Burrows-Wheeler transform for ranks, and every ``SAMPLE``-th text
position. The test windows are searched backward, all at once, one word per step;
occurrences are located by walking to the next sampled position, and their spans merged.

Only words that some test item has can occur in a hit, so every other word is a border of
the indexed text: no window reaches over it, and runs shorter than the shortest window are
left out. That keeps the alphabet as small as the benchmark's and changes no hit.
Documents are scanned where they lie; nothing is shuffled but the (small) windows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoraflow.llm.common import append_columns, pick

WINDOW = 10
SAMPLE = 16
#: Words of a shard: bounds the memory of one index.
SHARD_WORDS = 500_000
#: Bytes of test items that go to the workers at once; more items go in several blocks.
BLOCK_BYTES = 16 << 20

#: A-Z to a-z; bytes of words are 0-9, a-z and everything beyond ASCII, all others a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WaveletTree:
    """Rank queries over an integer sequence, one bit level at a time from the top."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.zeros, self.ones_before = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            before = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones_before.append(before)
            self.zeros.append(len(values) - int(before[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(position), position
        for k in range(self.levels):
            before, zeros = self.ones_before[k], self.zeros[k]
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = before[low], before[high]
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def access(self, position: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        value = np.zeros_like(position)
        for k in range(self.levels):
            before, zeros = self.ones_before[k], self.zeros[k]
            ones = before[position]
            one = before[position + 1] - ones
            value = (value << 1) | one
            position = np.where(one == 1, zeros + ones, position - ones)
        return value


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling. Zeros are borders; each is a letter of its own, by position."""
    n = len(text)
    border = text == 0
    rank = np.where(border, np.cumsum(border), text.astype(np.int64) + int(border.sum()))
    where, pair = np.arange(n), rank  # suffixes that still share a rank, and what to sort them by
    start = np.zeros(n, dtype=np.int64)  # first place of the group each of them is in
    step = 0
    while len(where):
        order = np.argsort(pair, kind="stable")
        where, pair, start = where[order], pair[order], start[order]
        index = np.arange(len(where))
        group = np.maximum.accumulate(np.where(np.append(True, start[1:] != start[:-1]), index, 0))
        same = np.maximum.accumulate(np.where(np.append(True, pair[1:] != pair[:-1]), index, 0))
        rank[where] = start + same - group  # equal pairs share the first place among them
        step = 2 * step or 1
        counts = np.bincount(same, minlength=len(where))
        where = where[counts[same] > 1]
        start = rank[where]
        follow = np.where(where + step < n, rank[np.minimum(where + step, n - 1)] + 1, 0)
        pair = start * (n + 1) + follow
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Count and locate word sequences in a text of word numbers; 0 is a border."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        order = suffix_order(text)
        n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))]).astype(np.int64)
        self.tree = WaveletTree(text[order - 1], symbols)  # the last symbol stands before the first
        # positions are sampled by their distance to the border before them, so that no walk meets one
        border = np.flatnonzero(text == 0)
        since = np.arange(n) - np.concatenate([[0], border + 1])[np.searchsorted(border, np.arange(n))]
        marked = ((since % sample) == 0)[order]
        self.marked_before = np.append(0, np.cumsum(marked))
        self.sampled = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that start with each row of ``patterns`` (its first ``lengths`` words)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.first[-1], dtype=np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (low < high))
            symbol = patterns[live, lengths[live] - 1 - back]
            for bound in (low, high):
                bound[live] = self.first[symbol] + self.tree.rank(symbol, bound[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        position = np.full(len(rows), -1, dtype=np.int64)
        at, steps, open_ = rows.copy(), 0, np.arange(len(rows))
        while len(open_):
            row = at[open_]
            before = self.marked_before[row]
            hit = self.marked_before[row + 1] > before
            position[open_[hit]] = self.sampled[before[hit]] + steps
            open_, row = open_[~hit], row[~hit]
            symbol = self.tree.access(row)
            at[open_] = self.first[symbol] + self.tree.rank(symbol, row)
            steps += 1
        return position


class Phrases:
    """Windows of test items, each with the items that have it; an item without id has windows, but no name."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words_of(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[i : i + window], set()).add(item)
        self.numbers = numbers
        self.items = [sorted(n for n in names if n is not None) for names in found.values()]
        self.lengths = np.array([len(p) for p in found], dtype=np.int64)
        self.patterns = np.zeros((len(found), window), dtype=np.int64)
        for i, p in enumerate(found):
            self.patterns[i, : len(p)] = p
        self.shortest = int(self.lengths.min(initial=window))


def _runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``ids`` to index, a border after each, and where each kept entry came from."""
    known = ids > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= shortest
    start, size = start[long], (end - start)[long] + 1  # with the border behind
    source = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    return np.append(ids, 0)[source], source


def find_spans(word_lists: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Per document: merged [start, end) word spans of all windows that occur, and their items."""
    sizes = [len(w) for w in word_lists]
    starts = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64) + 1)])
    ids = np.zeros(starts[-1], dtype=np.int64)
    for a, words in zip(starts, word_lists):
        ids[a : a + len(words)] = np.fromiter(map(phrases.numbers.get, words, repeat(0)), np.int64, len(words))
    out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in word_lists]
    text, source = _runs(ids, phrases.shortest)
    if not len(text) or not len(phrases.lengths):
        return out
    index = FMIndex(text, len(phrases.numbers) + 1)
    low, high = index.search(phrases.patterns, phrases.lengths)
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    rows = np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum())
    begin = source[index.locate(rows)]
    doc = np.searchsorted(starts, begin, side="right") - 1
    order = np.argsort(begin, kind="stable")
    begin, which, doc = begin[order], which[order], doc[order]
    end = begin + phrases.lengths[which]
    for d, phrase in set(zip(doc.tolist(), which.tolist())):
        out[d][1].update(phrases.items[phrase])
    # merge what overlaps or touches inside a document
    reach = np.maximum.accumulate(end)
    new = np.append(True, (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])) if len(begin) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    for a, b in zip(first, np.append(first[1:], len(begin))):
        d = int(doc[a])
        out[d][0].append((int(begin[a] - starts[d]), int(reach[b - 1] - starts[d])))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> list[Phrases]:
    """The test items in blocks of at most BLOCK_BYTES (or one item), read one block at a time."""
    items = pick(benchmark, item=id_col, text=text_col).withColumn("item", F.col("item").cast("string"))
    items = items.filter("text is not null").withColumn("size", F.octet_length("text"))
    total = items.agg(F.sum("size")).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    out = []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).select("item", "text").collect()
        out.append(Phrases([(r.item, r.text.encode()) for r in rows], window))
    return out


def mark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with _n_words, _spans (merged word spans: start, end, start, end, ...) and _items (sorted).

    A window is ``window`` consecutive words of an item; an item of fewer words is one window;
    null and wordless texts have none. The windows of an item without id are searched like any other; it is only
    missing from _items. Repeated items and rows are fine. Items beyond ``BLOCK_BYTES`` go in further blocks, each sent to
    the workers in turn, so what a worker holds stays bounded.
    """
    scan = _scanner(docs, benchmark, item_col, item_text_col, window)
    fields = [("_n_words", "long"), ("_spans", "array<int>"), ("_items", "array<string>")]
    return append_columns(docs, text_col, fields, lambda: scan)


def _scanner(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int):
    """A function from texts to (n_words, spans, items) of each, over all blocks of items."""
    blocks = _blocks(benchmark, item_col, item_text_col, window)
    held = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def scan(texts):
        n_words, spans, items = [], [], []
        shard: list[list[bytes]] = []
        size = 0

        def index_shard():
            merged = [([], set()) for _ in shard]
            for block in held:
                for d, (s, names) in enumerate(find_spans(shard, block.value)):
                    merged[d] = (merged[d][0] + s, merged[d][1] | names)
            for s, names in merged:
                spans.append(_merge(s))
                items.append(sorted(names))
            shard.clear()

        for text in texts:
            words = words_of(text)
            n_words.append(len(words))
            shard.append(words)
            size += len(words)
            if size >= SHARD_WORDS:
                index_shard()
                size = 0
        index_shard()
        return [n_words, spans, items]

    return scan


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), spans, items, contaminated for every row."""
    text_col = columns.pop("text_col", "text")
    marked = mark_hits(pick(docs, doc_id=id_col, text=text_col), benchmark, "text", **columns)
    n_hit = F.aggregate(
        F.transform("_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0), lambda a, x: a + x
    ).cast("long")
    return marked.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.col("_spans").alias("spans"),
        F.col("_items").alias("items"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


def remove_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with all hit words cut out of the text; documents of which no word is left are dropped.

    Null and empty texts, repeated rows and further columns, whatever their names, are kept as they are; an empty
    table gives none. A document without a hit keeps its text byte for byte. Where a span is cut, the text before
    it and the text behind it are put on lines of their own.
    """
    names = docs.columns
    emptied = "_emptied"
    while emptied in names:
        emptied += "_"
    scan = _scanner(docs, benchmark, item_col, item_text_col, window)

    def compute(texts):
        cut = [_cut(t, s) for t, s in zip(texts, scan(texts)[1])]
        return [[None if t is None else t.decode() for t in cut], [t == b"" != was for t, was in zip(cut, texts)]]

    cleaned = append_columns(docs, text_col, [(text_col, "string"), (emptied, "boolean")], lambda: compute)
    return cleaned.filter(~F.col(f"`{emptied}`")).select(*[F.col(f"`{c}`") for c in names])


def _cut(text: bytes | None, spans: list[int]) -> bytes | None:
    if text is None or not spans:
        return text
    flat = np.frombuffer(text.translate(WORD_BYTES), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(np.int8), [0]])))
    begin, end = edge[::2], edge[1::2]
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        kept.append(text[at : begin[a]].strip())
        at = end[b - 1]
    kept.append(text[at:].strip())
    left = b"\n".join(p for p in kept if p)
    return left if words_of(left) else b""
