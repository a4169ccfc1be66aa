"""Token counts of a piece model by rank-synchronous array merging.

A normalised text falls into pre-tokens at places no piece spans: before a word mark that
does not follow another one, and between any two characters that never stand side by side
inside a piece. Merges cannot cross such a place, so each pre-token is counted alone and
remembered by the worker. All pre-tokens of a batch that are new lie in one ragged array of
symbols; every round finds the lowest-rank pair of each sequence and applies it, in all
sequences at once. What survives is counted: 1 for a piece, its bytes for a character
without one (byte fallback).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from agoraflow.llm.common import append_columns

MARK = "▁"
#: Pre-tokens a worker remembers; a full cache is dropped and filled anew.
CACHE_ENTRIES = 500_000
#: Characters of new pre-tokens merged in one ragged array.
CHUNK_CHARS = 1_000_000


class PieceCounter:
    """Counts for one BPE piece model with byte fallback."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        import sentencepiece

        # the library reads the file and normalises; the merges are ours
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        odd = (self.model.is_byte, self.model.is_control, self.model.is_unknown, self.model.is_unused)
        pieces = {
            self.model.id_to_piece(i): self.model.get_score(i) for i in range(size) if not any(f(i) for f in odd)
        }
        self.fallback = any(self.model.is_byte(i) for i in range(size))
        if any(self.model.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are split differently")
        self.limit = cache_entries
        self.counts: dict[str, int] = {}
        self._tables(pieces)

    def _tables(self, pieces: dict[str, float]) -> None:
        """Symbols are numbered: pieces first, then other characters as they come."""
        self.symbol = {p: i for i, p in enumerate(pieces)}
        self.n_pieces = len(pieces)
        scores = np.array(list(pieces.values()))
        rank_of = np.unique(-scores, return_inverse=True)[1]  # lower is merged earlier
        self.cost = [1] * self.n_pieces
        keys, ranks, made = [], [], []
        inside = set()
        for piece in pieces:
            target = self.symbol[piece]
            for cut in range(1, len(piece)):
                inside.add(piece[cut - 1 : cut + 1])
                left, right = (self._symbol(piece[:cut]), self._symbol(piece[cut:]))
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    ranks.append(rank_of[target])
                    made.append(target)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        #: Whether all occurrences of a pair may merge in one round: no pair with the new piece has a lower rank.
        next_best = np.full(self.n_pieces, np.iinfo(np.int64).max)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            real = side < self.n_pieces
            np.minimum.at(next_best, side[real], self.ranks[real])
        self.all_at_once = next_best > rank_of
        if any(p[i - 1] != MARK and p[i] == MARK for p in pieces for i in range(1, len(p))):
            raise ValueError("a piece spans a word mark; texts cannot be cut there")
        self.pairs_inside = inside
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def _symbol(self, text: str) -> int | None:
        """The number of a piece or of a single character; None for text that is neither."""
        known = self.symbol.get(text)
        if known is None and len(text) == 1:
            known = self.symbol[text] = len(self.cost)
            self.cost.append(len(text.encode()) if self.fallback else 1)
        return known

    def _count_new(self, words: list[str]) -> None:
        """Count pre-tokens by merging them all together."""
        flat, owner, starts = [], [], []
        inside = self.pairs_inside
        for w, word in enumerate(words):
            before = None
            for ch in word:
                if before is None or before + ch not in inside:
                    starts.append(len(flat))  # no piece spans this place: a sequence of its own
                    owner.append(w)
                flat.append(self._symbol(ch))
                before = ch
        symbols = np.array(flat, dtype=np.int64)
        cost = np.array(self.cost, dtype=np.int64)
        sequence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
        owner = np.array(owner)
        total = np.zeros(len(words), dtype=np.int64)
        worst = np.iinfo(np.int64).max
        while len(symbols):
            pair = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[at] == pair) & (sequence[:-1] == sequence[1:])
            rank = np.append(np.where(hit, self.ranks[at], worst), worst)
            first = np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            done = best == worst
            if done.any():  # settled sequences are counted and leave
                rows = np.repeat(done, size)
                np.add.at(total, owner[sequence[rows]], cost[symbols[rows]])
                keep = ~rows
                symbols, sequence, rank = symbols[keep], sequence[keep], rank[keep]
                at = np.append(at, 0)[keep]
                best, size = best[~done], size[~done]
                if not len(symbols):
                    break
            else:
                at = np.append(at, 0)
            chosen = np.flatnonzero(rank == np.repeat(best, size))
            owner_of = sequence[chosen]
            lead = np.append(True, owner_of[1:] != owner_of[:-1])
            # the leftmost always; the others where none of these merges can bring a lower rank
            safe = np.logical_and.reduceat(self.all_at_once[self.made[at[chosen]]], np.flatnonzero(lead))
            chosen = chosen[lead | safe[np.cumsum(lead) - 1]]
            # overlapping neighbours: left to right, every other one
            run = np.append(True, np.diff(chosen) != 1)
            offset = np.arange(len(chosen)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            chosen = chosen[offset % 2 == 0]
            symbols[chosen] = self.made[at[chosen]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
            symbols, sequence = symbols[keep], sequence[keep]
        for word, n in zip(words, total.tolist()):
            self.counts[word] = n

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cuts = [self.cut(n) for n in (self.model.normalize(t) if t else "" for t in texts)]
        if len(self.counts) > self.limit:
            self.counts.clear()
        new, chars = [], 0
        for word in set().union(*cuts).difference(self.counts):
            new.append(word)
            chars += len(word)
            if chars >= CHUNK_CHARS:
                self._count_new(new)
                new, chars = [], 0
        if new:
            self._count_new(new)
        known = self.counts.__getitem__
        return [sum(map(known, words)) for words in cuts]


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The counter of a model file, once per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of the whole text.

    A null text counts as empty. Row by row, without a shuffle; other columns stay, and
    a column that bears a result's name is replaced.
    """

    def make():
        tool = counter(path)

        def compute(texts):
            sizes, counts = [], []
            for a in range(0, len(texts), 500):
                part = [t or b"" for t in texts[a : a + 500]]
                sizes += map(len, part)
                counts += tool.count([t.decode() for t in part])
            return [sizes, counts, [n > limit for n in counts]]

        return compute

    fields = [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")]
    return append_columns(docs, text_col, fields, make)
