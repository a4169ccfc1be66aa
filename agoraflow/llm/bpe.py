"""Byte-level BPE as a monoid: encode halves, join neighbours, stop when the seam is stable.

Why a join is exact. Call two tokens a *stable pair* when the merge loop on their joined
bytes gives the two tokens back. A sequence of tokens is the encoding of its bytes if
every pair of neighbours is stable: take the first merge that would cross a border in the
merge loop over the whole; up to then the two tokens beside the border have seen the same
merges as on their own, and the crossing merge has the lowest rank (leftmost on ties)
of all, so it would also happen in the loop over the pair alone, which it does not. So no
merge crosses a border, and each token forms by itself.

Joining two encoded halves therefore only has to look at the seam: a window of tokens
around it is encoded anew and grows until the pairs at both of its ends are stable.
Tokens outside stay as they are. Decoding is the matching map back: bytes of tokens are
concatenated up a tree of halves.

Whether a pair is stable follows from how its two tokens form. Where every token has a higher
rank than its parts, merges happen in the order of ranks, so at any time the tokens beside the
border are known: those on the right edge of the left token's tree and on the left edge of the
right one's. The pair is stable if none of these neighbours would merge first.

The pattern cuts a text into matches that are encoded separately, so between matches
the join is plain concatenation.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from agoraflow.llm.common import append_columns

#: Encoded matches of one generation that a worker keeps.
CACHE_ENTRIES = 250_000
#: Of each of the smaller caches: halves, windows and pairs.
PART_ENTRIES = 60_000
#: Bytes up to which halves are remembered, too.
SHORT = 6
#: Bytes of a leaf of the tree, which is encoded by the definition.
LEAF = 6
#: Bytes of texts whose matches are encoded together.
GROUP_BYTES = 1 << 20
#: Tokens of a leaf when decoding.
DECODE_LEAF = 1024
_NEVER = 1 << 62


class Recent:
    """A cache of two generations: a full one becomes the old one, and what is asked for again is carried over."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self.turn()
        self.new[key] = value

    def turn(self) -> None:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and their numbers."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Codec:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_entries: int = CACHE_ENTRIES):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.decimal = {rank: str(rank) for rank in self.bytes_of}
        self.pieces = Recent(cache_entries)
        self.halves, self.windows, self.pairs = (Recent(PART_ENTRIES) for _ in range(3))
        # at most one entry per token
        self.edges: dict[int, tuple[list, list] | None] = {}

    def merge_loop(self, data: bytes) -> tuple[int, ...]:
        """The definition: merge the lowest-rank pair, leftmost first, until none is left."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _edges(self, token: int) -> tuple[list, list] | None:
        """(right edge, left edge) of a token's tree from the byte up: (bytes, rank of the token that takes it in).

        None where the token is not made of two tokens of lower rank.
        """
        if token not in self.edges:
            data = self.bytes_of[token]
            found = None
            if len(data) == 1:
                found = ([(data, _NEVER)], [(data, _NEVER)])
            else:
                parts = self._parts(data)
                if parts is not None:
                    left, right = self._edges(parts[0]), self._edges(parts[1])
                    if left is not None and right is not None:
                        found = (
                            [*right[0][:-1], (right[0][-1][0], token), (data, _NEVER)],
                            [*left[1][:-1], (left[1][-1][0], token), (data, _NEVER)],
                        )
            self.edges[token] = found
        return self.edges[token]

    def _parts(self, data: bytes) -> tuple[int, int] | None:
        """The two tokens that the merge loop joins last to ``data``, if both rank below it."""
        ranks, rank = self.ranks, self.ranks[data]
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        pair = ranks[parts[0]], ranks[parts[1]]
        singles = len(parts[0]) == 1, len(parts[1]) == 1
        return pair if all(one or r < rank for one, r in zip(singles, pair)) else None

    def stable(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            known = self._is_stable(left, right)
            self.pairs.put(pair, known)
        return known

    def _is_stable(self, left: int, right: int) -> bool:
        one, two = self._edges(left), self._edges(right)
        if one is None or two is None:
            return self._window(self.bytes_of[left] + self.bytes_of[right]) == (left, right)
        get = self.ranks.get
        ends, starts = one[0], two[1]
        i = j = 0
        while True:
            end, gone = ends[i]
            start, taken = starts[j]
            across = get(end + start)
            # of equal ranks the leftmost pair merges first
            if across is not None and across < gone and across <= taken:
                return False
            if gone == taken == _NEVER:
                return True
            if gone <= taken:
                i += 1
            else:
                j += 1

    def _window(self, data: bytes) -> tuple[int, ...]:
        if len(data) > 2 * SHORT:
            return self.merge_loop(data) if len(data) <= 64 else self._reduce(data)
        known = self.windows.get(data)
        if known is None:
            known = self.merge_loop(data)
            self.windows.put(data, known)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of two encoded neighbours."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a, b = 1, 1
        while True:
            inner = left[len(left) - a :] + right[:b]
            middle = self._window(b"".join(map(self.bytes_of.__getitem__, inner)))
            low = a == len(left) or self.stable(left[-a - 1], middle[0])
            high = b == len(right) or self.stable(middle[-1], right[b])
            if low and high:
                return left[: len(left) - a] + middle + right[b:]
            if not low:
                a = min(len(left), 2 * a)
            if not high:
                b = min(len(right), 2 * b)

    def _reduce(self, data: bytes) -> tuple[int, ...]:
        """Halves first, then the join, up the tree."""
        size = len(data)
        if size > SHORT:
            return self.join(self._reduce(data[: size // 2]), self._reduce(data[size // 2 :]))
        known = self.halves.get(data)
        if known is None:
            if size <= LEAF:
                known = self.merge_loop(data)
            else:
                known = self.join(self._reduce(data[: size // 2]), self._reduce(data[size // 2 :]))
            self.halves.put(data, known)
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """One match of the pattern. A match that is a token is that token."""
        data = piece.encode()
        rank = self.ranks.get(data)
        return (rank,) if rank is not None else self._reduce(data)

    def encode_all(self, texts: Sequence[str]) -> list[list[int]]:
        """The ids of each text, without special tokens; a match that several of them have is encoded once."""
        cuts = [self.cut(text) for text in texts]
        self.pieces.turn()
        new, old = self.pieces.new, self.pieces.old
        for piece in set(chain.from_iterable(cuts)).difference(new):
            known = old.get(piece)
            new[piece] = self.encode_piece(piece) if known is None else known
        return [list(chain.from_iterable(map(new.__getitem__, cut))) for cut in cuts]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without special tokens."""
        return self.encode_all([text])[0]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of a token sequence: halves are decoded and concatenated, up the tree."""
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, once per worker process."""
    key = (path, pattern)
    if key not in _CODECS:
        with open(path, "rb") as file:
            _CODECS[key] = Codec(read_ranks(file.read()), pattern)
    return _CODECS[key]


def _groups(texts: Sequence[bytes | None]):
    """The texts (null: empty) in order, in groups of about ``GROUP_BYTES``."""
    group, size = [], 0
    for text in texts:
        group.append("" if text is None else text.decode())
        size += len(text or b"")
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _each(docs: DataFrame, text_col: str, fields, per_ids: Callable, path: str, pattern: str) -> DataFrame:
    def make():
        tool = codec(path, pattern)

        def compute(texts):
            rows = [per_ids(tool, ids) for group in _groups(texts) for ids in tool.encode_all(group)]
            return list(zip(*rows)) if rows else [[] for _ in fields]

        return compute

    return append_columns(docs, text_col, fields, make)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "token_ids"
) -> DataFrame:
    """``docs`` with the token ids of the whole text (a null text has none).

    ``path`` is the rank file, present on every worker with the tokenizer package; it is
    read there. Row by row, without a shuffle; repeated rows and other columns stay.
    """
    return _each(docs, text_col, [(out, "array<int>")], lambda tool, ids: (_compact(ids),), path, pattern)


def encode_and_verify(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with token_ids, n_tokens and decoded_sha256, the hash of the bytes that the ids decode to, in one pass."""

    def both(tool: Codec, ids: list[int]):
        return _compact(ids), len(ids), hashlib.sha256(tool.decode(ids)).hexdigest()

    fields = [("token_ids", "array<int>"), ("n_tokens", "long"), ("decoded_sha256", "string")]
    return _each(docs, text_col, fields, both, path, pattern)


def _compact(ids: list[int]) -> np.ndarray:
    """Four bytes a token until the batch is handed on, in place of Python numbers."""
    return np.array(ids, dtype=np.int32)


def decode_documents(
    encoded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", out: str = "decoded"
) -> DataFrame:
    """``encoded`` with the decoded bytes of ``ids_col``; null ids give null.

    An id outside the table raises KeyError: the row was not made by this table.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import BinaryType

    @F.pandas_udf(BinaryType())
    def decode(ids):
        tool = codec(path, pattern)
        return ids.map(lambda x: None if x is None else tool.decode(x))

    return encoded.withColumn(out, decode(F.col(f"`{ids_col}`")))


def token_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids.

    The same rows as ``encode_documents`` and ``decode_documents`` with hashes in place of
    the sequences, which then need not leave the task.
    """

    def digests(tool: Codec, ids: list[int]):
        decimal = ",".join(map(tool.decimal.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()

    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return _each(docs, text_col, fields, digests, path, pattern)
