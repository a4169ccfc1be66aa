"""Encoding, decoding and counting against the public tokenizer libraries."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from agoraflow.llm import bpe, pieces
from agoraflow.llm.common import table
from agoraflow.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "",
    " ",
    "   x  ",
    "a" * 3000,
    "ab" * 2000 + "\x00\x1c\x1d\x85\xa0　 \n\r\n\t",
    "<|endoftext|> <s>▁▁ <0x0A> [INST]",
    "it's we'll THEY'RE don't 'D",
    "漢字かな交じり文" * 200,
    "🙂👩‍👩‍👧 é ﬁ ½ ² Ⅷ",
    "________________" * 50 + "=" * 999,
    "퟿\U0010ffff",
    "aaaaaaa bbbbb ababab " * 40,
]


def random_texts(n, seed):
    rng = random.Random(seed)
    alphabets = ["ab", "the ing ", "éèàü ñ", "0123 .,", " \n\t'", "漢字🙂 a", "thnderioas ▁", "".join(map(chr, range(32, 400)))]
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_library(tiktoken_encoding):
    tool = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for text in ODD + random_texts(1500, 1):
        ids = tool.encode(text)
        assert ids == tiktoken_encoding.encode_ordinary(text), text[:80]
        assert tool.decode(ids) == text.encode()


def test_tree_equals_merge_loop_on_whole_pieces():
    tool = bpe.Codec(bpe.codec(RANKS, public_tokenizers.PATTERN).ranks, public_tokenizers.PATTERN, cache_entries=50)
    for text in random_texts(300, 2):
        data = text.encode()[:90]
        assert tool._reduce(data) == tool.merge_loop(data)


def test_query_equals_library(spark, sf_dir, tiktoken_encoding):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in QUERIES["op4_byte_bpe"](spark, sf_dir).collect():
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def rows(spark):
    return spark.createDataFrame(
        [(i, t, "x") for i, t in enumerate(ODD + [None, "same", "same"])], "doc_id long, text string, n_tokens string"
    )


def test_encode_and_decode_rows(spark, tiktoken_encoding):
    docs = rows(spark)
    encoded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == docs.columns + ["token_ids"]
    back = bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert len(back) == len(ODD) + 3
    for r in back:
        assert r.token_ids == tiktoken_encoding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    digests = {r.doc_id: r for r in bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert digests[len(ODD)].n_tokens == 0 and digests[len(ODD)].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.token_digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts_equal_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ODD + random_texts(2000, 3)
    tool = pieces.PieceCounter(MODEL, cache_entries=100)
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        assert tool.count(part) == [len(x) for x in library.encode(part)]


def test_count_query_equals_library(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op6_piece_counts"](spark, sf_dir).collect()}
    want = {}
    for d, t in texts.items():
        n = len(library.encode(t))
        want[d] = (len(t.encode()), n, n > 4096)
    assert got == want


def test_count_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = rows(spark)
    got = pieces.count_tokens(docs, MODEL, limit=10)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    for r in got.collect():
        n = len(library.encode(r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 10)
    assert pieces.count_tokens(docs.limit(0), MODEL).count() == 0


def test_seam_test_equals_the_definition():
    """Pairs of tokens, related ones too: stable exactly where the merge loop gives them back."""
    import random

    import public_tokenizers

    from agoraflow.llm import bpe

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        tool = bpe.Codec(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)
    rng = random.Random(5)
    tokens = list(tool.bytes_of)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(5000)]
    for token in rng.sample(tokens, 5000):  # the two sides of every cut of a token
        data = tool.bytes_of[token]
        pairs += [(tool.ranks[data[:i]], tool.ranks[data[i:]]) for i in range(1, len(data)) if data[:i] in tool.ranks and data[i:] in tool.ranks]
    found = [tool.stable(*p) for p in pairs]
    assert found == [tool.merge_loop(tool.bytes_of[a] + tool.bytes_of[b]) == (a, b) for a, b in pairs]
    assert True in found and False in found


def test_caches_of_two_generations():
    from agoraflow.llm import bpe

    held = bpe.Recent(3)
    for i in range(3):
        held.put(i, i)
    assert held.get(1) == 1
    held.put(3, 3)
    assert held.get(1) == 1 and held.get(0) == 0 and set(held.new) == {0, 1, 3}  # carried over
    held.put(4, 4)
    assert held.get(2) is None and held.get(0) == 0


def test_decoding_goes_up_the_tree():
    import public_tokenizers

    from agoraflow.llm import bpe

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        tool = bpe.Codec(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)
    text = "one two, threé \U0001f600 " * 3000
    ids = tool.encode(text)
    assert len(ids) > 4 * bpe.DECODE_LEAF and tool.decode(ids) == text.encode() and tool.decode([]) == b""
