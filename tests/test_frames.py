"""Archives of several zstd frames: borders of frames and lines, bad lines, more than one task."""

from __future__ import annotations

import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from agoraflow.operators import tokens
from agoraflow.sources import frames


def write(path, parts, **options):
    skippable = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"other"
    with open(path, "wb") as out:
        for i, part in enumerate(parts):
            out.write(zstandard.ZstdCompressor(level=1 + i % 3, write_checksum=i % 2 == 0, write_content_size=i % 3 != 0).compress(part))
            if i == 1:
                out.write(skippable)


def cut(data, seed, many=9):
    rng = random.Random(seed)
    at = sorted(rng.randrange(len(data) + 1) for _ in range(many))
    return [data[a:b] for a, b in zip([0, *at], [*at, len(data)])]


@pytest.mark.parametrize("seed", range(5))
def test_every_line_is_read_once(tmp_path, seed):
    rng = random.Random(seed)
    lines = [b"x" * rng.choice([0, 1, 30, 3000]) + b"%d" % i for i in range(200)]
    data = b"\n".join(lines) + (b"\n" if seed % 2 else b"")
    path = str(tmp_path / "a.zst")
    write(path, cut(data, seed))
    for size in (1, 400, 1 << 30):
        reader = frames.ArchiveReader([path], size)
        got = []
        for p in reader.partitions():
            got += [line.rstrip(b"\n") for line in frames.partition_lines(p.path, p.start, p.end, p.previous)]
        assert got == lines


def test_a_line_over_several_partitions(tmp_path):
    """Frames without any line end in them start no line; the partition before reads over all of them."""
    path = str(tmp_path / "a.zst")
    write(path, [b"one\ntw", b"", b"o-", b"two-", b"", b"two\nthree\n", b"", b"four"])
    parts = frames.ArchiveReader([path], 1).partitions()
    assert len(parts) == 5
    got = [b"".join(frames.partition_lines(p.path, p.start, p.end, p.previous)) for p in parts]
    assert b"".join(got) == b"one\ntwo-two-two\nthree\nfour"
    assert got[1] == got[2] == b"" and got[3] == b"three\n"


def test_rows_bad_lines_and_tasks(spark, tmp_path):
    rows = [{"id": f"p{i}", "subreddit": "s", "created_utc": i, "title": "t" * 200} for i in range(500)]
    text = "\n".join([*map(json.dumps, rows[:250]), "{broken", "", "[1]", *map(json.dumps, rows[250:])]).encode()
    path = str(tmp_path / "RS_2025-07.zst")
    write(path, cut(text, 1, 30))
    df = frames.read_framed_archives(spark, [path], "posts", partition_bytes=100)
    assert df.rdd.getNumPartitions() > 5
    got = df.collect()
    assert sorted(r.id for r in got if r.bad_line is None) == sorted(r["id"] for r in rows)
    assert sorted(r.bad_line for r in got if r.bad_line is not None) == ["[1]", "{broken"]
    assert {r.source_file for r in got} == {"RS_2025-07.zst"}


def test_no_archive(tmp_path):
    path = str(tmp_path / "bad.zst")
    open(path, "wb").write(b"not an archive")
    with pytest.raises(ValueError):
        frames.ArchiveReader([path], 1).partitions()
    open(path, "wb").close()
    assert frames.ArchiveReader([path], 1).partitions() == []


def test_lookup_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(tokens, "_LOOKUP_WORDS", 100)
    words = [f"w{i}" for i in range(950)]
    vocabulary = spark.createDataFrame([(w, i + 3) for i, w in enumerate(words)], "word string, token int")
    lookup = tokens.write_lookup(vocabulary)
    assert len(lookup.parts) > 5 and sum(p[1] for p in lookup.parts) == 950
    docs = spark.createDataFrame([("post", "1", " ".join(words)), ("post", "2", "w1 none w2"), ("post", "3", "")], "type string, id string, text string")
    out = tokens.tokenize(docs, lookup)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.tokens for r in out.collect()}
    assert got == {"1": [1, *range(3, 953), 2], "2": [1, 4, 0, 5, 2], "3": [1, 2]}
    empty = tokens.tokenize(docs, vocabulary.limit(0)).filter("id = '2'").first().tokens
    assert empty == [1, 0, 0, 0, 2]
