"""Archives, stores, reports and streams: round trips through files."""

from __future__ import annotations

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from agoraflow import schemas
from agoraflow.plans import stages
from agoraflow.sources import archives, lists, stores
from agoraflow.streaming import ingest


def post(i, subreddit="X", title="a gpt post", **extra):
    row = {
        "id": f"p{i}", "subreddit": subreddit, "title": title, "selftext": "gpt", "url": None, "created_utc": 1751328000 + i,
        "num_comments": i, "score": 1, "author": "u", "subreddit_id": "t5", "over_18": False, "retrieved_on": i, "unused": [1],
    }
    return {**row, **extra}


def write_zst(path, rows, window_log=None):
    data = "".join(json.dumps(r) + "\n" for r in rows).encode()
    if window_log:
        params = zstandard.ZstdCompressionParameters.from_level(3, window_log=window_log)
        packer = zstandard.ZstdCompressor(compression_params=params)
        with open(path, "wb") as f, packer.stream_writer(f) as out:
            out.write(data)
    else:
        path.write_bytes(zstandard.ZstdCompressor().compress(data))


@pytest.fixture
def dumps(tmp_path):
    root = tmp_path / "dumps" / "deep"
    root.mkdir(parents=True)
    write_zst(root / "RS_2025-07.zst", [post(1), post(2, "other"), post(3, "Y"), post(3, "Y", retrieved_on=9, score=7)])
    write_zst(root / "RS_2024-07.zst", [post(4)])
    write_zst(root / "RC_2025-07.zst", [{"id": "c1", "subreddit": "X", "body": "b", "created_utc": 1}])
    (root / "RS_2025-07.txt").write_text("no")
    return tmp_path / "dumps"


def test_discover(spark, dumps, tmp_path):
    roots = [str(dumps), str(tmp_path / "absent")]
    names = [p.rsplit("/", 1)[1] for p in archives.discover_archives(spark, roots, "posts", [2025])]
    assert names == ["RS_2025-07.zst"]
    both = archives.discover_archives(spark, roots, "posts", [2024, 2025])
    assert both == sorted(both) and len(both) == 2
    assert len(archives.discover_archives(spark, roots, "comments", [2025])) == 1


def test_read_project_and_ingest(spark, dumps):
    paths = archives.discover_archives(spark, [str(dumps)], "posts", [2025])
    rows = archives.read_archives(spark, paths, "posts", 2)
    assert rows.columns == [*schemas.POSTS.names, "source_file"] and rows.count() == 4
    assert {r["source_file"] for r in rows.select("source_file").collect()} == {"RS_2025-07.zst"}
    whitelist = lists.clean_whitelist(spark.createDataFrame([("x",), (" y ",), ("x",)], "value string"))
    kept = stages.ingest(spark, paths, "posts", whitelist, ["gpt"])
    assert sorted((r["id"], r["score"]) for r in kept.collect()) == [("p1", 1), ("p3", 7)]


@pytest.mark.parametrize("window_log", [None, 30])
def test_streaming_decoder(spark, tmp_path, window_log):
    path = tmp_path / "RS_2025-07.zst"
    write_zst(path, [post(i, title="é") for i in range(50)], window_log)
    rows = archives.read_large_window_archives(spark, [str(path)], "posts", 4)
    assert rows.count() == 50
    first = rows.filter("id = 'p7'").first()
    assert (first["title"], first["num_comments"], first["source_file"]) == ("é", 7, "RS_2025-07.zst")


def test_lenient_projection(spark):
    raw = spark.createDataFrame([("a", "12"), ("b", "bad")], "id string, score string")
    for f in schemas.COMMENTS.fields:
        if f.name not in raw.columns:
            raw = raw.withColumn(f.name, F.lit(None).cast("string"))
    rows = {r["id"]: r["score"] for r in archives.project(raw, "comments", strict=False).collect()}
    assert rows == {"a": 12, "b": None}
    with pytest.raises(Exception):
        archives.project(raw, "comments").collect()


def test_lists_from_files(spark, tmp_path):
    (tmp_path / "subs.txt").write_text("X\nx\n\n y \n")
    found = lists.load_whitelist(spark, [str(tmp_path / "absent.txt"), str(tmp_path / "subs.txt")])
    assert sorted(r[0] for r in found.collect()) == ["x", "y"]
    with pytest.raises(FileNotFoundError):
        lists.load_whitelist(spark, [str(tmp_path / "absent.txt")])
    (tmp_path / "terms.txt").write_text("AI\nml\nc++\n")
    assert lists.term_list(lists.load_terms(spark, str(tmp_path / "terms.txt"))) == ["ai", "c++"]


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", "f1"), ("b", "f1")], "id string, source_file string")
    two = spark.createDataFrame([("c", "f2")], "id string, source_file string")
    for df in (one, two, one):
        stores.append_rows(df, path)
    assert sorted(r["id"] for r in stores.read_table(spark, path).collect()) == ["a", "b", "c"]


def test_scope_store(spark, tmp_path):
    path = str(tmp_path / "words")
    rows = [("subreddit", "a/b", 0, 1, "w", 0.5), ("cluster", "3", 1, 1, "v", 0.25)]
    stores.write_scope(spark.createDataFrame(rows, schemas.TOPIC_WORDS), path)
    again = [("subreddit", "a/b", 0, 1, "new", 0.5)]
    stores.write_scope(spark.createDataFrame(again, schemas.TOPIC_WORDS), path)
    assert [r["word"] for r in stores.read_scope(spark, path, "subreddit", "a/b").collect()] == ["new"]
    assert [r["word"] for r in stores.read_scope(spark, path, "cluster", "3").collect()] == ["v"]


def test_optional_union(spark, tmp_path):
    path = str(tmp_path / "clusters")
    spark.createDataFrame([(3, 0, 10)], "cluster_id int, topic_id int, n_docs long").write.parquet(path)
    rows = stores.load_centroids(spark, [path, str(tmp_path / "absent")]).collect()
    assert [(r["scope_type"], r["scope_value"]) for r in rows] == [("cluster", "3")]
    with pytest.raises(ValueError):
        stores.load_centroids(spark, [str(tmp_path / "absent")])


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", ["a", "b"], 0.5)], "name string, words array<string>, score double")
    stores.write_report(df, str(tmp_path / "r"))
    back = stores.read_report(spark, str(tmp_path / "r"), spark.createDataFrame([], "name string, words string, score double").schema)
    assert [tuple(r) for r in back.collect()] == [("s", "a, b", 0.5)]


def test_derived_schema(spark):
    schema = schemas.with_tokens(schemas.POSTS)
    assert schema.names == [*schemas.POSTS.names, "tokens"]
    assert spark.createDataFrame([], schema).count() == 0
    assert not stores.table_exists(spark, "no_such_table")


# ---- streams ----


def test_stream_loads_each_file_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    write_zst(folder / "RS_2025-07.zst", [post(1), post(2)])
    for _ in range(2):
        ingest.run_available(ingest.stream_ingest(spark, str(folder), "posts"), out, state)
    assert spark.read.parquet(out).count() == 2
    write_zst(folder / "RS_2025-08.zst", [post(3)])
    ingest.run_available(ingest.stream_ingest(spark, str(folder), "posts", max_files=1), out, state)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["p1", "p2", "p3"]


def test_stream_filters_equal_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [post(1), post(2, "other"), post(3, title="chatgpt"), post(4, "Y"), post(1)]
    write_zst(folder / "RS_2025-07.zst", rows)
    whitelist = lists.clean_whitelist(spark.createDataFrame([("x",), ("y",)], "value string"))

    def chain(df):
        return ingest.stream_keyword_filter(ingest.stream_whitelist(df, whitelist), ["gpt"], "posts")

    stream = chain(ingest.stream_ingest(spark, str(folder), "posts"))
    ingest.stream_dedup(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = chain(spark.read.schema(schemas.POSTS).json(str(folder))).dropDuplicates(["id"])
    got = sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r["id"] for r in batch.collect()) == ["p1", "p4"]


def test_stream_dedup_across_runs_and_late_rows(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    day = 86_400
    steps = [
        [post(1), post(2)],
        [post(1), post(3, created_utc=1751328000 + day)],
        [post(5, created_utc=1751328000 + 60 * day)],
        [post(6, created_utc=1751328000 - 300 * day), post(7, created_utc=1751328000 + 61 * day)],
    ]
    for i, rows in enumerate(steps):
        write_zst(folder / f"RS_2025-{i + 1:02d}.zst", rows)
        ingest.stream_dedup(ingest.stream_ingest(spark, str(folder), "posts"), out, state)
    # every id once, late months included, and the row that came first
    rows = ingest.read_deduplicated(spark, out, schemas.POSTS).collect()
    assert sorted(r["id"] for r in rows) == ["p1", "p2", "p3", "p5", "p6", "p7"]


def test_stream_dedup_repeats_of_a_batch_change_nothing(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write_zst(folder / "RS_2025-01.zst", [post(1), post(2)])
    for state in ("a", "a", "b"):  # a lost checkpoint loads the files again as batch 0
        ingest.stream_dedup(ingest.stream_ingest(spark, str(folder), "posts"), out, str(tmp_path / state))
    assert sorted(r["id"] for r in ingest.read_deduplicated(spark, out, schemas.POSTS).collect()) == ["p1", "p2"]


def test_stream_ingest_takes_kind_years_and_roots(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two" / "deep"
    one.mkdir()
    two.mkdir(parents=True)
    write_zst(one / "RS_2025-07.zst", [post(1)])
    write_zst(one / "rs_2024-01.ZST", [post(2)])
    write_zst(one / "RC_2025-07.zst", [post(3)])
    write_zst(two / "RS_2025-08.zst", [post(4)], window_log=27)

    def ids(name, **options):
        stream = ingest.stream_ingest(spark, [str(one), str(tmp_path / "two")], "posts", **options).select("id")
        ingest.run_available(stream, str(tmp_path / name), str(tmp_path / f"{name}-state"))
        return sorted(r["id"] for r in spark.read.schema("id string").parquet(str(tmp_path / name)).collect())

    assert ids("a", years=[2025]) == ["p1", "p4"]
    assert ids("b", large_windows=True) == ["p1", "p2", "p4"]


def test_stream_dedup_opens_only_buckets_that_may_hold_its_ids(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    write_zst(folder / "RS_2025-01.zst", [post(i) for i in range(3000)])

    def load():
        ingest.stream_dedup(ingest.stream_ingest(spark, str(folder), "posts"), out, state, bucket_bytes=20_000)

    load()
    buckets = len(list((tmp_path / "out" / "_batch=0").glob("_bucket=*")))
    assert buckets >= 8
    ids = lambda values: spark.createDataFrame([(v,) for v in values], "id string")
    for i in (0, 17, 2999):  # an id that is stored: its bucket, and no other
        (name,) = ingest.files_to_open(ids([f"p{i}"]), out, 1)
        assert spark.read.parquet(name).filter(f"id = 'p{i}'").count() == 1
    opened = [len(ingest.files_to_open(ids([f"new{i}"]), out, 1)) for i in range(8)]
    assert sum(opened) <= 1  # chance hits are rare
    assert ingest.files_to_open(ids(["p1"]), out, 0) == []
    assert len(ingest.files_to_open(ids([f"p{i}" for i in range(3000)] + [None]), out, 1)) == buckets
    write_zst(folder / "RS_2025-02.zst", [post(5), post(9000), {**post(1), "id": None}])
    load()
    write_zst(folder / "RS_2025-03.zst", [post(9000), {**post(1), "id": None}, post(7)])
    load()
    rows = ingest.read_deduplicated(spark, out, schemas.POSTS).collect()
    assert sorted(r["id"] or "" for r in rows) == sorted([f"p{i}" for i in range(3000)] + ["p9000", ""])
