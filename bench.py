"""Time the headline stages on one machine; prints one JSON line.

BENCH_SF_DIR  folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
Each stage runs to a full evaluation of its result (a write without storage).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

STAGES = {
    "keyword_filter_rank": ["keyword_rank"],
    "combined_dataset": ["combined_dataset"],
    "frequency_rank": ["frequency_rank"],
    "tokenize": ["tokenize"],
    "ngram_ctfidf": ["top_words"],
    "topic_centroids": ["topic_centroids"],
    "cosine_pairs_vectors": ["cosine_pairs_vectors"],
    "network_reports": None,
    "shared_topics": ["shared_topics"],
    "density_at_eps": ["density_at_eps"],
    "density_cluster": ["density_cluster"],
    "knn_core_distance": ["knn_core_distance"],
    "stream_ingest_dedup": ["stream_keyword_filter", "stream_dedup"],
}


def run_to_end(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def network_reports(spark, sf_dir) -> None:
    """One edge list, four reports."""
    from agoraflow.catalog.fixtures import CROSS_THRESHOLD, LINK_THRESHOLD, Tables
    from agoraflow.plans.stages import network_reports as reports

    for report in reports(Tables(spark, sf_dir).edges, CROSS_THRESHOLD, LINK_THRESHOLD).values():
        run_to_end(report)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])

    from agoraflow.catalog import load_all
    from agoraflow.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    # start the JVM and the Python workers outside the timings
    queries["row_counts"](spark, sf_dir).collect()
    spark.range(100).mapInPandas(lambda batches: batches, "id long").count()

    seconds: dict[str, float] = {}
    for stage, names in STAGES.items():
        if only and stage not in only:
            continue
        start = time.perf_counter()
        if names is None:
            network_reports(spark, sf_dir)
        for name in names or ():
            run_to_end(queries[name](spark, sf_dir))
        seconds[stage] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline stages, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
