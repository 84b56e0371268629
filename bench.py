"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Each query
runs to a sink that discards rows, so what is timed is the whole result.
"""

from __future__ import annotations

import json
import os
import time

from pagemill import build_session
from pagemill.plans.queries import QUERIES

HEADLINE = [
    "chunk_rows",
    "chunk_rows_small",
    "chunk_blocks",
    "split_long",
    "merge_short",
    "dedup_chunks",
    "chunk_summary",
    "ingest_files",
    "md_blocks",
    "split_paragraphs",
    "sanitize_text",
    "decode_text_files",
    "is_noise",
    "page_blocks",
    "page_summary",
    "hf_regions",
    "hf_warnings",
    "catalog_search",
    "keyset_page",
    "sorted_listing",
    "catalog_totals",
    "count_by_status",
    "get_by_ids",
    "insert_if_absent",
    "cascade_delete",
    "check_unique",
    "check_fk",
    "check_domain",
    "hot_top_n",
    "recent_access",
    "session_timeout",
    "build_conversation",
    "parse_response",
    "output_metrics",
    "run_experiment",
    "cosine_top_k",
    "cosine_top_k_batch",
    "hot_stream",
    "ingest_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=partitions,
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("chunk_rows")  # starts the engine
    seconds = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    chunks = QUERIES["chunk_rows"](spark, folder).count()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "chunks_per_second": round(chunks / seconds["chunk_rows"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
