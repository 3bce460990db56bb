"""Time the headline queries on the given tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from noteloom.checks import registry
from noteloom.runtime import local_session

HEADLINE = (
    "chunk_fixed chunk_documents tokenize tfidf_search vector_topk rrf_hybrid search proximity_rerank incremental_index "
    "link_score diff_lines debounce_changes sse_reassemble embed_chunks pack_linked_notes list_notes"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    queries = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the session before the clock runs
    seconds, first_run = {}, {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(2):  # the first run also compiles: both are reported, the second is the query's time
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - start, 3))
        first_run[name], seconds[name] = runs
    print(
        json.dumps(
            {
                "metric": "total_wall_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first_run,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
