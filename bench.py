"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "semantic_chunks",
    "semantic_search",
    "fulltext_rank",
    "fulltext_norwegian",
    "trigram_title_similarity",
    "hybrid_best_hits",
    "fuzzy_search",
    "hybrid_search",
    "redacted_documents",
    "fixed_size_windows",
    "document_chunks",
    "heading_paths",
    "turn_usage",
    "session_usage",
    "activity_sessions",
    "chat_history",
    "layer_upsert",
    "latest_row_wins",
    "claimed_files",
    "projection_to_metres",
    "point_in_polygon",
    "distance_join",
    "buffer_search",
    "nearest_seed",
    "feature_pixel_extents",
    "tile_cover",
]


def main() -> None:
    from fjelldoc.plans.catalogue import bound_queries
    from fjelldoc.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    queries = bound_queries()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
