"""Time the headline queries and print one JSON line.

Each query runs once to warm up and once for the clock, and its whole result is
written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordweave import plans
from recordweave.session import local_session

HEADLINE = [
    "convergence_edges", "co_pairs", "funding_edges", "edge_scd2", "graph_edges_all",
    "resolve_identifier", "trigram_candidates", "resolve_bulk", "gazetteer_links", "theme_tags",
    "materiality", "title_dedupe", "select_floors", "overflow_wire", "vector_topk",
    "claims", "publish_verdict", "entity_360", "brief_assembled",
    "src_awards", "dedup_new", "merge_native", "enrich_join", "retention_prune",
    "health_findings", "theme_momentum", "failure_streak", "quality_report",
    "stream_dedup", "stream_theme_volume",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    plans.load_all()
    spark = local_session(cpus, "bench", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names.split(",") if names else HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
             "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
