"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import Observation
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from evitrace.plans import registry  # noqa: E402
from evitrace.session import build_session  # noqa: E402

HEADLINE = (
    "search_text", "term_stats", "posting_stats", "facet_gte", "identity_lookup", "incoming_edges",
    "edge_resolution", "impact_in", "explain", "lane_cascade", "ledger_latest", "ledger_gaps",
    "profile_distribution", "profile_key", "profile_relationship", "profile_effectivity", "profile_shape",
    "probe_distribution_suppressed", "reconcile_fields", "resolve_selection", "gap_sets",
    "feature_violations", "convergence", "html_text", "clause_candidates", "error_tiers",
    "impact_out", "section_counts", "resolve_matches", "index_search_faceted", "index_guard",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    # Intermediate tables and the stored index of this run lie in one folder of its own.
    run = tempfile.mkdtemp(prefix="evitrace-bench-")
    spark = build_session(
        "evitrace-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
           "spark.checkpoint.dir": run},
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registry.queries()
    # One untimed small run starts the JVM's and Python's workers.
    known["search_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    warm: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # The first call writes the index of the documents, the second only searches it.
    seconds["index_build_and_search"] = timed("index_search")
    seconds["index_search"] = timed("index_search")
    for name in HEADLINE:
        seconds[name] = timed(name)
    for name in ("index_search", *HEADLINE):
        seen = Observation("rows")
        start = time.perf_counter()
        known[name](spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        warm[name] = round(time.perf_counter() - start, 3)
        rows[name] = seen.get["n"]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "warm": warm, "rows": rows, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
