"""Time headline queries on $BENCH_SF_DIR and print one JSON line.

Each query is planned and run once after a warm-up of the session, its whole result written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from crawlsift import session  # noqa: E402
from crawlsift.plans import registry  # noqa: E402

HEADLINE = [
    "site_link_profile", "page_stats", "head_meta", "links_classified", "link_counts", "image_audit", "jsonld_census", "dom_outline",
    "seo_items", "seo_summary", "seo_site_rollup", "header_checks", "header_score", "cookies_masked", "url_normalized", "ip_blocked",
    "host_admission", "redirect_chains", "asset_manifest", "asset_budget", "page_rewrite", "shared_assets", "trace_sequence",
    "trace_redacted", "net_lifecycle", "net_stats", "net_fifo_pairing", "inactivity_sessions", "rate_limit_windows", "rate_limit_stream",
    "net_lifecycle_stream", "inspection_report"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in ("site_link_profile", "net_stats", "redirect_chains"):
        run(name)
    times = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
