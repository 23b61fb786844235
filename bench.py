"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pdpspark.plans import catalog  # noqa: F401
from pdpspark.plans.registry import PLANS
from pdpspark.session import build_session

HEADLINE = [
    "page_quality", "page_urls", "page_links", "page_check", "sitemap_pick", "url_classify", "doc_lines_clean", "doc_descriptions",
    "doc_line_dedupe", "doc_signature_dupes", "doc_coverage", "doc_token_recover", "doc_typed_lines", "turn_merge", "turn_order", "sku_match",
    "row_triage", "media_keys", "resolution_upgrade", "stitch_orphans", "stack_islands", "card_rows", "feature_groups", "same_component",
    "job_view", "job_states", "activity_session", "frame_top3", "version_current", "manifest_sync", "fill_cells",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
           "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"},
    )
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
