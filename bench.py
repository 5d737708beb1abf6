"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to the end with a no-op sink, after one warm-up read.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tellback.plans import catalog  # noqa: E402
from tellback.session import local_session  # noqa: E402

HEADLINE = [
    "page_signals",
    "page_usability",
    "page_lint",
    "site_rollup",
    "site_gap",
    "link_candidates",
    "structural_features",
    "sitemap_membership",
    "bot_access",
    "facts_block",
    "ground_truth",
    "delivery_eval_extracted",
    "delivery_eval_text",
    "missed_cause",
    "citation_match_level",
    "source_profile",
    "accuracy_score",
    "answer_summary",
    "feature_impact",
    "blockage_catalog",
    "stratified_selection",
    "step_progression",
    "stage_texts",
    "payload_grounding",
    "review_queue",
    "quota_windows",
    "text_comparable",
    "text_strip_html",
    "token_overlap",
    "category_walk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="tellback-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    names = [a for a in sys.argv[1:] if a in catalog.QUERIES] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
