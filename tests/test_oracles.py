"""Spark results against the oracle SQL in DuckDB.

A cross-section by default; set TELLBACK_ALL=1 for every registered query.
"""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tellback.plans import catalog
from tellback.plans.fixtures import TABLES

SF = os.environ.get("TELLBACK_SF", "/root/testdata/sf0.001")
SAMPLE = [
    "page_signals", "link_candidates", "url_policy", "robots_rules", "sitemap_membership", "page_lint", "site_gap",
    "promoted_snippets", "facts_block", "ground_truth", "ground_truth_infobox", "delivery_eval_extracted",
    "delivery_eval_text", "subpage_reach", "feature_impact", "blockage_catalog", "stratified_selection", "category_walk", "category_walk_any_depth",
    "best_step", "stage_texts", "site_signal_merge", "site_headings", "new_headings", "latest_log_per_url", "log_stream_latest", "log_stream_stats",
    "sink_site_logs", "sitemap_stats", "sitemap_locs", "held_hints", "fact_check", "delivery_comparison", "source_profile", "answer_summary", "query_plan", "payload_citations", "review_queue",
    "lead_cleanse", "redact_logs", "quota_windows", "quota_windows_stream", "freshness_reuse", "freshness_reuse_stream", "incremental_ingest",
    "sink_batch_snapshots", "decode_charset",
]


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def names():
    if os.environ.get("TELLBACK_ALL") == "1":
        return sorted(catalog.QUERIES)
    return SAMPLE


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", names())
def test_query_matches_oracle(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    left = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(entry_module.oracle_sql()[name])
    found = [d[0] for d in cur.description]
    assert sorted(found) == cols
    right = sorted((tuple(plain(dict(zip(found, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert left == right


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(entry_module.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:2] == ["host", "pages"] and df.count() > 0
