"""Robots groups, quota windows against brute force, statistics, sources and sinks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tellback.operators import benchmark as A
from tellback.operators import experiment as E
from tellback.operators import pages as P
from tellback.operators import sites as S
from tellback.sources import charset as CH
from tellback.sources import sinks as K
from tellback.sources import tables as ST
from tellback.streaming import quota as Q


def test_robots_groups(spark):
    body = (
        "User-agent: *\nDisallow: /\n# comment keeps the group\nAllow: /\n\n"
        "user-agent: GPTBot\nUser-Agent: ClaudeBot\nDisallow: /*\n\nDisallow: /orphan\nUser-agent: PerplexityBot\nDisallow:\n"
    )
    robots = spark.createDataFrame([("h", body)], "host string, body string")
    rules = {(r["agent"], r["directive"], r["path"]) for r in S.robots_rules(robots).collect()}
    assert ("GPTBot", "disallow", "/*") in rules and ("ClaudeBot", "disallow", "/*") in rules
    assert not any(p == "/orphan" for _, _, p in rules)
    sites = spark.createDataFrame([("h",), ("none",)], "host string")
    got = {(r["host"], r["bot"]): r["access"] for r in S.bot_access(sites, S.robots_rules(robots)).collect()}
    assert got[("h", "GPTBot")] == "disallow"
    assert got[("h", "PerplexityBot")] == "allow"
    assert got[("h", "ChatGPT-User")] == "allow"
    assert got[("none", "GPTBot")] == "unknown"


def brute_windows(rows, length):
    out, state = {}, {}
    for key, ident, ms in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        count, reset = state.get(key, (0, -1))
        if count == 0 or reset <= ms:
            count, reset = 0, ms + length
        state[key] = (count + 1, reset)
        out[(key, ident)] = (count + 1, reset)
    return out


def test_quota_windows_match_brute_force_with_a_hot_key(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{rng.randrange(9)}", i, rng.randrange(0, 400_000)) for i in range(4000)]
    rows += [("edge", 10_000 + i, t) for i, t in enumerate((0, 999, 1000, 1000, 1999, 5000))]
    df = spark.createDataFrame(rows, "key string, event_id long, ms long").repartition(6)
    wanted = brute_windows(rows, 1000)
    got = Q.quota_windows(df, 1000, 2, "event_id").collect()
    assert len(got) == len(rows)
    for r in got:
        nth, reset = wanted[(r["key"], r["event_id"])]
        assert (r["request_no"], r["allowed"]) == (nth, nth <= 2)


def test_correlation_edge_cases(spark):
    rows = [("same", float(i), 2.0 * i) for i in range(5)] + [("flat", 1.0, float(i)) for i in range(5)]
    rows += [("few", 1.0, 2.0), ("few", 2.0, 1.0)]
    r, p = A.correlation("x", "y")
    got = {
        row["k"]: (row["r"], row["p"])
        for row in spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(r.alias("r"), p.alias("p")).collect()
    }
    assert got["same"][0] == 1.0 and got["same"][1] < 1e-6
    assert got["flat"] == (0.0, 1.0) and got["few"] == (0.0, 1.0)


def test_normal_cdf(spark):
    for x in (-2.0, 0.0, 0.5, 1.96):
        value = spark.range(1).select(A.normal_cdf(F.lit(x)).alias("v")).first()["v"]
        assert value == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=2e-7)


def test_topic_particle(spark):
    for name, particle in (("한국", "은"), ("로보", "는"), ("Acme", "는")):
        got = spark.createDataFrame([(name,)], "n string").select(E.topic_particle(F.col("n")).alias("p")).first()["p"]
        assert got == particle


def test_link_rewrite_is_sequential(spark):
    df = spark.createDataFrame([("the sea of the north", ["the", "sea of", "the", "1", "42", "of the"])], "text string, anchors array<string>")
    made, applied = E.rewrite_links(F.col("text"))
    got = df.select(made.alias("t"), applied.alias("a")).first()
    # longest first: 'sea of' is wrapped, so 'of the' no longer occurs; 'the' wraps its first place
    assert got["t"] == "[[the]] [[sea of]] the north" and got["a"]


def test_charsets(spark):
    body = '<meta charset="EUC-KR"><p>한글</p>'.encode("cp949")
    latin = "<p>café ’</p>".encode("cp1252")
    df = spark.createDataFrame([("text/html", body), ("text/html; charset=ISO-8859-1", latin)], "ct string, body binary")
    df = df.withColumn("cs", CH.detect_charset(F.col("ct"), F.col("body")))
    got = df.select("cs", CH.decode_bytes("body", "cs").alias("t")).collect()
    assert got[0]["cs"] == "euc-kr" and "한글" in got[0]["t"]
    assert got[1]["t"] == "<p>café ’</p>"


def test_row_numbers_across_partitions(spark, tmp_path):
    df = spark.range(0, 1000).withColumn("x", F.rand(1)).repartition(7)
    rows = K.number_rows(df, "id", str(tmp_path)).select("id", "row_no").collect()
    assert sorted((r["id"], r["row_no"]) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_absent_artifact_is_empty(spark, tmp_path):
    df = ST.json_artifact(spark, str(tmp_path / "none"), "a long, b string")
    assert df.columns == ["a", "b"] and df.count() == 0


def test_site_roles_with_a_hot_site(spark):
    rows = [(i, "hot.example" if i % 3 == 0 else f"s{i % 50}.example", f"https://x.example/{'about' if i % 7 == 0 else 'p'}{i}", i % 5 != 0) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, host string, url string, usable boolean").repartition(5)
    got = S.bundle_roles(df, extras=2).collect()
    every = S.bundle_roles(df)
    assert every.count() == sum(r[3] for r in rows) + sum(not next(r for r in rows if r[1] == h)[3] for h in {r[1] for r in rows})
    per = {}
    for r in got:
        per.setdefault(r["host"], []).append(r)
    for host, roles in per.items():
        own = [r for r in rows if r[1] == host]
        assert [r["page_id"] for r in roles if r["role"] == "main"] == [min(r[0] for r in own)]
        assert len(roles) <= 3
        for r in roles:
            if r["role"] == "extra":
                assert next(x for x in own if x[0] == r["page_id"])[3]


def test_every_page_of_a_site_counts(spark):
    """Fifty pages of one site: no page, heading or sentence is left out."""
    said = lambda k: f"The profile of number {k} is described in a sentence that is long enough to be of use to readers."
    rows = [
        (k, "a.example", f"https://a.example/p{k}", True, "t", 1, 0, 0, 0, k == 30, False, ["Top"], [f"Head {j}" for j in range(25)] + [f"Own {k}"], said(k) + " " + said(k + 100))
        for k in range(50)
    ]
    columns = "page_id long, host string, url string, usable boolean, title string, list_items long, tables long, images long, images_without_alt long, has_jsonld boolean, has_og boolean, h1_texts array<string>, h2_texts array<string>, content string"
    pages = S.site_pages(spark.createDataFrame(rows, columns).repartition(4))
    merged = S.site_signal_merge(pages).first()
    assert (merged.page_count, merged.list_items, merged.h1_count, merged.h2_count) == (50, 50, 1, 75) and "h2_texts" not in merged
    first = S.site_signal_merge(pages, headings=10).first()
    assert first.h1_texts == ["Top"] and first.h2_texts == [f"Head {j}" for j in range(10)] and first.h2_count == 75
    gap = S.site_gap(pages).first()
    assert (gap.extra_pages, gap.new_heading_count, gap.added_jsonld) == (49, 49, True)
    assert S.new_headings(pages).count() == 49 and S.new_headings(pages, limit=8).count() == 8
    assert S.promoted_snippets(pages).count() == 98 and S.promoted_snippets(pages, per_page=1, per_site=4).count() == 4


def quota_case():
    import random

    rnd, day = random.Random(1), 86_400_000
    rows = [("hot", i, rnd.randrange(0, 9 * day)) for i in range(100_000)] + [("hot", 100_000 + i, 40 * day + rnd.randrange(0, 2 * day)) for i in range(2000)]
    rows += [(f"k{i % 7}", 200_000 + i, rnd.randrange(0, 100 * day)) for i in range(200)] + [("t", 300_000 + i, 5 * day) for i in range(5)]
    rows += [("t", 310_000, 6 * day - 1), ("t", 310_001, 6 * day), ("t", 310_002, 7 * day - 1), ("t", 310_003, 7 * day)]
    rnd.shuffle(rows)
    want, state = {}, {}
    for k, i, ms in sorted(rows, key=lambda e: (e[0], e[2], e[1])):
        count, reset = state.get(k, (0, 0))
        if count == 0 or reset <= ms:
            count, reset = 0, ms + day
        count += 1
        state[k] = (count, reset)
        want[i] = (k, count, count <= 2, max(2 - count, 0), -(-(reset - ms) // 1000))
    return rows, want, day


def test_quota_of_a_hot_key_in_small_arrow_batches(spark, tmp_path):
    from tellback.streaming import jobs as J
    from tellback.streaming import quota as Q

    rows, want, day = quota_case()
    asked = spark.createDataFrame(rows, "key string, event_id long, ms long").repartition(5)
    decided = lambda df: {r.event_id: (r.key, r.request_no, r.allowed, r.remaining, r.reset_seconds) for r in df.collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert decided(Q.quota_windows(asked, day, 2, "event_id")) == want
        asked.coalesce(1).write.parquet(f"{tmp_path}/in")
        for late in (None, "1 hour"):
            stream = J.file_stream(spark, f"{tmp_path}/in", asked.schema, "parquet")
            J.keep_table(Q.quota_stream(stream, day, 2, "event_id", late), f"{tmp_path}/o{late}", f"{tmp_path}/c{late}").awaitTermination()
            assert decided(spark.read.parquet(f"{tmp_path}/o{late}")) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_all_headings_of_a_site_are_rows(spark):
    rows = [(k, "a.example", f"https://a.example/p{k}", True, ["Top"], [f"Head {j}" for j in range(25)] + [f"Own {k}"]) for k in range(50)]
    pages = S.site_pages(spark.createDataFrame(rows, "page_id long, host string, url string, usable boolean, h1_texts array<string>, h2_texts array<string>").repartition(4))
    got = sorted((r.host, r.kind, r.n, r.heading) for r in S.site_headings(pages).collect())
    assert got[0] == ("a.example", "h1", 1, "Top") and [(r[1], r[2]) for r in got[1:]] == [("h2", n) for n in range(1, 76)]
    assert [r[3] for r in got[1:26]] == [f"Head {j}" for j in range(25)] and {r[3] for r in got[26:]} == {f"Own {k}" for k in range(50)}
    assert S.site_headings(pages, limit=3).count() == 4


def test_merged_sites_list_all_headings(spark):
    from tellback.plans import catalog

    rows = [
        (k, "a.example" if k < 40 else "b.example", f"https://a.example/p{k}", True, "t", 1, 0, 0, 0, False, False, ["Top"], [f"Head {j}" for j in range(25)] + [f"Own {k}"] if k < 40 else [], "words")
        for k in range(41)
    ]
    columns = "page_id long, host string, url string, usable boolean, title string, list_items long, tables long, images long, images_without_alt long, has_jsonld boolean, has_og boolean, h1_texts array<string>, h2_texts array<string>, content string"
    pages = S.site_pages(spark.createDataFrame(rows, columns).repartition(4))
    got = {r.host: r for r in S.site_signal_merge(pages, lists=True).collect()}
    by_place = {(r.kind, r.n): r.heading for r in S.site_headings(pages).filter("host = 'a.example'").collect()}
    assert got["a.example"].h1_texts == ["Top"] and got["a.example"].h2_texts == [by_place["h2", n] for n in range(1, 66)]
    assert (got["b.example"].h1_texts, got["b.example"].h2_texts, got["b.example"].h2_count) == (["Top"], [], 0)
    # the query has them whole, and so has its SQL
    assert "h1_u[" not in catalog.ORACLES["site_signal_merge"] and "AS h2_texts, words" in catalog.ORACLES["site_signal_merge"]


def test_merging_a_site_reads_its_pages_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    columns = "page_id long, host string, url string, usable boolean, title string, list_items long, tables long, images long, images_without_alt long, has_jsonld boolean, has_og boolean, h1_texts array<string>, h2_texts array<string>, content string"
    rows = [(k, "a.example", f"https://a.example/p{k}", True, "t", 1, 0, 0, 0, False, False, ["Top"], [f"Own {k}"], "words") for k in range(50)]
    pages = S.site_pages(spark.createDataFrame(rows, columns).mapInPandas(counted, columns))
    before = read.value  # main pages are found by a read of their own
    assert S.site_signal_merge(pages, lists=True).first().h2_count == 50
    assert read.value - before == 50


def test_lint_needs_its_columns_only(spark):
    html = "<html><head><title>A is</title></head><body><h1>A</h1><h2>FAQ</h2><p>A is a robotics company. It sells things.</p></body></html>"
    pages = spark.createDataFrame([(1, "a.example", "https://a.example/ai-profile", html)], "page_id long, host string, url string, html string")
    inputs = S.lint_inputs(P.page_signals(pages))
    bots = spark.createDataFrame([("a.example", 1)], "host string, bots_denied long")
    checks = lambda df: sorted(tuple(r) for r in S.page_lint(df, bots).collect())
    assert checks(inputs.select("page_id", "host", "url", *S.LINT_COLUMNS)) == checks(inputs)
