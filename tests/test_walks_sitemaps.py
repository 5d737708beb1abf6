"""Walks to any depth, and sitemap files as rows."""

import gzip
import os
import random

from tellback.operators import benchmark as A
from tellback.operators import sites as S
from tellback.operators import walks as W
from tellback.sources import sitemaps as SM


def brute(edges, seeds):
    out = {}
    for seed in seeds:
        level, depth = {seed}, 0
        while level:
            for x in level:
                out[seed, x] = depth
            depth += 1
            level = {c for p, c in edges if p in level and (seed, c) not in out}
    return out


def test_walks_end_on_cycles_and_keep_the_smallest_depth(spark):
    rnd = random.Random(3)
    edges = [(f"a{k}", f"a{k + 1}") for k in range(25)] + [("a25", "a3"), ("a9", "a0"), ("self", "self")]
    edges += [(f"b{rnd.randrange(40)}", f"b{rnd.randrange(40)}") for _ in range(90)] + [("a0", f"hub{k}") for k in range(300)]
    seeds = ["a0", "a7", "b1", "b2", "self", "nowhere"]
    df = spark.createDataFrame(edges + edges[:50], "parent string, child string")
    from_seeds = spark.createDataFrame([(s,) for s in seeds] + [("a0",)], "seed string")
    want = brute(edges, seeds)
    assert {(r.seed, r.node): r.depth for r in W.reached(df, from_seeds).collect()} == want
    assert W.reached(df, from_seeds).count() == len(want)
    assert {(r.seed, r.node): r.depth for r in W.reached(df, from_seeds, 3).collect()} == {k: d for k, d in want.items() if d <= 3}
    assert W.reached(df, from_seeds.limit(0)).count() == 0 and W.reached(df.limit(0), from_seeds).count() == len(seeds)


def test_category_pages_of_any_depth(spark):
    edges = [(f"c{k}", f"c{k + 1}", "category") for k in range(12)] + [("c12", "c0", "category")] + [(f"c{k}", f"Page {k % 7}", "page") for k in range(13)]
    df, seeds = spark.createDataFrame(edges, "parent string, child string, kind string"), spark.createDataFrame([("c5",)], "seed string")
    got = {r.title: r.depth for r in A.category_walk(df, seeds, max_depth=None).collect()}
    want = {}
    for step in range(13):
        want.setdefault(f"Page {(5 + step) % 13 % 7}", step)
    assert got == want
    assert {r.title for r in A.category_walk(df, seeds).collect()} == {"Page 5", "Page 6", "Page 0"}
    assert A.category_walk(df, seeds, max_depth=None, per_seed=4).count() == 4


def put(root, url, body, zipped=False):
    folder = f"{root}/sitemap_url={url.replace(':', '%3A').replace('/', '%2F')}"
    os.makedirs(folder, exist_ok=True)
    with (gzip.open(f"{folder}/body.xml.gz", "wt") if zipped else open(f"{folder}/body.xml", "w")) as out:
        out.write(body)


def test_entries_come_from_byte_ranges(spark, tmp_path):
    """A large body is read by many tasks, and no entry is lost or doubled where it is cut."""
    every = [f"https://big.example/p{k}?a=1&amp;b={'x' * (k % 90)}" for k in range(20_000)]
    put(tmp_path, "https://big.example/sitemap.xml", "<?xml version='1.0'?>\n<urlset>" + "".join(f"<url>\n  <loc> {u} </loc><lastmod>2024-01-01</lastmod></url>" for u in every) + "<url></url></urlset>")
    put(tmp_path, "https://z.example/sitemap.xml.gz", "<URLSET><URL><LOC>https://z.example/upper</LOC></URL><url><loc>https://z.example/1</loc></url></URLSET>".replace("LOC", "loc"), True)
    put(tmp_path, "https://i.example/sitemap.xml", "<sitemapindex><sitemap><loc>https://i.example/a.xml</loc></sitemap></sitemapindex>")
    put(tmp_path, "https://n.example/sitemap.xml", "<html>no map</html>")
    put(tmp_path, "https://e.example/sitemap.xml", "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = SM.sitemap_entries(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 8
        big = rows.where("sitemap_url like '%big%'")
        assert sorted(r["loc"] for r in big.where("loc is not null").collect()) == sorted(u.replace("&amp;", "&") for u in every)
        picked = spark.createDataFrame([("big", "https://big.example/sitemap.xml"), ("i", "https://i.example/sitemap.xml"), ("n", "https://n.example/sitemap.xml"), ("e", "https://e.example/sitemap.xml"), ("z", "https://z.example/sitemap.xml.gz")], "host string, sitemap_url string")
        got = {r.host: (r.sitemap_format, r.url_count, r.sitemap_count, r.loc_count, r.sitemap_exists) for r in S.sitemap_stats(picked, rows).collect()}
        assert got == {"big": ("urlset", 20_001, 0, 20_000, True), "i": ("index", 0, 1, 1, True), "n": ("unknown", 0, 0, 0, False), "e": ("unknown", 0, 0, 0, False), "z": ("urlset", 2, 0, 2, True)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_indexes_are_followed(spark, tmp_path):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>https://a.example/{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    put(tmp_path, "https://a.example/sitemap.xml", index("one.xml", "two.xml", "gone.xml"))
    put(tmp_path, "https://a.example/two.xml", index("three.xml", "sitemap.xml", "one.xml"))
    put(tmp_path, "https://a.example/three.xml", "<urlset><url><loc>https://a.example/x</loc></url></urlset>", True)
    lines = [("https://a.example/one.xml", f"<url><loc>https://a.example/p{k}</loc></url>") for k in range(50)]
    SM.write_sitemaps(spark.createDataFrame(lines, "sitemap_url string, line string").repartition(3), str(tmp_path))
    entries = SM.sitemap_entries(spark, str(tmp_path))
    picked = spark.createDataFrame([("a.example", "https://a.example/sitemap.xml"), ("b.example", "https://b.example/none.xml")], "host string, sitemap_url string")
    got = sorted((r["host"], r["loc"]) for r in S.sitemap_locs(entries, picked).collect())
    assert got == sorted([("a.example", "https://a.example/x")] + [("a.example", f"https://a.example/p{k}") for k in range(50)])
    pages = spark.createDataFrame([(1, "https://a.example/p7", "a.example"), (2, "https://a.example/q", "a.example")], "page_id long, url string, host string")
    seen = {r.page_id: (r.lists_url, r.lists_path) for r in S.sitemap_membership(pages, S.sitemap_locs(entries, picked)).collect()}
    assert seen == {1: (True, True), 2: (False, False)}
