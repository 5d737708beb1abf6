"""Text and URL expressions on hand-derived cases."""

from pyspark.sql import functions as F

from tellback.functions import text as T
from tellback.functions import urls as U
from tellback.operators import pages as P
from tellback.operators import texts as X


def one(spark, col, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()["x"]


def test_whitespace_follows_the_browser_set(spark):
    assert one(spark, T.squeeze(F.col("a")), a=" a  b \n\tc﻿ ") == "a b c"
    assert one(spark, T.word_count(F.col("a")), a="　one  two three\n") == 3
    assert one(spark, T.word_count(F.col("a")), a="") == 0


def test_entities(spark):
    assert one(spark, T.decode_basic(F.col("a")), a="&lt;b&gt; &amp;amp; &#x27;q&#39;") == "<b> &amp; 'q'"
    assert one(spark, T.decode_full(F.col("a")), a="&#8364;5 &#x41; &amp;lt; &hellip; &nope; &Middot;") == "€5 A &lt; ... &nope; ·"
    assert one(spark, T.decode_full(F.col("a")), a="&#54620;") == "한"


def test_word_boundaries_are_ascii(spark):
    assert one(spark, T.years(F.col("a")), a="2024년에 x2025 1999.") == ["2024", "1999"]
    assert one(spark, T.comparable(F.col("a")), a="회사는 (2024년) AAA.") == "회사는 2024 aaa"
    assert one(spark, T.comparable(F.col("a")), a="서울에A") == "서울A".lower()


def test_hash_wraps_like_32_bit_integers(spark):
    def expected(text):
        h = 0
        for ch in text:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h)

    for text in ("", "a", "seed", "a much longer seed value 한글"):
        assert one(spark, T.hash31(F.col("a")), a=text) == expected(text)


def test_url_resolution(spark):
    base = "https://Site.example.com:443/a/b/c?x=1#f"
    cases = {
        "/p": "https://site.example.com/p",
        "d": "https://site.example.com/a/b/d",
        "../d/./e": "https://site.example.com/a/d/e",
        "?q=2": "https://site.example.com/a/b/c?q=2",
        "//other.example/z": "https://other.example/z",
        "HTTP://Up.example:80": "http://up.example/",
        "https://h.example:8443/x#frag": "https://h.example:8443/x",
        "mailto:a@b.c": None,
        "/für x": "https://site.example.com/f%C3%BCr%20x",
        "#top": "https://site.example.com/a/b/c?x=1",
    }
    for href, wanted in cases.items():
        assert one(spark, U.resolve(F.col("b"), F.col("h")), b=base, h=href) == wanted, href


def test_dedupe_key(spark):
    cases = {
        "https://a.example/x/?utm_source=n&id=3&ref=z#f": "https://a.example/x?id=3",
        "https://a.example/": "https://a.example/",
        "https://a.example/x?gclid=1": "https://a.example/x",
        "not a url": "not a url",
    }
    for url, wanted in cases.items():
        assert one(spark, U.dedupe_key(F.col("u")), u=url) == wanted


def test_mentioned_hosts(spark):
    text = "See https://www.Shop.example.org/x, docs.example.net and v1.2.3 or info@mail.example.com."
    assert set(one(spark, U.mentioned_hosts(F.col("a")), a=text)) == {"shop.example.org", "docs.example.net", "mail.example.com"}


def test_url_policy(spark):
    cases = {
        "localhost": "blocked_host",
        "http://printer.local/x": "blocked_host",
        "http://169.254.1.1": "private_ip",
        "http://198.51.100.7/": "private_ip",
        "http://172.32.0.1": "public",
        "http://3232235777/": "private_ip",
        "http://[fe80::1]/": "private_ip",
        "https://a:b@x.example": "credentials",
        "": "empty",
        "plain.example.org": "public",
    }
    df = spark.createDataFrame([(k,) for k in cases], "input_url string")
    got = {r["input_url"]: r["reason"] for r in P.url_policy(df).collect()}
    assert got == cases


def test_client_ip(spark):
    cases = {
        'for="[2001:DB8::7]:80"': "2001:db8::7",
        "::ffff:10.0.0.1": "10.0.0.1",
        "1.2.3.4:99": "1.2.3.4",
        "unknown": None,
        "300.1.1.1": None,
    }
    for raw, wanted in cases.items():
        assert one(spark, X.client_ip(F.col("a")), a=raw) == wanted


def test_body_text_keeps_lines_on_request(spark):
    html = "<body><h1>T</h1><p>Name: A</p><p>Founded:  1999<br>Seat: B</p><script>x</script></body>"
    assert one(spark, P.body_text(F.col("a")), a=html) == "Name: A Founded: 1999 Seat: B"
    assert one(spark, P.body_text(F.col("a"), keep_lines=True), a=html) == "Name: A\nFounded: 1999\nSeat: B"


def test_entity_definition(spark):
    rows = [
        (["Nimbus"], "", "# Nimbus\n\nNimbus is a weather platform. More.", True),
        ([], "Nimbus | Home", "님버스 소개\nNimbus는 기상 분석 기업입니다.", True),
        ([], "Nimbus | Home", "Welcome to our home page.", False),
    ]
    df = spark.createDataFrame(rows, "h1_texts array<string>, title string, content string, want boolean")
    for r in P.entity_definition(df).collect():
        assert r["defines_entity"] == r["want"], r


def test_excluded_paths_are_a_parameter():
    import re

    from tellback.operators.pages import excluded_paths

    hit = lambda p: bool(re.search(excluded_paths(), p))
    assert all(map(hit, ["/diagnose", "/insights/", "/products/x", "/experiments/a/b/"]))
    assert not any(map(hit, ["/products", "/products/", "/diagnoses", "/about/products/x"]))


def test_graphs_are_read_to_any_depth(spark):
    import json

    from tellback.functions import jsonld as J

    doc = {"@type": "FAQPage", "name": "level 6"}
    for k in range(5, -1, -1):
        doc = {"@type": f"T{k}", "name": f"level {k}", "@graph": [doc] if k % 2 else [[doc], None]}
    rows = [(1, [json.dumps(doc), '{"name": "other"}']), (2, []), (3, None), (4, ["no json [", "[]", '[[{"name": "listed"}]]']), (5, ['{"@graph": {"name": "no list"}, "name": "self"}'])]
    docs = spark.createDataFrame(rows, "id int, blocks array<string>")
    names = lambda depth: {r.id: r.n for r in docs.select("id", F.transform(J.graph_and_self(F.col("blocks"), depth), lambda d: J.text(d, "$['name']")).alias("n")).collect()}
    got = names(None)
    assert got[1] == ["level 0", "other"] + [f"level {k}" for k in range(1, 7)]
    assert not got[2] and not got[3] and got[4] == ["listed"] and got[5] == ["self"]
    assert names(0)[1] == ["level 0", "other"]
    found = docs.where("id = 1").select(J.signals(F.col("blocks"), ["name"]).alias("s")).first().s
    assert "FAQPage" in found["types"] and "T5" in found["types"]
