"""Token files, packing, web pages, URL rules, neighbours and the pipeline: brute force and odd tables."""

import os
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import odd_texts
from tellback.llm import html_text, neighbours, packing, queries, token_files, tokens, url_filter, util

SF = "/root/testdata/sf0.001"
TEXTS = odd_texts() + ["a <|endoftext|> b", "x<|endoftext|>y", "don't  É.\u0301 a\u0301. A|B a<b>c_d~e/f\\g@h ſ ΑΣ σ \x85 ﬁ 😀", "It's. x'''s 12.5 <|ENDOFTEXT|>"]


def documents(spark, texts=TEXTS):
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (None, "no id"), (5, "other text with the id five"), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("ids", "start", "length", "tie", "part", "block", "n_tokens", "score"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.repartition(3)


def plain_ids(text):
    from tokenizers import Tokenizer

    if "t" not in plain_ids.__dict__:
        plain_ids.t = Tokenizer.from_file(tokens.default_path())
    return np.array([*plain_ids.t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_gives_the_library_s_ids():
    ids, offsets = tokens.Encoder.of(tokens.default_path()).documents(pa.array(TEXTS), 1)
    for k, text in enumerate(TEXTS):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == plain_ids(text).tolist()
    for few in ([], [None], ["<|"]):
        ids, offsets = tokens.Encoder.of(tokens.default_path()).encode(pa.array(few, pa.string()))
        assert len(offsets) == len(few) + 1


def test_code_lengths_are_least():
    import heapq

    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 200):
        counts = (rng.pareto(1, n) * 10 + 1).astype(np.int64)
        heap, total = sorted(counts.tolist()), 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            total += a
            heapq.heappush(heap, a)
        lengths = token_files.code_lengths(counts, 30).astype(np.int64)
        assert (lengths * counts).sum() == total and (2.0**-lengths).sum() == 1
        short = token_files.code_lengths(counts, 8).astype(np.int64)
        assert short.max() <= 8 and (2.0**-short).sum() <= 1
    assert token_files.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(5), 2)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 1), (511, 9), (512, 300), (513, 40000), (5000, 40000)):
        ids = (rng.pareto(0.5, n) * 3).astype(np.int64) % top
        code = token_files.Code(token_files.code_lengths(np.bincount(ids, minlength=top)))
        raw = token_files.block_bytes(code, 3, 4, 5, np.array([9]), np.array([True]), np.array([n]), ids) + b"\n"
        both = list(token_files.blocks_of(code, raw + raw))
        assert len(both) == 2 and both[1][:3] == (3, 4, 5) and both[1][6].tolist() == ids.tolist()
        checkpoints, payload = code.encode(ids)
        for k in range(1, len(checkpoints)):  # each stretch decodes without what stands before it
            size = min(512, n - 512 * k)
            assert code.decode(payload, checkpoints[k : k + 1], size).tolist() == ids[512 * k : 512 * k + size].tolist()


def test_token_files_give_back_all_ids(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 700)
    docs = documents(spark)
    path = str(tmp_path / "files")
    got = token_files.token_files(docs, path).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    want = sorted((str(r.doc_id), len(x := plain_ids(r.text)), zlib.crc32(x.tobytes())) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    again = token_files.read(spark, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, zlib.crc32(bytes(r.ids))) for r in again) == want


def plain_cuts(place, price, width):
    best = [0] + [None] * (len(place) - 1)
    for j in range(1, len(place)):
        best[j] = min(best[i] + price[j] + width - (place[j] - place[i]) for i in range(j) if place[j] - place[i] <= width)
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(40):
        width = int(rng.integers(5, 40))
        place = np.concatenate(([0], np.cumsum(rng.integers(1, width + 1, int(rng.integers(1, 60)))))).tolist()
        price = [0, *rng.integers(0, 20, len(place) - 1).tolist()]
        chosen = packing.cuts(place, price, width)
        ends = [0, *chosen]
        cost = sum(price[j] + width - (place[j] - place[i]) for i, j in zip(ends, ends[1:]))
        assert chosen[-1] == len(place) - 1 and cost == plain_cuts(place, price, width)


@pytest.mark.parametrize("chunk, width", [(1 << 19, 2048), (3000, 100), (1, 16)])
def test_packing_keeps_each_id_once(spark, monkeypatch, chunk, width):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    docs = documents(spark)
    got = packing.packed(docs, width=width).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    for pieces in windows.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= width
    by_doc = {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for row in docs.select("doc_id", "text").collect():
        ids = plain_ids(row.text)
        pieces = by_doc[row.doc_id, len(ids)]
        spans = {(r.start, r.length) for r in pieces}
        copies = sum(r.start == 0 for r in pieces)
        assert sum(r.length for r in pieces) == copies * len(ids)
        for start, length in spans:
            assert zlib.crc32(ids[start : start + length].tobytes()) in {r.ids_crc32 for r in pieces if (r.start, r.length) == (start, length)}
    total = sum(r.length for r in got)
    assert total == sum(len(plain_ids(r.text)) for r in docs.collect())
    if width == 2048:
        assert total / (2048 * len(windows)) > 0.9


def test_empty_token_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(docs).count() == 0
    assert token_files.token_files(docs, str(tmp_path / "none")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body class="page">
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- <p>not this</p> --><div id="wrap"><div class="ad">Buy it</div><article><header><h1>Title  of\n it</h1></header><p>One <b>bo</b>ld &lt;word&gt; &eacute;&#233;&nbsp;x<br>next
<p>Second <a href="x>y">link</a><ul><li>item one<li>item two</ul><form><p>Your mail</p><input></form><div class="share">Share</div><table><tr><td>c1<td>c2</table><pre>code  here</pre></article>
<div class="comments"><p>A reader says a very long thing about this page, long enough to be dense text of its own kind.</p></div><aside>Side</aside></div>
<footer>&copy; 2024</footer></body></html>"""


def test_main_text_of_pages():
    assert html_text.main_text(PAGE) == "Title of it One bold <word> éé x next Second link item one item two c1 c2 code here"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><body></body></html>") == ""
    assert html_text.main_text("just text &amp; more") == "just text & more"
    assert html_text.main_text("<p>cut off <b>here") == "cut off here"


def test_main_text_without_marks():
    links = "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(30))
    body = "".join(f"<p>Paragraph {k} holds a good number of words so that it is dense, as text of an article is.</p>" for k in range(8))
    page = f"<body><div><ul>{links}</ul></div><div><h1>A title that belongs to it and is dense enough to stay</h1><div>{body}<p>Short.</p></div></div><div><ul>{links}</ul></div></body>"
    got = html_text.main_text(page)
    assert got.startswith("A title") and got.endswith("Short.") and "link 3" not in got and all(f"Paragraph {k} " in got for k in range(8))


def test_names_leave_out_no_article_text():
    words = "Enough words of an article to be the text of this page, told in one long sentence."
    for attributes in ('class="has-sidebar"', 'class="page with-header"', 'id="content-overlay"', 'class="sidebar"', 'class="modal"', 'title="the hidden cost"', 'data-x1="class=\'ad\'"'):
        assert html_text.main_text(f"<body><div {attributes}><p>{words}</p></div></body>") == words
        assert html_text.main_text(f"<body><div {attributes}><article><p>{words}</p></article></div><div class='comments'><p>{words * 3}</p></div></body>") == words
    inside = (
        '<div class="entry-header"><h1 id="related">Title</h1></div><section id="related-work"><h2>Related work</h2></section><section id="sharing"><p>Shared</p></section>'
        '<h2><a class="header" href="#x">Linked</a></h2><table><tr class="header"><th class="menu">Head</th></tr><tr><td class="notice">Cell</td></tr></table><p title="the hidden cost">Cost</p>'
        '<p>so <math><msup><mi>x</mi><mn>2</mn></msup><annotation>x^2</annotation></math> is</p>'
    )
    left = '<div class="box ad">Buy</div><p hidden>No</p><p hidden="hidden">No</p><span class="share">Share</span>'
    for tag in ("article", "main"):
        assert html_text.main_text(f"<body><{tag}>{inside}{left}<p>{words}</p></{tag}></body>") == f"Title Related work Shared Linked Head Cell Cost so x2 is {words}"
    assert html_text.main_text(f"<body><article><div class='widget'><p>{words}</p></div><p>End.</p></article></body>") == f"{words} End."
    assert html_text.main_text(f"<body><form><div><p>{words}</p></div></form></body>") == words


def test_broken_pages_end_soon():
    import time

    start = time.time()
    for page in ("<div>" * 200000 + "x", "<p><script" * 100000, '<h1 "' * 100000, "<b>" * 50000 + "<li>x" * 50000, "<!--" * 100000, "</div>" * 100000 + "x", "&amp" * 200000, "<table><tr><td>" * 50000):
        html_text.main_text(page)
    assert time.time() - start < 60


def test_pages_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "<p>é word</p>" * 20000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = html_text.extracted_pages(pages).collect()
    size = len(html_text.main_text(PAGE))
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, size), (1, size), (2, 0), (3, 7 * 20000 - 1)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extracted_pages(pages.limit(0)).count() == 0


RULES = [("NET", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("a.org", None, "allow"), (None, "/", "block"), ("", "/x", "block"), ("b.org", "/ab", "block")]


def plain_verdict(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?", 1)[0].split("#", 1)[0]
    fits = []
    for h, p, a in sorted(((h or "").lower(), p or "", a) for h, p, a in RULES):
        if h and (host == h or host.endswith("." + h)) and path.startswith(p) and (h, p) not in [f[3] for f in fits]:
            fits.append((len(h) + len(p), len(h), h + p, (h, p), a))
    best = max(fits, default=None)
    return host, path, best and best[2], best[4] if best else "allow"


URLS = ["http://x.example.net/en/1", "HTTP://EXAMPLE.net/EN/1", "https://example.net/en/", "https://net/", "https://internet/", "http://a.b.org/fr/x?y#z", "http://org/fr", "a://b://net/", None, "", "no scheme/x", "://net/", "http://", "http://net", "http://net?x=/", "http://net#/",
        "http://a.org?x", "http://z.a.org/fr/1", "http://b.org/abc", "http://É.net/é", "http://user@a.example.com:80/de/", "http://a.example.com/de/x", "http://" + "a." * 300 + "net/" + "p/" * 3000, "http://line\nbreak.net/\n/x", "http://..net/", "http://.net/"]


@pytest.mark.parametrize("most", [None, 0])
def test_url_rules(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", most)
    rows = [(k, u) for k, u in enumerate(URLS)] + [(3, URLS[3]), (3, URLS[3]), (None, URLS[0])] + [(100 + k, "http://hot.net/") for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("id", F.lit(0))
    rules = spark.createDataFrame(RULES, "host string, path string, action string").withColumn("key", F.lit("clash"))
    got = sorted(map(str, map(tuple, url_filter.filtered(pages, rules).collect())))
    assert got == sorted(str((i, *plain_verdict(u))) for i, u in rows)


def test_url_rules_of_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert [tuple(r) for r in url_filter.filtered(pages, rules).collect()] == [(1, "net", "/", None, "allow")]
    assert url_filter.filtered(pages.limit(0), rules).count() == 0


def test_bloom_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    keys, others = rng.integers(-(2**62), 2**62, 20000), rng.integers(-(2**62), 2**62, 20000)
    bloom = url_filter.BlockedBloom(20000 * 16 // 512)
    bloom.add(keys)
    assert bloom.may_have(keys).all() and bloom.may_have(others).mean() < 0.02


def plain_nearest(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    return {i: sorted(((-float((v * q).sum()), j) for j, v in good.items() if j != i))[:k] for i, q in good.items() if i % 20 == 0}


def test_neighbours_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 30)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    monkeypatch.setattr(neighbours, "PROBED", 1.0)
    rng = np.random.default_rng(4)
    rows = [(k, np.round(rng.standard_normal(8), 1).tolist()) for k in range(1, 300)]
    rows += [(k, [1.0] + [0.0] * 7) for k in range(300, 420)]  # one frequent vector
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [float("inf")] + [1.0] * 7), (1080, [None] + [1.0] * 7), (1100, [1.0] * 5), (None, [1.0] * 8), (1120, [])]
    rows += [rows[10], rows[10]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("list", F.lit(1)).repartition(4)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = plain_nearest(rows, 20)
    got = {}
    for r in neighbours.searched(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(got) == set(want)
    for q in want:
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]])
        assert [j for _, j in got[q]] == [j for _, j in want[q]] or len({round(s, 9) for s, _ in want[q]}) < 20
    ties = [j for s, j in got[300] if s == -1.0]
    assert ties == sorted(ties)


def test_all_copies_of_a_unit_vector_are_candidates(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PROBED", 1.0)
    rng = np.random.default_rng(9)
    unit = rng.standard_normal((1204, 64))
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    ids = rng.permutation(2104)
    rows = [(int(i), unit[min(k // 300, 3) if k < 1200 else k - 900].tolist()) for k, i in enumerate(ids)]  # four vectors 300 times
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = [int(i) for k, i in enumerate(ids) if k < 1200 and k % 30 == 0]
    got = {}
    for r in neighbours.searched(vectors, vectors.where(F.col("vec_id").isin(asked))).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    places = {int(i): k for k, i in enumerate(ids)}
    for q in asked:
        group = places[q] // 300
        assert got[q] == [i for i in sorted(int(j) for j in ids[group * 300 : group * 300 + 300]) if i != q][:20]
    assert len(got) == len(asked)


def test_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [0.0, 1.0])], kind)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.searched(few, few.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    for rows in ([], [(0, [0.0, 0.0])], [(0, [1.0])]):
        frame = spark.createDataFrame(rows, kind)
        assert neighbours.searched(frame, frame).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_recall_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 25)  # as many lists as a table of 40,000 vectors has
    got = queries.QUERIES["op7_nearest_neighbours"](spark, SF.replace("0.001", "0.01")).collect()
    data = spark.read.parquet(SF.replace("0.001", "0.01") + "/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, all_ = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], np.float64)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in found:
        score = all_ @ all_[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(found[q] & set(ids[np.lexsort((ids, -score))[:20]]))
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.ORACLES[name])
    cols = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, found.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.collect()}
        docs = util.stored(stage(spark, docs, SF), name)
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and after <= before and len(after) > len(before) / 2
        if name == "near_duplicates":
            from helpers import similar_groups

            want = similar_groups([(i, i, texts[i]) for i in before])
            assert after == {i for i in before if want[i][1] == i}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    left = {r.doc_id: len(plain_ids(r.text)) for r in docs.collect()}
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == left


def test_stages_take_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "some words", "en", "s", 0), (3, "the same words here again", "en", "s", 0), (3, "the same words here again", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("node", F.lit("extra"))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            assert out.count() <= docs.count() and (name == "packing" or out.columns == docs.columns)
    once = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in once) == ["1", "2", "3", "None"]
