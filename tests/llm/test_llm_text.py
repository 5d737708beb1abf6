"""Shingle groups, language, quality, benchmark leaks, licences: brute force and odd tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import odd_texts, shingles, similar_groups
from tellback.llm import decontaminate, language_id, licenses, ngram_join, quality, util

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, lang=None):
    """Documents with extra columns whose names clash with those of results."""
    rows = [(k, t, (lang or (lambda t: "en"))(t), "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, "no id here at all", "en", "s", 1), (3, texts[3], "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "n_shingles", "component_id", "node", "held_out", "language", "leaks", "id", "key", "x"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs.repartition(5)


def test_words_end_at_ascii_blanks_only():
    texts = pa.array(["A b c\x1cd\ne", None, "", "a b\x0bc", "a b"])
    got = util.shingle_sets(texts, 2)
    assert [len(s) for s in got] == [len(shingles(t, 2)) for t in texts.to_pylist()]
    assert got[3][0] in got[4] or got[3][1] in got[4]


def test_similar_groups_match_brute_force(spark):
    texts = odd_texts()
    docs = frame(spark, texts)
    got = ngram_join.similar_groups(docs).collect()
    rows = [(k, t, t) for k, t in enumerate(texts)]
    want = similar_groups([(k, k, texts[k]) for k, _, _ in rows])
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], texts[r.doc_id]
        else:
            assert r.component_id is None


@pytest.mark.parametrize("few, block", [(2, 2), (3, 7)])
def test_large_cells_lose_no_link(spark, monkeypatch, few, block):
    """A passage in all documents, chains of near copies, and cells that count as large from two or three nodes on."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdef", k=6))
    passage, texts = [word() for _ in range(60)], []
    for size in (10, 30, 45, 100):
        for _ in range(12):
            texts.append(" ".join(passage + [word() for _ in range(size)]))
    chain = [word() for _ in range(150)]
    for _ in range(15):
        chain = chain[7:] + [word() for _ in range(7)]
        texts.append(" ".join(chain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = similar_groups([(k, k, t) for k, t in enumerate(texts)])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()} == want
    assert len({c for _, c in want.values()}) < len(texts) - 10


def test_two_thousand_near_copies_of_one_text(spark):
    """Most pairs differ by more than a link allows; the group still comes out whole, and others beside it."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(110)]
    texts = []
    for k in range(2000):
        words = base[:]
        for _ in range(rnd.randint(1, 3) if k % 50 else 12):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [util.shingle_sets(pa.array([t]), 5)[0] for t in texts]
    every, place = util.np.unique(util.np.concatenate(sets), return_inverse=True)
    member = util.np.zeros((len(sets), len(every)), util.np.float32)
    sizes = util.np.array([len(s) for s in sets])
    member[util.np.repeat(util.np.arange(len(sets)), sizes), place.ravel()] = 1
    both = member @ member.T
    near = 100 * both >= 75 * (sizes[:, None] + sizes - both)
    low = util.np.arange(len(sets))
    while True:
        now = util.np.array([low[row].min() for row in near])
        now = now[now]
        if (now == low).all():
            break
        low = now
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == {k: (int(sizes[k]), int(low[k])) for k in range(len(texts))}
    assert near.mean() < 0.8 and 1 < len(set(low.tolist())) < 60


def test_nodes_of_large_cells_are_one_row_each(spark, monkeypatch):
    """Whether cells are done and which hang together is found from a row for each node, not for each (cell, node)."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdef", k=6))
    base, texts = [word() for _ in range(56)], []
    for _ in range(120):
        words = base[:]
        for at in rnd.sample(range(56), 2):
            words[at] = word()
        texts.append(" ".join(words))
    counts, stored = {}, util.stored

    def spy(df, name):
        out = stored(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(util, "stored", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == similar_groups([(k, k, t) for k, t in enumerate(texts)])
    assert 50 < max(counts["open"]) <= len(texts) and max(counts.get("first", [0])) <= len(texts)


def test_blocks_that_cannot_link_are_not_paired(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rnd = random.Random(5)
    rows = [(k % 2, k, k, rnd.choice([8, 9, 10, 13, 30, 31, 44, 90])) for k in range(1, 120)]
    blocks, pairs = ngram_join._block_pairs(spark.createDataFrame(rows, "cluster long, node long, root long, n long"))
    block = {r.node: (r.cluster, r.block) for r in blocks.collect()}
    found = [tuple(r) for r in pairs.collect()]
    paired = set(found)
    assert len(block) == len(rows) and len(paired) == len(found)
    for c, a, _, n in rows:
        for d, b, _, m in rows:
            if c == d and 100 * min(n, m) >= 75 * max(n, m):
                assert (c, *sorted((block[a][1], block[b][1]))) in paired
    every = len({b for c, b in block.values() if c == 0})
    assert len([p for p in paired if p[0] == 0]) < every * (every + 1) / 2 * 0.7


def test_cells_of_shared_nodes_hang_together(spark):
    held = spark.createDataFrame([(1, 1, [8, 3, 5]), (2, 2, [5, 9, 11]), (3, 3, [20, 30, 40]), (4, 4, [11, 2, 17])], "node long, root long, keys array<long>")
    links = ngram_join._cell_links(held.repartition(2))
    assert {r.node: r.root for r in ngram_join.components(links).collect()} == {k: 2 for k in (3, 5, 8, 9, 11, 17)} | {30: 20, 40: 20}


def test_sketches_bound_the_difference():
    rnd = random.Random(1)
    for _ in range(50):
        n = rnd.randint(1, 300)
        a = [rnd.getrandbits(64) for _ in range(n)]
        b = a[: rnd.randint(0, n)] + [rnd.getrandbits(64) for _ in range(rnd.randint(1, 80))]
        x, y = (util.np.unique(util.np.array(s, dtype="u8")) for s in (a, b))
        assert ngram_join.may_link(len(x), ngram_join.bit_sketch(x), len(y), ngram_join.bit_sketch(y)) or not ngram_join.linked(x, y)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.similar_groups(docs).count() == 0
    assert language_id.language_id(docs).count() == 0
    assert quality.quality(docs, labels).count() == 0
    assert decontaminate.leaked(docs, bench).count() == 0
    assert licenses.scanned(docs).count() == 0
    some = frame(spark, odd_texts()[:9])
    assert {r.score for r in quality.quality(some, labels).collect()} == {0.5}
    assert decontaminate.contaminated(some, bench).where("size(leaks) > 0").count() == 0
    assert {r.lang_pred for r in language_id.language_id(some.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_odd_texts(spark):
    texts = odd_texts() + ["1234 !!", "der die das und nicht " * 3, "the of and that with " * 3] * 4
    docs = frame(spark, texts, lambda t: None if not t else "de" if "der die" in t else "en")
    got = language_id.language_id(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else "no id"
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if "der die" in (text or ""):
            assert r.lang_pred == "de"


def test_ngrams_stay_within_their_text():
    one, counts = language_id.ngrams(pa.array(["Ab c", "x", None, "", "é1é"]))
    assert [c.tolist() for c in counts] == [[3, 1, 0, 0, 2], [5, 2, 0, 0, 4], [4, 1, 0, 0, 3]]
    alone = [language_id.ngrams(pa.array([t]))[0] for t in ("Ab c", "x", "é1é")]
    for k in range(3):
        assert one[k].tolist() == [v for a in alone for v in a[k].tolist()]


def test_held_out_rows_change_nothing(spark):
    texts = [("aa bb cc " if k % 2 else "xx yy zz ") * 5 for k in range(60)]
    docs = spark.createDataFrame([(k, t, "p" if k % 2 else "q") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    held = docs.where(util.held_out("doc_id"))
    assert 0 < held.count() < 60
    other = docs.where(~util.held_out("doc_id")).unionByName(held.withColumn("lang", F.lit("wrong")))
    key = lambda df: sorted(map(tuple, language_id.language_id(df).collect()))
    assert key(docs) == key(other)


def test_forest_matches_a_walk_over_its_trees():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 4))
    y = (x[:, 1] + x[:, 2] ** 2 > 0.5).astype(float)
    forest = quality.grow(x, y, trees=20, depth=3)

    def walk(row):
        total = forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    got = forest.score(x)
    assert np.allclose(got, [walk(r) for r in x])
    assert ((got > 0.5) == (y == 1)).mean() > 0.95


def test_statistics_of_a_text_do_not_depend_on_its_neighbours():
    import numpy as np

    texts = odd_texts()
    together = quality.statistics(pa.array(texts, pa.string()))
    assert np.isfinite(together).all()
    for k in (0, 1, 2, 3, 5, 20, len(texts) - 1):
        assert np.allclose(together[k], quality.statistics(pa.array([texts[k]], pa.string()))[0])
    row = dict(zip(quality.FEATURES, quality.statistics(pa.array(["Aa aa! b.\nAa aa! b."]))[0]))
    assert (row["upper"], row["loud"], row["distinct_lines"], row["distinct_words"]) == (2 / 19, 2 / 19, 0.5, 0.5)


def test_quality_learns_and_keeps_rows(spark):
    good = ["Plain words stand here in a row. They end with a stop." + " more" * k for k in range(60)]
    bad = ["BUY!! NOW!! $$$ *** ###" * (k + 1) for k in range(60)]
    texts = [None, "", "x", "y", *good, *bad]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(k < 64)) for k in range(4, 124)] + [(5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).where("doc_id is not null").collect()}
    assert len(got) == 124
    assert all(got[k].predicted == int(k < 64) for k in range(4, 124))
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())


def plain_alignment(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[-1] - 1))
            best = max(best, row[-1])
        above = row
    return best / (2 * len(a))


def test_alignment_matches_a_plain_table():
    import numpy as np

    rnd = random.Random(2)
    pairs = [([rnd.randint(1, 6) for _ in range(rnd.randint(1, 25))], [rnd.randint(1, 6) for _ in range(rnd.randint(1, 40))]) for _ in range(60)]
    got, _ = decontaminate.align(*([np.array(p[k], np.uint64) for p in pairs] for k in (0, 1)))
    assert np.allclose(got, [plain_alignment(a, b) for a, b in pairs])


def test_leaks_are_found_and_clean_texts_left(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    items = [" ".join(word() for _ in range(30)) for _ in range(5)] + ["too short an item", None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(None, items[0]), (2, items[2])], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    other = lambda n: " ".join(word() for _ in range(n))
    edited = items[1].split()
    for k in (4, 11, 17, 25):
        edited[k] = word()
    del edited[20]
    texts = [None, "", "   ", "x", other(200) + " " + items[0].upper() + ". " + other(300), " ".join(edited), other(500), items[0] + " x " + items[3], other(20000) + " " + items[4], "too short an item " + other(30)]
    texts += [other(50) + " " + items[2] + other(50)] * 20
    docs = frame(spark, texts)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked(docs, bench).collect()}
    assert got == {(4, 0), (5, 1), (7, 0), (7, 3), (8, 4), *((k, 2) for k in range(10, 30))}
    kept = decontaminate.contaminated(docs, bench)
    assert kept.columns == [c for c in docs.columns if c != "leaks"] + ["leaks"] and kept.count() == docs.count()


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    rnd = random.Random(4)
    items = [" ".join("".join(rnd.choices("abcd", k=6)) for _ in range(12)) for _ in range(9)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(items[: k % 4])) for k in range(12)], "doc_id long, text string")
    want = sorted(map(tuple, decontaminate.leaked(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, decontaminate.leaked(docs, bench).collect())) == want and len(want) == 18


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nX.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    parts = mit.split("\n")
    texts = [None, "", "x", "y", "Abc. Licensed under the Apache License, Version 2.0.", mit, "\n".join([parts[2], parts[0], parts[3]]), "released  under the MIT-License! Licensed under CC BY-NC 4.0.", "a " * 50000 + "\nReleased under the MIT License.", "It is licensed under the Apache License, Version 2.0"]
    got = {r.doc_id: (r.licences, r.rules, r.n_sentences) for r in licenses.scanned(frame(spark, texts)).collect()}
    assert got[4] == ("Apache-2.0", "apache2-line", 1) and got[5] == ("MIT", "mit-text", 3) and got[6] == ("", "", 3)
    assert got[7] == ("CC-BY-NC-4.0 MIT", "ccbync4-line mit-line", 2) and got[8][0] == "MIT" and got[9] == ("", "", 0)
    assert all(got[k] == ("", "", 0) for k in (0, 1, 2, 3))


def test_bsd_with_three_clauses_is_not_reported_twice(spark):
    s = licenses.SENTENCES
    lines = [s[k] for k in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")]
    docs = spark.createDataFrame([(1, ".\n".join(lines[:3])), (2, ".\n".join(lines))], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licenses.scanned(docs).collect()} == {1: "BSD-2-Clause", 2: "BSD-3-Clause"}
    plan = licenses.scanned(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


MIT = """Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ADVERTISING = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the organization.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
HOPE = """
    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
"""


def test_wrapped_notices(spark):
    commented = lambda s, mark: "".join(f"{mark} {line}".rstrip() + "\n" for line in s.split("\n"))
    gpl2 = GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    wanted = {
        MIT: "MIT", MIT.replace("\n", "\r\n"): "MIT", commented(MIT, " *"): "MIT", "Some words\n" + MIT + BSD: "BSD-2-Clause MIT",
        BSD: "BSD-2-Clause", BSD + ENDORSE: "BSD-3-Clause", BSD + ADVERTISING + ENDORSE: "BSD-4-Clause",
        BSD + ENDORSE.replace("the copyright holder", "Some Company Inc."): "BSD-3-Clause", commented(BSD + ENDORSE, "//"): "BSD-3-Clause",
        GPL: "GPL-3.0-or-later", GPL + HOPE: "GPL-3.0-or-later", commented(GPL + HOPE, "#"): "GPL-3.0-or-later", gpl2 + HOPE: "GPL-2.0-or-later",
        gpl2.replace("either version 2 of the License, or\n    (at your option) any later version", "version 2 of the License") + HOPE: "GPL-2.0-only",
        gpl2.replace("version 2", "version 1") + HOPE: "", GPL.replace("GNU General", "GNU Lesser General") + HOPE: "", APACHE: "Apache-2.0",
        "Released under the\nMIT License.": "MIT", "Released under the\n\nMIT License.": "", "Released under the.\nMIT License": "",
        "We like it\nReleased under the MIT License\nand more": "MIT", "Released under;the MIT/License": "MIT",
    }
    got = {r.doc_id: (r.licences, r.rules) for r in licenses.scanned(frame(spark, list(wanted))).collect()}
    assert {text: got[k][0] for k, text in enumerate(wanted)} == wanted
    assert got[0][1] == "mit-text" and got[9][1] == "gpl3-or-later" and got[10][1] == "gpl-header"
