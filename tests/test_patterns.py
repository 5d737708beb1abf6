"""Many phrases against texts by one automaton, against one search per phrase."""

import random
import time

from pyspark.sql import functions as F

from tellback.operators import patterns as P


def test_phrases_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(P, "TEXTS", 20)
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abAB é", k=rnd.randint(1, 4)))
    lists = {k: ([word() for _ in range(rnd.randint(0, 30))], [word() for _ in range(5)] + rnd.choice([[], [""], [None], ["ab", "AB", "b"]])) for k in range(6)}
    rows = [(i, rnd.choice([0, 0, 0, 1, 2, 3, 4, 5, 9, None]), rnd.choice(["", None, "x", "a" * 2000]) if i % 9 == 0 else " ".join(word() for _ in range(rnd.randint(1, 20)))) for i in range(400)]
    rows += [(400 + k, 0, "same TEXT ab") for k in range(100)]
    texts = spark.createDataFrame(rows, "id long, k long, said string").withColumn("one", F.lit(1)).repartition(5)
    phrases = spark.createDataFrame([(k, a, b) for k, (a, b) in lists.items()] + [(77, ["a"], ["b"])], "k long, a array<string>, b array<string>")
    got = P.held_phrases(texts, phrases, "k", "said", {"held_a": "a", "held_b": "b"})
    assert got.columns == ["id", "k", "said", "one", "held_a", "held_b"]
    inside = lambda said, hints: [h for h in hints if said is not None and h is not None and h.lower() in said.lower()]
    want = {i: tuple(inside(said, x) for x in lists.get(k, ([], []))) for i, k, said in rows}
    found = got.collect()
    assert len(found) == len(rows) and {r.id: (r.held_a, r.held_b) for r in found} == want


def test_no_texts_and_no_phrases(spark):
    texts, phrases = spark.createDataFrame([(1, "abc")], "k long, said string"), spark.createDataFrame([], "k long, a array<string>")
    assert [r.h for r in P.held_phrases(texts, phrases, "k", "said", {"h": "a"}).collect()] == [[]]
    assert P.held_phrases(texts.limit(0), phrases, "k", "said", {"h": "a"}).collect() == []


def test_a_pass_costs_the_same_for_any_number_of_phrases():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(20_000))
    took = []
    for n in (10, 20_000):
        machine = P.automaton({"".join(rnd.choices("abcdefgh", k=9)) for _ in range(n)} | {text[1000:1012]})
        best = 1e9
        for _ in range(5):
            start = time.perf_counter()
            found = P.held(machine, text)
            best = min(best, time.perf_counter() - start)
        took.append(best)
        assert text[1000:1012] in found
    assert took[1] < 20 * took[0]  # two thousand times the phrases
