"""Window functions of stretches of time, their composition, and busy keys spread over tasks; result reuse as a stream."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tellback.streaming import jobs as J
from tellback.streaming import quota as Q


def last_end(times, end, window):
    """The end of the last window opened, one request after the other."""
    for t in times:
        if t >= end:
            end = t + window
    return end


def starts(times, window):
    out, end = [], Q.NEVER
    for t in sorted(set(times)):
        if t >= end:
            out.append(t)
            end = t + window
    return out


def pieces_of(times, length):
    for p in sorted({t // length for t in times}):
        yield np.array([t for t in times if t // length == p], np.int64)


def function(times, begin, window, length, chunks=1):
    parts = []
    for c in range(chunks):
        s = Q.Stretch(begin + window * c // chunks, begin + window * (c + 1) // chunks, c == chunks - 1, window)
        for p in pieces_of(times, length):
            s.piece(p)
        parts.append(s.function())
    return Q.steps(*[np.concatenate([p[k] for p in parts]) for k in range(3)])


CASES = [(seed, window, length, density) for seed in range(6) for window, length in ((20, 20), (60, 10), (100, 7)) for density in (0.02, 0.2, 0.8, 1.0)]


@pytest.mark.parametrize("seed,window,length,density", CASES)
def test_functions_and_their_composition(seed, window, length, density):
    rnd = random.Random(seed)
    width = window * rnd.randint(1, 3)
    lists = [[t for t in range(k * width, (k + 1) * width) if rnd.random() < density] for k in range(4)]
    made = [function(x, k * width, window, length, rnd.choice([1, 3])) if x else None for k, x in enumerate(lists)]
    for k, (times, f) in enumerate(zip(lists, made)):
        if f is not None:
            ends = np.arange(k * width - 5, k * width + window + 1)
            got = Q.applied(f, ends)
            for e, g in zip(ends.tolist(), got.tolist()):
                want = last_end(times, e, window)
                # ends before the next request are alike
                assert g == want or not [t for t in times if t >= min(e, want)] and max(g, want) <= (k + 1) * width
            assert (np.diff(f[0]) > 0).all()
    known = [f for f in made if f is not None]
    if not known:
        return
    whole, every = Q.composed(known), [t for x in lists for t in x]
    for e in range(-5, window + 1):
        got, want = int(Q.applied(whole, np.array([e]))[0]), last_end(every, e, window)
        assert got == want or max(got, want) <= max(every) + 1 or got <= 4 * width and not [t for t in every if t >= min(got, want)]
        later = 4 * width
        assert max(got, later) == max(want, later)


def test_runs_of_milliseconds_are_one_step():
    f = function(list(range(0, 3000)), 0, 3000, 500)
    g = function(list(range(3000, 6000)), 3000, 3000, 500)
    assert len(f[0]) <= 2 and len(Q.composed([f, g])[0]) <= 3
    assert Q.applied(Q.composed([f, g]), np.array([17])).tolist() == [6017]


def test_busy_keys_in_blocks(spark):
    rnd = random.Random(2)
    rows = [("dense", t) for t in range(5_000, 45_000) if rnd.random() < 0.9]
    rows += [("sparse", rnd.randrange(0, 4_000_000)) for _ in range(3000)]
    rows += [("bursts", b * 50_000 + rnd.randrange(0, 900)) for b in range(60) for _ in range(60)]
    rows += [(f"k{k % 30}", rnd.randrange(0, 90_000)) for k in range(200)] + [("one", 7), ("one", 7), (None, 3), ("null", None)]
    events = spark.createDataFrame(rows, "key string, ms long").repartition(6)
    for window in (700, 2_500, 10_000):
        got = {}
        for r in Q.anchors(events, window, block_moments=100).collect():
            got.setdefault(r.key, []).append(r.anchor)
        for key in {r[0] for r in rows} - {None, "null"}:
            assert sorted(got.pop(key)) == starts([t for k, t in rows if k == key], window), (key, window)
        assert not got


def test_chunks_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(Q, "STEPS", 700)
    monkeypatch.setattr(Q, "PIECE_MS", 100)
    rnd = random.Random(4)
    rows = [("a", t) for t in range(0, 60_000) if rnd.random() < (0.9 if t // 20_000 % 2 else 0.05)] + [("b", 10 * t) for t in range(4_000)]
    events = spark.createDataFrame(rows, "key string, ms long").repartition(3)
    for window in (1_950, 4_000):
        got = Q.anchors(events, window, block_moments=500).collect()
        for key in ("a", "b"):
            assert sorted(r.anchor for r in got if r.key == key) == starts([t for k, t in rows if k == key], window)


def test_a_million_requests_of_one_key(spark):
    """No gap is as long as a window; the ordered step is spread over blocks."""
    asked = spark.range(1_000_000, numPartitions=8).select(F.lit("hot").alias("key"), F.col("id").alias("event_id"), (F.pmod(F.xxhash64("id"), F.lit(9_000_000)) + 5).alias("ms"))
    local = asked.toPandas().sort_values(["ms", "event_id"], kind="stable").reset_index(drop=True)
    window = 60_000
    opened = np.array(starts(local["ms"].tolist(), window))
    local["anchor"] = opened[np.searchsorted(opened, local["ms"], side="right") - 1]
    local["request_no"] = local.groupby("anchor").cumcount() + 1
    pieces = Q.moments(asked, window)
    assert Q._keys(pieces, Q.BLOCK_MOMENTS).first().wide < 15
    got = Q.quota_windows(asked, window, 2, "event_id").toPandas().sort_values("event_id").reset_index(drop=True)
    want = local.sort_values("event_id").reset_index(drop=True)
    pd.testing.assert_series_equal(got["request_no"], want["request_no"])
    assert (got["allowed"] == (want["request_no"] <= 2)).all()
    assert (got["reset_seconds"] == -(-(want["anchor"] + window - want["ms"]) // 1000)).all()


# --- result reuse as a stream --------------------------------------------------------------
def reuse_rows():
    rnd = random.Random(9)
    rows = [("hot" if k % 3 == 0 else f"k{rnd.randrange(12)}", k, rnd.randrange(0, 40_000)) for k in range(3_000)] + [("late", 9_000 + k, 4_000 * k) for k in range(10)]
    return sorted(rows, key=lambda r: (r[2], r[1]))


def test_reuse_stream_over_batches_and_a_restart(spark, tmp_path):
    rows, ttl = reuse_rows(), 1_000
    want = {r.event_id: (r.key, r.hit) for r in Q.freshness_reuse(spark.createDataFrame(rows, "key string, event_id long, ms long"), ttl, "event_id").collect()}
    cut, schema = len(rows) // 5, "key string, event_id long, ms long"

    def arrive(k):
        part = rows[k * cut : (k + 1) * cut if k < 4 else len(rows)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)

    def go():
        stream = J.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "parquet", files_per_batch=1)
        J.keep_table(Q.freshness_stream(stream, ttl, "event_id", kept_ms=10**9), f"{tmp_path}/table", f"{tmp_path}/checkpoint", idle_batches=False).awaitTermination(60)

    for k in range(3):
        arrive(k)
    go()
    for k in range(3, 5):  # a restart goes on from the state
        arrive(k)
    go()
    got = {r.event_id: (r.key, r.hit) for r in spark.read.parquet(f"{tmp_path}/table").collect()}
    assert got == want and len({v for _, v in want.values()}) == 2


def test_reuse_state_leaves_by_its_time_to_live(spark, tmp_path):
    schema = "key string, event_id long, ms long"
    for k in range(2):
        spark.createDataFrame([(f"k{k}-{j}", 100 * k + j, j) for j in range(50)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = J.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "parquet")
        query = J.keep_table(Q.freshness_stream(stream, 1_000, "event_id", kept_ms=1_500), f"{tmp_path}/table", f"{tmp_path}/checkpoint", idle_batches=False)
        query.awaitTermination(60)
        seen = [int(p.stateOperators[0].customMetrics.get("numValuesRemovedDueToTTLExpiry", 0)) for p in query.recentProgress if p.stateOperators]
        time.sleep(2.5)
    assert sum(seen) == 50  # the first fifty keys have gone, no timer was set
    assert spark.read.parquet(f"{tmp_path}/table").count() == 100


@pytest.mark.parametrize("groups", [1, 3])
def test_streams_of_many_keys_share_state_calls(spark, tmp_path, monkeypatch, groups):
    """The keys of a group are read and written together; their lists are written anew when they have grown."""
    monkeypatch.setattr(Q, "GROUPS", groups)
    monkeypatch.setattr(Q, "SPARE_RECORDS", 2)
    rows, schema = [*reuse_rows(), (None, 20_000, 5_000), (None, 20_001, 5_500), (None, 20_002, 39_000)], "key string, event_id long, ms long"
    rows = sorted(((k, i, m + 10_000) for k, i, m in rows), key=lambda r: (r[2], r[1]))
    cut = len(rows) // 5 + 1
    named = spark.createDataFrame([(k or "null", i, m) for k, i, m in rows], schema)
    reused = {r.event_id: (r.key.replace("null", "") or None, r.hit) for r in Q.freshness_reuse(named, 1_000, "event_id").collect()}
    quotas = {r.event_id: (r.key.replace("null", "") or None, r.request_no, r.allowed, r.remaining, r.reset_seconds) for r in Q.quota_windows(named, 1_000, 2, "event_id").collect()}
    for k in range(5):
        spark.createDataFrame(rows[k * cut : (k + 1) * cut], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = lambda: J.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "parquet", files_per_batch=1)
    made = {"reuse": Q.freshness_stream(stream(), 1_000, "event_id", kept_ms=10**9), "quota": Q.quota_stream(stream(), 1_000, 2, "event_id"), "late": Q.quota_stream(stream(), 1_000, 2, "event_id", "1 second")}
    for name, df in made.items():
        query = J.keep_table(df, f"{tmp_path}/{name}", f"{tmp_path}/c-{name}", idle_batches=name == "late")
        query.awaitTermination(90)
        kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        assert kept and max(kept) < 200
    assert {r.event_id: (r.key, r.hit) for r in spark.read.parquet(f"{tmp_path}/reuse").collect()} == reused
    for name in ("quota", "late"):
        got = {r.event_id: (r.key, r.request_no, r.allowed, r.remaining, r.reset_seconds) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}
        assert got == quotas, name
