"""Row numbers within groups without a task per group."""

from pyspark.sql import functions as F

from tellback.sources import numbering as N


def test_numbers_within_groups(spark):
    rows = [("hot" if k % 3 else f"g{k % 11}" if k % 2 else None, (k * 7919) % 1009, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long, id long").repartition(7)
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = (g, n, sum(q[0] == g for q in rows))
    got = N.numbered(df, ["g"], F.col("x").desc(), F.col("id"), size="of")
    assert got.columns == ["g", "x", "id", "of", "n"]
    assert {r.id: (r.g, r.n, r.of) for r in got.collect()} == want
    first = N.numbered(df, ["g"], F.col("x").desc(), F.col("id"), limit=4).collect()
    assert {r.id for r in first} == {i for i, (_, n, _) in want.items() if n <= 4}


def test_equal_rows_get_different_numbers(spark):
    same = spark.createDataFrame([("a", 1)] * 500, "g string, x long").repartition(4)
    assert sorted(r.n for r in N.numbered(same, ["g"], F.col("x")).collect()) == list(range(1, 501))
    assert N.numbered(same.limit(0), ["g"], F.col("x")).collect() == []


def test_a_hot_group_is_ordered_by_many_tasks(spark, monkeypatch):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("g"), F.xxhash64("id").alias("x"))
    tables, own = {}, N.store
    monkeypatch.setattr(N, "store", lambda df, name: tables.setdefault(name, own(df, name)))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        N.ordered(rows, F.col("g"), F.col("x"))
        parts = tables["numbered"].where("g = -1").groupBy("_part").count().collect()
        assert len(parts) >= 8 and max(r["count"] for r in parts) < 2 * 40_000 / 16
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
