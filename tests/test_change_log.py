"""A log of changes with compacted versions and the manifest that counts."""

import pytest
from pyspark.sql import functions as F

from tellback.sources import folders
from tellback.streaming import jobs as J


def put(spark, path, version, rows):
    spark.createDataFrame(rows, "k string, x long").write.mode("overwrite").parquet(f"{path}/version={version}")


def now(spark, path):
    return {r.k: r.x for r in J.latest_rows(spark, path, "k").collect()}


def test_readers_see_one_consistent_version(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        J.latest_rows(spark, path, "k")
    assert not J.compact(spark, path, "k")
    put(spark, path, 0, [("a", 1), ("b", 1)])
    put(spark, path, 1, [("b", 2), ("c", 2)])
    assert now(spark, path) == {"a": 1, "b": 2, "c": 2}
    early = J.latest_rows(spark, path, "k")  # a reader that has begun
    assert J.compact(spark, path, "k") and not J.compact(spark, path, "k")
    put(spark, path, 2, [("a", 3), ("d", 3)])
    middle = J.latest_rows(spark, path, "k")
    assert "version=1" not in " ".join(middle.inputFiles()) and "version=2" in " ".join(middle.inputFiles())
    J.vacuum(spark, path)
    assert {r.k: r.x for r in early.collect()} == {"a": 1, "b": 2, "c": 2}
    assert J.compact(spark, path, "k")
    put(spark, path, 3, [("a", 4)])
    J.vacuum(spark, path)
    assert {r.k: r.x for r in middle.collect()} == {"a": 3, "b": 2, "c": 2, "d": 3}
    assert now(spark, path) == {"a": 4, "b": 2, "c": 2, "d": 3}
    assert [n for n in folders.names(spark, path) if n.startswith("version")] == ["version=2", "version=3"]
    assert spark.read.parquet(path).where("version = 3").count() == 1  # other readers see plain versions only


def test_one_of_two_compactions_counts(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    put(spark, path, 0, [("a", 1)])
    own, begun, inner = folders.publish, [], []

    def late(session, made, target):
        begun.append(target)
        if len(begun) == 1:  # another one comes first
            inner.append(J.compact(spark, path, "k"))
        return own(session, made, target)

    monkeypatch.setattr(folders, "publish", late)
    assert not J.compact(spark, path, "k") and inner == [True] and now(spark, path) == {"a": 1}
    assert len(folders.names(spark, f"{path}/_compacted")) == 2 and [n for n in folders.names(spark, f"{path}/_manifests") if n.isdigit()] == ["000000001"]
    put(spark, path, 1, [("a", 2), ("b", 2)])
    J.vacuum(spark, path)
    assert now(spark, path) == {"a": 2, "b": 2} and len(folders.names(spark, f"{path}/_compacted")) == 1


def test_a_compaction_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    put(spark, path, 0, [("a", 1)])

    def broken(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(folders, "publish", broken)
        with pytest.raises(OSError):
            J.compact(spark, path, "k")
    assert now(spark, path) == {"a": 1}
    put(spark, path, 1, [("a", 2)])
    assert J.compact(spark, path, "k") and now(spark, path) == {"a": 2}


def test_the_stream_goes_on_behind_a_compaction(spark, tmp_path):
    def arrive(rows):
        spark.createDataFrame(rows, "url string, n long").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = J.file_stream(spark, f"{tmp_path}/in", "url string, n long", files_per_batch=1)
        latest = stream.groupBy("url").agg(F.max("n").alias("n"))
        J.keep_latest(latest, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()

    arrive([("u", 1), ("v", 1)])
    assert J.compact(spark, f"{tmp_path}/table", "url")
    arrive([("u", 5)])
    assert {r.url: r.n for r in J.latest_rows(spark, f"{tmp_path}/table", "url").collect()} == {"u": 5, "v": 1}
