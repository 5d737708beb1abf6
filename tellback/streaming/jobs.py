"""Continuous jobs: latest log per URL, incremental ingest with a dead-letter sink."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tellback.operators.review import latest_log
from tellback.sources import folders


def file_stream(spark: SparkSession, path: str, schema, kind: str = "json", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(kind).load(path)


def latest_log_stream(logs: DataFrame) -> DataFrame:
    """Latest log per URL as a running aggregate; state holds one row per URL."""
    return latest_log(logs)


def keep_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", idle_batches: bool = True) -> StreamingQuery:
    """Write the result rows of each batch as a numbered version.

    A version folder is written whole before the next batch, so a lost executor
    or a restart rewrites the same folder and changes nothing else. Without ``idle_batches`` there are batches for new rows only: state that leaves by
    the clock would else ask for one more batch again and again, and a run over what is there would not end.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name, "true")
    conf.set(name, before if idle_batches else "false")  # a query keeps the settings it starts with
    try:
        return (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(name, before)


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A running aggregate as a log of changes: each batch writes the keys it touched. ``compact`` keeps what a reader has to read short."""
    return keep_table(stream, path, checkpoint, "update")


# A log of changes: version=N are the keys that batch N touched. _compacted/X has one row per key up to some version, and _manifests/M says which: (base, upto, previous base).
# The manifest with the greatest number counts. Names that begin with "_" are no part of the table for Spark's readers.
MANIFEST = "base string, upto long, kept array<string>"


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(x.partition("=")[2]) for x in folders.names(spark, path) if x.startswith("version="))


def _manifest(spark: SparkSession, path: str) -> tuple[int, Row | None]:
    """Number and content of the manifest that counts; 0 and None before the first one."""
    last = max((int(x) for x in folders.names(spark, f"{path}/_manifests") if x.isdigit()), default=0)
    return last, spark.read.schema(MANIFEST).json(f"{path}/_manifests/{last:09d}").first() if last else None


def _read(spark: SparkSession, path: str, manifest: Row | None, key: str, upto: int | None = None) -> DataFrame:
    """One row per key from the compacted rows and the versions behind them (as far as ``upto``)."""
    newer = [v for v in _versions(spark, path) if (manifest is None or v > manifest.upto) and (upto is None or v <= upto)]
    parts = [spark.read.option("basePath", path).parquet(*[f"{path}/version={v}" for v in newer])] if newer else []
    if manifest is not None:
        parts.append(spark.read.parquet(f"{path}/_compacted/{manifest.base}").withColumn("version", F.lit(-1)))
    if not parts:
        raise FileNotFoundError(f"nothing has been written to {path}")
    rows = reduce(DataFrame.unionByName, parts)
    rest = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("l")).select(key, "l.*")


def latest_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last row written for each key, as of now: what batches or ``compact`` write later is not part of it.

    Only the compacted rows and the versions behind them are read. Aggregates combine before the shuffle.
    """
    return _read(spark, path, _manifest(spark, path)[1], key)


def compact(spark: SparkSession, path: str, key: str) -> bool:
    """Put all versions so far into one row per key, and publish that by one rename. The stream and readers may go on meanwhile.

    False if another ``compact`` published first (its result counts, this one's rows are left to ``vacuum``) or if there is nothing new.
    """
    number, now = _manifest(spark, path)
    versions = _versions(spark, path)
    if not versions or now is not None and versions[-1] <= now.upto:
        return False
    base, upto = uuid.uuid4().hex, versions[-1]
    _read(spark, path, now, key, upto).write.parquet(f"{path}/_compacted/{base}")
    said = spark.createDataFrame([(base, upto, [base] if now is None else [base, now.base])], MANIFEST)
    made = f"{path}/_manifests/.{base}"
    said.coalesce(1).write.json(made)
    return folders.publish(spark, made, f"{path}/_manifests/{number + 1:09d}")


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove what neither the current manifest nor the one before it needs, so that readers who began before the last ``compact`` go on.

    Run it when no reader is older than that and no other ``compact`` runs.
    """
    number, now = _manifest(spark, path)
    if now is None:
        return
    before = spark.read.schema(MANIFEST).json(f"{path}/_manifests/{number - 1:09d}").first().upto if number > 1 else -1
    for v in _versions(spark, path):
        if v <= before:
            folders.remove(spark, f"{path}/version={v}")
    for base in folders.names(spark, f"{path}/_compacted"):
        if base not in now.kept:
            folders.remove(spark, f"{path}/_compacted/{base}")
    for name in folders.names(spark, f"{path}/_manifests"):
        if not name.isdigit() or int(name) < number - 1:
            folders.remove(spark, f"{path}/_manifests/{name}")


def incremental_ingest(stream: DataFrame, good: str, bad: str, checkpoint: str, reason) -> StreamingQuery:
    """New records only: good rows to one table, rejected ones with a reason to another.

    ``reason`` is a column that is NULL for good rows. Batch folders make a
    replayed batch overwrite itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        judged = batch.withColumn("reject_reason", reason).persist()
        judged.filter("reject_reason is null").drop("reject_reason").write.mode("overwrite").parquet(f"{good}/batch={number}")
        judged.filter("reject_reason is not null").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        judged.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
