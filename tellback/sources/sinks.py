"""Sinks: named result tables, batch snapshots, per-site logs, text reports; shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared place the cluster names in spark.checkpoint.dir.

    Only where none is named (local tests) is a temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):  # one process, so its folder is shared by all tasks
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tellback-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write rows once to the shared place and read them back, for results that are read more than once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str, kind: str = "parquet") -> dict[str, str]:
    """Each named result as one folder of files, written in parallel by its tasks."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{root}/{name}"
        df.write.mode("overwrite").format(kind).save(paths[name])
    return paths


def number_rows(df: DataFrame, order: str, root: str) -> DataFrame:
    """Global row numbers without a single-task sort.

    Rows are range-partitioned and written once, each with its partition and
    place; partition offsets come from a small table of counts.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    placed = ranged.withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
    )
    placed.write.mode("overwrite").parquet(f"{root}/ranged")
    kept = df.sparkSession.read.parquet(f"{root}/ranged")
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the table, so the running sum is short
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(offsets), "_part").withColumn("row_no", F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def write_batch_snapshots(df: DataFrame, order: str, size: int, root: str, batches_per_folder: int = 100_000) -> str:
    """Rows in order, ``size`` per batch, stored once; the snapshot after batch n is batches 1..n.

    ``batch`` is a column of sorted files, so a reader of some batches skips the rest by their statistics; a folder holds
    a range of batches.
    """
    numbered = number_rows(df, order, root).withColumn("batch", F.ceil(F.col("row_no") / size).cast("bigint"))
    path = f"{root}/batches"
    ranged = numbered.withColumn("batches", F.floor(F.col("batch") / batches_per_folder)).repartitionByRange("batch")
    ranged.sortWithinPartitions("batches", "batch").write.mode("overwrite").partitionBy("batches").parquet(path)
    return path


def write_site_logs(logs: DataFrame, path: str, site: str = "host") -> None:
    """JSON log records, one folder per site.

    Small sites share a task and large ones are split over several, so there are few files per site.
    """
    logs.hint("rebalance", site).write.mode("overwrite").partitionBy(site).json(path)


def write_text_report(lines: DataFrame, path: str, order: list[str], text: str = "line") -> None:
    """Report lines as text files, ordered within and across files."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(text).alias("value")).write.mode(
        "overwrite"
    ).text(path)
