"""Row numbers within groups, where one group may hold a third of all rows.

Rows are range-partitioned by (group, place) and stored once. A partition's offset is the running sum of the counts of the partitions
before it (one row per partition), so each row has a number in the whole order. A group's rows follow each other there: its smallest number, an
aggregate that combines before the shuffle, gives the number within the group. No task holds a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellback.sources.sinks import store

_IN_PARTITION = (1 << 33) - 1


def ordered(df: DataFrame, *by: Column) -> DataFrame:
    """All rows with ``_row``, their place (from 0) in the order of ``by`` (columns, or ``.desc()`` of columns).

    Rows that are equal there stand in any order and are spread over tasks, too.
    """
    tied = store(df, "unnumbered").withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))
    placed = store(ranged.withColumns({"_part": F.spark_partition_id(), "_at": at}), "numbered")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("_row", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def numbered(df: DataFrame, group: list[str], *by: Column, name: str = "n", size: str | None = None, limit: int | None = None) -> DataFrame:
    """All rows with ``name``, their number (from 1) within ``group`` in the order of ``by``, and the group's ``size`` if it is named.

    Null is a group like any other. ``limit`` keeps the first rows of each group.
    """
    rows = ordered(df, *[F.col(c) for c in group], *by)
    first = rows.groupBy(*group).agg(F.min("_row").alias("_first"), *([F.count(F.lit(1)).alias(size)] if size else []))
    first = first.withColumnsRenamed({c: f"_of_{c}" for c in group})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])
    out = rows.join(first, same).withColumn(name, F.col("_row") - F.col("_first") + 1).drop("_row", "_first", *[f"_of_{c}" for c in group])
    return out if limit is None else out.filter(F.col(name) <= limit)
