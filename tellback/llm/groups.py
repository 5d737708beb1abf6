"""Groups that links form: hooking to the smallest neighbour, pointer jumping, and links between groups only in the next round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellback.llm import util


def _jumped(parents: DataFrame) -> DataFrame:
    """Each node's parent's parent. Both sides of the join are shuffled for it alone, so a parent of many nodes can be split."""
    over = parents.select(F.col("node").alias("_at"), F.col("root").alias("_over"))
    return parents.join(over, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_over", "root").alias("root"), F.col("_over").isNotNull().alias("moved"))


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its group) of all nodes of ``links`` (a, b) but the roots.

    In each round every node hooks to its smallest neighbour if that is smaller, chains are halved until all point to a root, and the
    links are carried over to the roots; those within a group go. Of the links of a node only the smallest neighbour is gathered, by an aggregate that combines before the
    shuffle, so a node with many links is no task of its own.
    """
    live = util.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    found = None
    while True:
        parents = util.stored(live.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "parents")
        while True:
            parents = util.stored(_jumped(parents), "parents")
            if not parents.where("moved").limit(1).count():
                break
            parents = parents.select("node", "root")
        parents = parents.select("node", "root")
        if found is None:
            found = parents
        else:  # what pointed to a root of the round before follows it
            later = parents.select(F.col("node").alias("_at"), F.col("root").alias("_over"))
            found = found.join(later, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_over", "root").alias("root")).union(parents)
        moved = live
        for side in ("u", "v"):
            to = parents.select(F.col("node").alias("_at"), F.col("root").alias("_over"))
            moved = moved.join(to, F.col(side) == F.col("_at"), "left").withColumn(side, F.coalesce("_over", side)).drop("_at", "_over")
        live = util.stored(moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        if not live.limit(1).count():
            return util.stored(found, "groups")
