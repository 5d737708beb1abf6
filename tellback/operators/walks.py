"""Walks along edges to any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellback.sources.sinks import shared_folder, store


def reached(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): what the nodes of ``seeds`` (seed) lead to along ``edges`` (parent, child), each at its smallest depth; seeds lead to themselves.

    A semi-naive fixpoint: each round joins only what the round before found with the edges, drops what was reached before, and stores the rest beside it. The walk
    ends with the first round that finds nothing, so cycles end, too. What was reached is one folder, so the plan does not grow with the depth.
    """
    spark, path = seeds.sparkSession, shared_folder(seeds.sparkSession, "walk")
    edges = store(edges.select("parent", "child").distinct(), "edges")
    found = seeds.select("seed", F.col("seed").alias("node")).distinct()
    schema = f"seed {found.schema['seed'].dataType.simpleString()}, node {found.schema['node'].dataType.simpleString()}, depth int"
    depth = 0
    while True:
        found.write.parquet(f"{path}/depth={depth}")
        so_far = spark.read.schema(schema).parquet(path)
        delta = so_far.filter(F.col("depth") == depth)
        if depth == max_depth or not delta.limit(1).count():
            return so_far
        step = delta.join(edges, F.col("node") == F.col("parent")).select("seed", F.col("child").alias("node")).distinct()
        found = step.join(so_far.select("seed", "node"), ["seed", "node"], "left_anti")
        depth += 1
