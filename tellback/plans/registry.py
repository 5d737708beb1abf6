"""Where queries and their oracle SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tellback.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Comparable output: arrays joined with ' | ', integers as bigint, decimals as double."""
    cols = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, ST.ArrayType):
            col = F.array_join(F.transform(col, lambda x: x.cast("string")), " | ")
        elif isinstance(kind, (ST.IntegerType, ST.ShortType, ST.ByteType)):
            col = col.cast("bigint")
        elif isinstance(kind, (ST.DecimalType, ST.FloatType)):
            col = col.cast("double")
        cols.append(col.alias(field.name))
    return df.select(*cols)


def query(name: str, views: list[str] | None = None, sql: str | None = None, ctes: list[str] | None = None):
    """Register a query and, when ``sql`` is given, its oracle over the named views."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views or [], *(ctes or [])) + sql
        return fn

    return register
