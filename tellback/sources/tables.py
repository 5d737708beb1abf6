"""Sources: crawled pages, JSON artifacts, log folders, URL lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tellback.functions.text import strip


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt to ``tasks`` tasks when a number is given.

    Text work costs far more CPU per byte than a scan, and a small table in one row group is one task. Large tables
    need no such step: ``spark.sql.files.maxPartitionBytes`` splits their scan without a shuffle.
    """
    return df.repartition(tasks) if tasks else df


def html_pages(pages: DataFrame) -> DataFrame:
    """Non-empty HTML pages; when a content type is known, text/html only."""
    kept = pages.filter((F.col("html").isNotNull()) & (F.col("html") != ""))
    if "content_type" in pages.columns:
        kept = kept.filter(F.contains(F.lower(F.col("content_type")), F.lit("text/html")))
    return kept


def json_artifact(spark: SparkSession, path: str, schema: ST.StructType | str, multi_line: bool = False) -> DataFrame:
    """Rows of a JSON artifact; an absent path is an empty table of the same schema.

    Set ``multi_line`` for one JSON array per file. Line-delimited files split
    across tasks, a multi-line file does not, so large artifacts use lines.
    """
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of a text list; blank and '#' lines are dropped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("url"))
    return lines.filter((F.col("url") != "") & ~F.col("url").startswith("#"))


# The layout of a delivery log file.
LOG_SCHEMA = """url string, engines map<string, struct<status: string, citation_level: string,
 delivered: array<string>, missed: array<struct<field: string, signal: string, confidence: string>>,
 subpages: array<struct<url: string, reached: string>>>>"""


def delivery_logs(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON logs with each record's file name, which orders runs of the same URL."""
    return spark.read.schema(LOG_SCHEMA).json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
