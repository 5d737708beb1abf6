"""Sitemap files as rows: one per entry, from byte ranges of the files.

A folder holds one folder per sitemap, ``sitemap_url=<escaped URL>``, with its body in one or several files, plain or gzipped. They are read as text whose lines end with
``</loc>``: Spark cuts plain files into byte ranges and gives each task whole entries; gzipped ones are a task each. No body is put together, so a site with
millions of pages is as many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellback.functions import text as T

LOC = r"(?is)<loc>\s*(.*)\z"


def write_sitemaps(lines: DataFrame, path: str, zipped: bool = False) -> None:
    """Bodies (sitemap_url, line) as files, in parallel; a sitemap of many lines is split over several. Entries of a sitemap have no order."""
    rows = lines.select("sitemap_url", F.col("line").alias("value")).hint("rebalance", "sitemap_url")
    rows.write.mode("append").partitionBy("sitemap_url").option("compression", "gzip" if zipped else "none").text(path)


def sitemap_entries(spark: SparkSession, path: str) -> DataFrame:
    """sitemap_url, kind (``url``, ``sitemap`` or null: that of the element that holds the entry), loc, and the numbers of url and sitemap elements that begin before its end.

    What follows the last entry of a file is a row without ``loc``, so that elements without one are counted, too.
    """
    chunks = spark.read.option("lineSep", "</loc>").schema("value string, sitemap_url string").text(path)
    raw = F.regexp_extract("value", LOC, 1)
    counts = {f"{k}_tags": F.regexp_count("value", F.lit(f"(?i)<{k}{T.NO_WORD_AFTER}")).cast("bigint") for k in ("url", "sitemap")}
    last = F.regexp_extract("value", rf"(?is).*<(url|sitemap){T.NO_WORD_AFTER}", 1)
    out = chunks.withColumns(counts | {"loc": F.when(F.regexp_like("value", F.lit("(?i)<loc>")), T.strip(T.decode_basic(raw))), "kind": F.nullif(F.lower(last), F.lit(""))})
    return out.select("sitemap_url", "kind", "loc", "url_tags", "sitemap_tags")
