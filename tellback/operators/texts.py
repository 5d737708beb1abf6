"""Text, URL, hash and option jobs over a table's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellback.functions import text as T
from tellback.functions import urls as U


def text_entities(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """Years, e-mail addresses and host names mentioned in a text."""
    c = F.col(col)
    return df.select(key, T.years(c).alias("years"), T.emails(c).alias("emails"), U.mentioned_hosts(c).alias("hosts"))


def phrase_hints(values: Column, limit: int | None = None) -> Column:
    """Sentences and lines of 16 to 90 characters, first seen first; 12 is the size of the hint list."""
    parts = F.flatten(F.transform(values, lambda v: F.split(v, f"(?<=[.!?。]){T.WS}+|\\n+")))
    clean = F.transform(parts, T.squeeze)
    kept = F.filter(clean, lambda p: (F.length(p) >= 16) & p.rlike("(?i)[a-z가-힣0-9]"))
    return T.first(F.array_distinct(kept), limit)


def sentences_with(sentences: Column, terms: Column) -> Column:
    """How many sentences hold any of the terms (terms of two or more characters)."""
    low = F.filter(F.transform(terms, lambda t: F.lower(T.strip(t))), lambda t: F.length(t) >= 2)
    return F.size(F.filter(sentences, lambda s: T.any_contains(F.lower(s), low))).cast("bigint")


def mean_paragraph_length(col: Column) -> Column:
    parts = F.filter(F.transform(F.split(col, "\\n{2,}"), T.strip), lambda p: p != "")
    total = F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))
    return F.when(F.size(parts) > 0, F.round(total / F.size(parts), 0)).otherwise(0).cast("bigint")


def parse_boolean(col: Column, fallback: bool) -> Column:
    v = F.lower(T.strip(col))
    return (
        F.when(v.isin("1", "true", "yes", "on"), True).when(v.isin("0", "false", "no", "off"), False).otherwise(fallback)
    )


def parse_number(col: Column) -> Column:
    return T.null_if_blank(col).try_cast("double")


def parse_positive_int(col: Column, fallback: int) -> Column:
    n = parse_number(col)
    return F.when(n > 0, F.floor(n)).otherwise(fallback).cast("bigint")


def parse_nullable_number(col: Column) -> Column:
    return F.floor(parse_number(col) + 0.5).cast("bigint")


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(col + 0.5)))


def without_controls(col: Column, limit: int) -> Column:
    """Control characters become spaces, whitespace collapses, length is capped (a prompt-input rule)."""
    return F.substring(T.squeeze(F.regexp_replace(F.coalesce(col, F.lit("")), "[\\x00-\\x1f\\x7f]", " ")), 1, limit)


_V4 = "^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
_V6 = "^(?=.*:.*:)[0-9a-f:]*(:[0-9.]+)?$"


def client_ip(raw: Column) -> Column:
    """One header value as a plain IP address, NULL when it is none."""
    v = F.trim(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "(?i)^for=", ""))
    v = F.trim(F.substring_index(F.regexp_replace(v, '^"|"$', ""), ";", 1))
    v = F.when(v.rlike("^\\[.*\\]"), F.regexp_extract(v, "^\\[([^\\]]*)\\]", 1)).otherwise(v)
    v = F.regexp_replace(v, "^([0-9]{1,3}(?:\\.[0-9]{1,3}){3}):[0-9]+$", "$1")
    v = F.lower(F.regexp_replace(v, "(?i)^::ffff:", ""))
    return T.let(v, lambda x: F.when(x.rlike(_V4) | x.rlike(_V6), x))


# Single-address headers, most trusted first.
CLIENT_HEADERS = ["cf-connecting-ip", "fly-client-ip", "fastly-client-ip", "x-vercel-forwarded-for", "x-real-ip"]


def client_descriptor(df: DataFrame, headers: str = "headers") -> DataFrame:
    """Client label of a request's header map: an IP, else a fingerprint of agent and language."""
    h = F.col(headers)
    single = [client_ip(h[name]) for name in CLIENT_HEADERS]
    chain = F.filter(
        F.transform(F.split(F.coalesce(h["x-forwarded-for"], F.lit("")), ","), client_ip), lambda x: x.isNotNull()
    )
    ip = F.coalesce(*single, F.get(chain, 0))
    part = lambda name: F.substring(F.trim(F.coalesce(h[name], F.lit(""))), 1, 256)
    anon = F.substring(F.sha2(F.concat(part("user-agent"), F.lit("|"), part("accept-language")), 256), 1, 24)
    return df.withColumn("client_ip", ip).withColumn(
        "client", F.coalesce(F.col("client_ip"), F.concat(F.lit("anon:"), anon))
    )
