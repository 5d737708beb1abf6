"""Engine payloads (three provider shapes) -> text, citations, search queries, grounding facts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tellback import dims
from tellback.functions import text as T
from tellback.functions import urls as U

LIST = "array<variant>"
GROUNDING_HOST = "vertexaisearch.cloud.google.com"


def _get(doc: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(doc, F.lit(path), kind)


def _items(doc: Column, *paths: str) -> Column:
    """Items of the first path that holds an array, else an empty list."""
    return F.coalesce(*[_get(doc, p, LIST) for p in paths], F.array().cast(LIST))


def _glued(parts: Column, sep: str = "") -> Column:
    return T.strip(F.array_join(F.filter(parts, lambda p: p.isNotNull()), sep))


def with_document(payloads: DataFrame, col: str = "payload") -> DataFrame:
    return payloads.withColumn("doc", F.try_parse_json(F.col(col)))


def payload_text(df: DataFrame) -> DataFrame:
    """Answer text: output_text or output messages, candidate parts, or choice message content."""
    d = F.col("doc")
    output = F.flatten(
        F.transform(
            _items(d, "$.output"),
            lambda o: F.transform(
                F.filter(_items(o, "$.content"), lambda c: _get(c, "$.type") == "output_text"), lambda c: _get(c, "$.text")
            ),
        )
    )
    direct = T.strip(F.coalesce(_get(d, "$.output_text"), F.lit("")))
    openai = F.when(direct != "", direct).otherwise(_glued(output, "\n"))
    gemini = _glued(F.transform(_items(d, "$.candidates[0].content.parts"), lambda p: _get(p, "$.text")))
    said = "$.choices[0].message.content"
    parts = F.transform(_items(d, said), lambda p: F.coalesce(_get(p, "$.text"), _get(p, "$.content")))
    perplexity = F.when(_get(d, said, LIST).isNotNull(), _glued(parts)).otherwise(
        T.strip(F.coalesce(_get(d, said), F.lit("")))
    )
    return df.withColumn(
        "text", F.when(F.col("engine") == "chatgpt", openai).when(F.col("engine") == "gemini", gemini).otherwise(perplexity)
    )


def _gemini(path: str) -> list[str]:
    camel = {"chunks": "groundingChunks", "supports": "groundingSupports", "queries": "webSearchQueries"}[path]
    snake = {"chunks": "grounding_chunks", "supports": "grounding_supports", "queries": "web_search_queries"}[path]
    roots = [
        "$.candidates[0].groundingMetadata",
        "$.candidates[0].grounding_metadata",
        "$.groundingMetadata",
        "$.grounding_metadata",
    ]
    return [f"{r}.{name}" for r in roots for name in (camel, snake)]


def payload_citations(df: DataFrame) -> DataFrame:
    """Distinct cited URLs; a redirect URL of the grounding service becomes the host its title names."""
    d = F.col("doc")
    notes = F.flatten(
        F.transform(
            F.flatten(F.transform(_items(d, "$.output"), lambda o: _items(o, "$.content"))),
            lambda c: F.transform(_items(c, "$.annotations"), lambda a: _get(a, "$.url")),
        )
    )

    def chunk_url(c: Column) -> Column:
        url = T.first_text(*[F.coalesce(_get(c, p), F.lit("")) for p in ("$.web.uri", "$.web.url", "$.uri", "$.source.uri")])
        hinted = T.first_text(
            *[
                U.bare_host_name(F.coalesce(_get(c, p), F.lit("")))
                for p in ("$.web.title", "$.title", "$.source.title", "$.retrievedContext.title", "$.retrieved_context.title")
            ]
        )
        return T.let(
            F.struct(url.alias("u"), hinted.alias("h")),
            lambda x: F.when((U.host(x["u"]) == GROUNDING_HOST) & (x["h"] != ""), F.concat(F.lit("https://"), x["h"])).otherwise(x["u"]),
        )

    gemini = F.transform(_items(d, *_gemini("chunks")), chunk_url)
    plain = F.transform(_items(d, "$.citations"), lambda c: _get(c, "$"))
    found = F.when(F.col("engine") == "chatgpt", notes).when(F.col("engine") == "gemini", gemini).otherwise(plain)
    return df.withColumn("citations", T.distinct_strings(F.filter(found, lambda u: u.isNotNull())))


def is_query(q: Column) -> Column:
    noise = T.literal_list(dims.QUERY_NOISE)
    return (F.length(q) >= 2) & ~q.rlike("(?i)^https?://") & ~F.array_contains(noise, F.lower(q))


QUERY_KEYS = ["query", "queries", "search_query", "search_queries", "rewritten_query", "rewritten_queries"]
SEARCH_ROOTS = ["search_queries", "searchQueries", "web_search_queries", "webSearchQueries"]
# Key names that hold search queries, lower-cased.
QUERY_LIKE = {
    "query", "queries", "searchquery", "searchqueries", "search_query", "search_queries",
    "rewritten_query", "rewritten_queries", "search_term", "search_terms",
}


def _walk_queries(value, found: list[str]) -> None:
    if value is None:
        return
    if isinstance(value, str):
        found.append(value)
    elif isinstance(value, list):
        for item in value:
            _walk_queries(item, found)
    elif isinstance(value, dict):
        for key, child in value.items():
            low = key.lower()
            if low in QUERY_LIKE or (("query" in low or "search" in low) and isinstance(child, str)):
                _walk_queries(child, found)
            elif isinstance(child, (dict, list)) and any(w in low for w in ("query", "search", "tool", "action")):
                _walk_queries(child, found)


@F.pandas_udf(ST.ArrayType(ST.StringType()))
def walk_queries(values: pd.Series) -> pd.Series:
    """Strings under query-like keys of nested JSON. Only nested shapes come here."""

    def one(text):
        found: list[str] = []
        if text:
            _walk_queries(json.loads(text), found)
        return found

    return values.map(one)


def payload_search_queries(df: DataFrame) -> DataFrame:
    """Searches an engine reports: known fields by path; free-form search lists by a key walk."""
    d = F.col("doc")
    searches = F.filter(
        _items(d, "$.output"), lambda o: F.contains(F.lower(F.coalesce(_get(o, "$.type"), F.lit(""))), F.lit("search"))
    )

    def known(o: Column) -> Column:
        return F.flatten(
            F.array(
                *[
                    F.coalesce(_get(o, f"$.{at}{k}", "array<string>"), F.array(_get(o, f"$.{at}{k}")))
                    for at in ("action.", "")
                    for k in QUERY_KEYS
                ]
            )
        )

    chatgpt = F.flatten(F.transform(searches, known))
    gemini = F.coalesce(*[_get(d, p, "array<string>") for p in _gemini("queries")], F.array().cast("array<string>"))
    roots = [f"$.{k}" for k in SEARCH_ROOTS] + [f"$.choices[0].{m}{k}" for m in ("", "message.") for k in SEARCH_ROOTS[:2]]
    nested = F.filter(F.transform(F.array(*[_get(d, r, "variant") for r in roots]), lambda v: F.to_json(v)), lambda v: v.isNotNull())
    # plain string lists stay in the JVM; only nested shapes are sent to the key walk
    simple = F.flatten(F.array(*[F.coalesce(_get(d, r, "array<string>"), F.array(_get(d, r))) for r in roots]))
    has_objects = F.exists(nested, lambda v: F.contains(v, F.lit("{")))
    perplexity = F.when(
        has_objects, walk_queries(F.when(has_objects, F.concat(F.lit("["), F.array_join(nested, ","), F.lit("]"))))
    ).otherwise(simple)
    found = F.when(F.col("engine") == "chatgpt", chatgpt).when(F.col("engine") == "gemini", gemini).otherwise(perplexity)
    clean = F.transform(F.filter(found, lambda q: q.isNotNull()), T.squeeze)
    return df.withColumn("search_queries", F.array_distinct(F.filter(clean, lambda q: is_query(q) | (F.col("engine") == "gemini") & (q != ""))))


def payload_grounding(df: DataFrame) -> DataFrame:
    """Tool calls, results, supports and token usage (needs citations and search_queries)."""
    d, e = F.col("doc"), F.col("engine")
    number = lambda *paths: F.coalesce(*[_get(d, p, "bigint") for p in paths])
    filled = lambda items: F.when(F.size(items) > 0, F.size(items)).cast("bigint")
    calls = F.size(
        F.filter(_items(d, "$.output"), lambda o: F.contains(F.lower(F.coalesce(_get(o, "$.type"), F.lit(""))), F.lit("search")))
    ).cast("bigint")
    results = F.coalesce(
        *[
            filled(_items(d, f"$.{at}{k}"))
            for at in ("", "choices[0].", "choices[0].message.")
            for k in (("search_results", "searchResults", "web_results", "webResults") if at == "" else ("search_results", "searchResults"))
        ]
    )
    chunks, supports = filled(_items(d, *_gemini("chunks"))), filled(_items(d, *_gemini("supports")))
    df = df.withColumns(
        {
            "tool_calls": F.when(e == "chatgpt", F.when(_get(d, "$.output", LIST).isNotNull(), calls).otherwise(0)),
            "search_results": F.when(e == "perplexity", results).when(e == "gemini", chunks),
            "supports": F.when(e == "gemini", supports),
            "tokens_in": number("$.usage.input_tokens", "$.usageMetadata.promptTokenCount"),
            "tokens_out": number("$.usage.output_tokens", "$.usageMetadata.candidatesTokenCount"),
            "tokens_total": number("$.usage.total_tokens", "$.usageMetadata.totalTokenCount"),
        }
    )
    some = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return df.withColumn(
        "grounded",
        (F.size("citations") > 0) | (F.size("search_queries") > 0) | some("tool_calls") | some("search_results") | some("supports"),
    )


def _walk_keys(value, found: list[dict], path: str = "root") -> None:
    if value is None:
        return
    if isinstance(value, list):
        for i, item in enumerate(value):
            _walk_keys(item, found, f"{path}[{i}]")
        return
    if not isinstance(value, dict):
        return
    for key, child in value.items():
        if any(w in key.lower() for w in ("query", "search", "tool", "action")):
            kind = "array" if isinstance(child, list) else "object" if isinstance(child, dict) or child is None else (
                "string" if isinstance(child, str) else "boolean" if isinstance(child, bool) else "number"
            )
            found.append({"path": f"{path}.{key}", "kind": kind})
        if isinstance(child, (dict, list)):
            _walk_keys(child, found, f"{path}.{key}")


@F.pandas_udf(ST.ArrayType(ST.StructType([ST.StructField("path", ST.StringType()), ST.StructField("kind", ST.StringType())])))
def walk_keys(values: pd.Series) -> pd.Series:
    """Paths of search-related keys."""

    def one(text):
        found: list[dict] = []
        try:
            _walk_keys(json.loads(text), found)
        except (TypeError, ValueError):
            pass
        return found

    return values.map(one)


def payload_key_diagnostics(df: DataFrame, key: str, col: str = "payload") -> DataFrame:
    return df.select(key, "engine", F.explode(walk_keys(F.col(col))).alias("k")).select(key, "engine", "k.path", "k.kind")
