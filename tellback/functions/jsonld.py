"""JSON-LD documents as variant arrays, read in the row without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellback.functions.text import let

NO_DOCS = "array<variant>"


def _items(doc: Column, path: str) -> Column:
    """Items of an array at a path, an empty list when there is none."""
    return F.coalesce(F.try_variant_get(doc, F.lit(path), NO_DOCS), F.array().cast(NO_DOCS))


def _usable(docs: Column) -> Column:
    return F.filter(docs, lambda d: d.isNotNull() & ~F.is_variant_null(d))


def parsed(blocks: Column) -> Column:
    """Documents of all parseable blocks; a block that is an array gives its items."""
    roots = F.filter(F.transform(blocks, F.try_parse_json), lambda v: v.isNotNull())
    return F.flatten(
        F.transform(roots, lambda v: F.coalesce(F.try_variant_get(v, F.lit("$"), NO_DOCS), F.array(v)))
    )


def graph_or_self(blocks: Column) -> Column:
    """One level: a document with @graph is replaced by the graph's items."""
    return _usable(
        F.flatten(
            F.transform(
                parsed(blocks),
                lambda d: F.coalesce(F.try_variant_get(d, F.lit("$['@graph']"), NO_DOCS), F.array(d)),
            )
        )
    )


def graph_and_self(blocks: Column, depth: int | None = None) -> Column:
    """Every document and, level by level, the items of its @graph; to any depth, or ``depth`` levels.

    A list within a list gives its items on the next level. Each level opens a bracket of its own, so a row takes as many steps as its
    fullest block has brackets.
    """
    documents = lambda level: F.filter(level, lambda d: F.try_variant_get(d, F.lit("$"), NO_DOCS).isNull())
    below = lambda level: F.flatten(F.transform(level, lambda d: F.coalesce(F.try_variant_get(d, F.lit("$"), NO_DOCS), _items(d, "$['@graph']"))))
    most = F.coalesce(F.array_max(F.transform(blocks, lambda b: F.length(b) - F.length(F.replace(b, F.lit("["), F.lit(""))))), F.lit(0))
    steps = most if depth is None else F.least(most, F.lit(depth))

    def step(state: Column, _: Column) -> Column:
        def on(level: Column) -> Column:
            return F.struct(level.alias("level"), F.concat(state["every"], documents(level)).alias("every"))

        return F.when(F.size(state["level"]) > 0, let(below(state["level"]), on)).otherwise(state)

    def walked(first: Column) -> Column:
        start = F.struct(first.alias("level"), documents(first).alias("every"))
        return F.aggregate(F.filter(F.sequence(F.lit(0), steps), lambda i: i > 0), start, step, lambda s: s["every"])

    return _usable(let(parsed(blocks), walked))


def text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, F.lit(path), "string")


def kind(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(doc, F.lit(path), "variant"))


def strings(doc: Column, path: str) -> Column:
    """A string or a list of strings as a list."""
    return F.filter(
        F.coalesce(
            F.try_variant_get(doc, F.lit(path), "array<string>"),
            F.array(F.try_variant_get(doc, F.lit(path), "string")),
        ),
        lambda s: s.isNotNull() & (s != ""),
    )


def types(doc: Column) -> Column:
    return strings(doc, "$['@type']")


def count_items(doc: Column, path: str) -> Column:
    """Length of an array, 1 for a single value, 0 when absent."""
    one = F.coalesce(text(doc, path), F.lit(""))
    return F.coalesce(
        F.size(F.try_variant_get(doc, F.lit(path), NO_DOCS)), F.when(one != "", 1).otherwise(0)
    )


def signals(blocks: Column, fact_keys: list[str]) -> Column:
    """Types, FAQ, hasPart, significantLink, sameAs and fact-field counts as one struct."""

    def total(docs: Column, of) -> Column:
        return F.aggregate(docs, F.lit(0), lambda acc, d: acc + of(d))

    def facts(doc: Column) -> Column:
        filled = [
            F.when(F.coalesce(text(doc, f"$['{k}']"), F.lit("")) != "", 1).otherwise(0) for k in fact_keys
        ]
        out = filled[0]
        for one in filled[1:]:
            out = out + one
        return out

    def build(docs: Column) -> Column:
        return F.struct(
            F.array_sort(F.array_distinct(F.flatten(F.transform(docs, types)))).alias("types"),
            total(docs, lambda d: F.size(F.filter(types(d), lambda t: t == "FAQPage"))).cast("bigint").alias("faq_count"),
            total(docs, lambda d: count_items(d, "$.hasPart")).cast("bigint").alias("has_part_count"),
            total(docs, lambda d: count_items(d, "$.significantLink")).cast("bigint").alias("significant_link_count"),
            total(docs, lambda d: count_items(d, "$.sameAs")).cast("bigint").alias("same_as_count"),
            total(docs, facts).cast("bigint").alias("fact_field_count"),
        )

    return let(graph_and_self(blocks), build)
