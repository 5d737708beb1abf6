"""Cited sources: type and authority, fit with the entity's archetype, coverage of planned queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import text as T
from tellback.functions import urls as U

PRECEDENCE = ["docs", "wiki", "news", "directory", "community", "social", "blog"]
DOC_PREFIXES = "^(docs|developer|developers|support|help|kb|knowledgebase)\\."


def _domain_map() -> Column:
    pairs = [(d, t) for t, ds in dims.SOURCE_DOMAINS.items() for d in ds]
    return T.literal_map(pairs)


def source_of(url: Column, official_domain: Column) -> Column:
    """Type, authority and host of a citation as a struct.

    The host's own suffixes are looked up in the domain table, so matching is by
    equality; the first type in precedence order wins.
    """
    table = _domain_map()

    def types(h: Column) -> Column:
        labels = F.split(h, "\\.")
        found = F.transform(labels, lambda _, i: table[F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")])
        by_prefix = F.array(
            F.when(h.rlike(DOC_PREFIXES), "docs"),
            F.when(h.rlike("^(news|press)\\.|\\.news\\."), "news"),
            F.when(h.startswith("blog."), "blog"),
        )
        return F.filter(F.concat(found, by_prefix), lambda t: t.isNotNull())

    def typed(h: Column) -> Column:
        known = T.let(types(h), lambda ts: F.get(F.array_intersect(T.literal_list(PRECEDENCE), ts), 0))
        return (
            F.when(h == "", "unknown")
            .when(U.same_or_subdomain(h, official_domain), "official")
            .otherwise(F.coalesce(known, F.lit("unknown")))
        )

    def build(x: Column) -> Column:
        minor = (x["type"] == "wiki") & x["host"].rlike("(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in dims.MINOR_WIKIS) + ")$")
        tier = T.literal_map((t, tier) for t, (tier, _) in dims.AUTHORITY.items())
        score = T.literal_map((t, s) for t, (_, s) in dims.AUTHORITY.items())
        return F.struct(
            x["host"].alias("host"),
            x["type"].alias("type"),
            F.when(minor, dims.MINOR_WIKI_AUTHORITY[0]).otherwise(tier[x["type"]]).alias("tier"),
            F.when(minor, dims.MINOR_WIKI_AUTHORITY[1]).otherwise(score[x["type"]]).alias("score"),
            (x["type"] == "official").alias("official"),
        )

    return T.let(
        U.bare_host(url),
        lambda h: T.let(F.struct(h.alias("host"), typed(h).alias("type")), build),
    )


def citation_details(df: DataFrame, citations: str = "citations", domain: str = "official_domain") -> DataFrame:
    """Distinct citations of a response with their source facts, kept inside the row."""
    unique = T.distinct_strings(F.col(citations))
    return df.withColumn(
        "details",
        F.transform(unique, lambda c: F.struct(c.alias("url"), source_of(c, F.col(domain)).alias("s"))),
    )


def citation_metrics(df: DataFrame) -> DataFrame:
    """Total, official, unofficial citations, official ratio and source mix per response."""
    total = F.size("details")
    official = F.size(F.filter("details", lambda d: d["s"]["official"]))
    out = df.withColumns(
        {
            "citations_total": total.cast("bigint"),
            "citations_official": official.cast("bigint"),
            "official_ratio": F.round(F.try_divide(official, total), 4),
        }
    )
    t, o = F.col("citations_total"), F.col("citations_official")
    return out.withColumns(
        {
            "source_mix": F.when(t == 0, "none")
            .when(o == t, "official_only")
            .when(o == 0, "third_party_only")
            .otherwise("mixed"),
            "mix_dominant": F.when(t == 0, "none").when(o >= t - o, "official").otherwise("third_party"),
        }
    )


def source_archetype(entities: DataFrame, text: str = "archetype_text") -> DataFrame:
    """Archetype with the most keyword hits; ties go to the earlier one, no hit is general business."""
    low = F.lower(F.col(text))
    hits = lambda words: F.size(F.filter(T.literal_list(words), lambda w: F.contains(low, w)))
    ranked = F.array(
        *[
            F.struct(hits(words).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("archetype"))
            for i, (name, words) in enumerate(dims.ARCHETYPE_WORDS.items())
        ]
    )
    best = F.array_max(ranked)
    return entities.withColumns(
        {
            "archetype": F.when(best["hits"] > 0, best["archetype"]).otherwise("general_business"),
            "archetype_hits": best["hits"].cast("bigint"),
        }
    )


def weight_map() -> Column:
    """'archetype/type' -> fit weight."""
    return T.literal_map((f"{a}/{t}", w) for a, ws in dims.FIT_WEIGHTS.items() for t, w in ws.items())


def fit_weight(archetype: Column, source_type: Column) -> Column:
    table = weight_map()
    return F.coalesce(
        table[F.concat(archetype, F.lit("/"), source_type)], table[F.concat(archetype, F.lit("/default"))]
    )


def _most(values: Column) -> Column:
    """Most frequent value of a short list, the first seen on a tie."""
    return T.let(
        values,
        lambda vs: F.array_max(
            F.transform(
                F.array_distinct(vs),
                lambda v, i: F.struct(F.size(F.filter(vs, lambda x: x == v)).alias("n"), (-i).alias("o"), v.alias("v")),
            )
        )["v"],
    )


def source_profile(df: DataFrame) -> DataFrame:
    """Type and tier counts, dominants, fit and quality means, coverage and fit status per response."""
    df = df.withColumn(
        "_w",
        F.transform(
            "details",
            lambda d: F.struct(
                d["s"]["type"].alias("type"), d["s"]["tier"].alias("tier"), d["s"]["score"].alias("score"),
                d["s"]["official"].alias("official"), fit_weight(F.col("archetype"), d["s"]["type"]).alias("fit"),
            ),
        ),
    )
    total = F.size("_w")
    # nine digits first: float noise of the sum must not decide a tie of the last digit
    mean = lambda of: F.round(
        F.round(F.try_divide(F.aggregate("_w", F.lit(0.0).cast("double"), lambda acc, d: acc + of(d)), total), 9), 4
    )
    count = lambda test: F.size(F.filter("_w", test)).cast("bigint")
    df = df.withColumns(
        {
            "dominant_type": F.coalesce(_most(F.transform("_w", lambda d: d["type"])), F.lit("none")),
            "tier_high": count(lambda d: d["tier"] == "high"),
            "tier_medium": count(lambda d: d["tier"] == "medium"),
            "tier_low": count(lambda d: d["tier"] == "low"),
            "authority_average": mean(lambda d: d["score"]),
            "fit_average": mean(lambda d: d["fit"]),
            "quality_average": mean(lambda d: d["fit"] * d["score"]),
            "expected_sources": count(lambda d: d["fit"] >= 0.7),
            "off_pattern": count(lambda d: d["fit"] < 0.45),
            "_official": count(lambda d: d["official"]),
            "_n": total.cast("bigint"),
        }
    )
    h, m, lo = F.col("tier_high"), F.col("tier_medium"), F.col("tier_low")
    fit, n = F.col("fit_average"), F.greatest(F.col("_n"), F.lit(1))
    preferred = F.col("archetype").isin(dims.OFFICIAL_PREFERRED)
    return df.withColumns(
        {
            "dominant_tier": F.when((h >= m) & (h >= lo) & (h > 0), "high")
            .when((m >= lo) & (m > 0), "medium")
            .when(lo > 0, "low")
            .otherwise("none"),
            "fit_status": F.when(F.col("_n") == 0, "none")
            .when((F.col("_official") == 0) & preferred & (fit >= 0.55), "official_gap")
            .when((fit >= 0.72) & (F.col("expected_sources") / n >= 0.5), "strong")
            .when((F.col("off_pattern") / n >= 0.5) | (fit < 0.45), "off_pattern")
            .otherwise("mixed"),
        }
    ).drop("_w", "_official", "_n")


def query_coverage(df: DataFrame) -> DataFrame:
    """How much of the planned searches was observed."""
    planned, observed = F.col("planned_queries"), F.size(T.distinct_strings(F.col("search_queries")))
    ratio = F.round(F.least(observed / planned, F.lit(1.0)), 4)
    active = F.col("grounded") | F.col("tool_calls").isNotNull() | F.col("search_results").isNotNull() | (F.col("citations_total") > 0)
    return df.withColumns(
        {
            "observed_queries": observed.cast("bigint"),
            "coverage_ratio": F.when(planned > 0, F.when(observed > 0, ratio).otherwise(0.0)),
            "coverage_status": F.when(planned == 0, "none")
            .when((observed > 0) & (ratio >= 0.6), "strong")
            .when(observed > 0, "partial")
            .when(active, "opaque")
            .otherwise("none"),
        }
    )
