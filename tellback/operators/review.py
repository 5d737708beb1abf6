"""Delivery-log review: latest logs, engine statistics, review queue, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellback.functions import urls as U

WEAK_CITATION_ENGINES = ["gemini"]
SIGNALS = {"jsonld_only": "jsonld_only", "dual_source_missed": "dual"}


def latest_log(logs: DataFrame) -> DataFrame:
    """Newest file per URL with all its columns. The aggregate combines before the shuffle, so a hot URL stays cheap."""
    rest = [c for c in logs.columns if c not in ("url", "file_name")]
    newest = F.max_by(F.struct("file_name", *rest), "file_name")  # maps have no order, the file name has
    return logs.groupBy("url").agg(newest.alias("l")).select("url", "l.*")


def explode_engines(logs: DataFrame) -> DataFrame:
    """One row per log and engine, from the engines map."""
    return logs.select("url", "file_name", F.explode("engines").alias("engine", "e")).select("url", "file_name", "engine", "e.*")


def engine_stats(answers: DataFrame) -> DataFrame:
    ok = F.col("status") == "success"
    size = lambda c: F.sum(F.when(ok, F.size(c)).otherwise(0))
    return (
        answers.groupBy("engine")
        .agg(
            F.count(F.lit(1)).alias("urls"),
            F.count_if(ok).alias("urls_ok"),
            size("delivered").alias("fields_delivered"),
            (size("delivered") + size("missed")).alias("fields_total"),
        )
        .withColumn("delivery_pct", F.round(F.try_divide(F.col("fields_delivered") * 100.0, F.col("fields_total")), 1))
    )


def review_queue(answers: DataFrame) -> DataFrame:
    """Review items per URL and engine: (type, severity, items)."""
    ok = answers.filter("status = 'success'")
    delivered, missed = F.size("delivered"), F.size("missed")
    low = F.filter("missed", lambda m: m["confidence"] == "low")
    with_signal = lambda s: F.size(F.filter(low, lambda m: m["signal"] == s))
    other = F.size(F.filter(low, lambda m: ~m["signal"].isin("jsonld_only", "dual_source_missed")))
    uncertain = F.size(F.filter("subpages", lambda s: s["reached"] == "uncertain"))
    name_only = (delivered == 1) & (F.get("delivered", 0) == "entity_name") & (missed == 0)
    all_jsonld = F.size(F.filter("missed", lambda m: m["signal"] == "jsonld_only")) == missed
    lax = F.col("engine").isin(WEAK_CITATION_ENGINES)

    def item(kind: str, when: Column, severity: Column | str, count: Column) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(
            when, F.struct(F.lit(kind).alias("type"), level.alias("severity"), count.cast("bigint").alias("items"))
        )

    rules = F.array(
        item(
            "delivered_no_citation",
            (delivered > 0) & (F.col("citation_level") == "none"),
            F.when(name_only | lax, "info").otherwise("warn"),
            delivered,
        ),
        item("citation_host_only", F.col("citation_level") == "host_only", "info", F.lit(1)),
        item("jsonld_only_miss", with_signal("jsonld_only") > 0, "info", with_signal("jsonld_only")),
        item("dual_source_miss", with_signal("dual_source_missed") > 0, "review", with_signal("dual_source_missed")),
        item("missed_low_confidence", other > 0, "review", other),
        item("subpage_uncertain", uncertain > 0, "review", uncertain),
        item(
            "total_miss",
            (delivered == 0) & (missed > 0),
            F.when(all_jsonld, "info").otherwise("warn"),
            missed,
        ),
    )
    return ok.select("url", "engine", F.explode(F.array_compact(rules)).alias("r")).select("url", "engine", "r.*")


def delivery_comparison(answers: DataFrame, engines: list[str], own_paths: list[str], test_paths: list[str]) -> DataFrame:
    """URL by engine matrix of 'delivered/total level' cells, with the kind of page."""
    p = F.regexp_replace(U.path(F.col("url")), "(?<=.)/$", "")
    cell = F.when(
        F.col("status") == "success",
        F.concat(
            F.size("delivered").cast("string"), F.lit("/"), (F.size("delivered") + F.size("missed")).cast("string"),
            F.lit(" "), F.coalesce("citation_level", F.lit("none")),
        ),
    ).otherwise("ERR")
    kind = F.when(p.isin(own_paths), "own").when(p.isin(test_paths), "experiment").otherwise("external")
    wide = answers.withColumn("cell", cell).groupBy("url").pivot("engine", engines).agg(F.first("cell"))
    return wide.select("url", kind.alias("kind"), *[F.coalesce(e, F.lit("ERR")).alias(e) for e in engines])


ACTIONS = ["declare_facts", "fix_structure", "improve_consistency", "strengthen_citation"]


def official_source_report(answers: DataFrame, lint: DataFrame, facts: DataFrame) -> DataFrame:
    """Per target: citation levels, weak engines, structure state and next actions (up to four)."""
    rate = F.try_divide(F.size("delivered"), F.size("delivered") + F.size("missed"))
    level = F.coalesce("citation_level", F.lit("none"))
    per_url = answers.groupBy("url").agg(
        F.count(F.lit(1)).alias("engines_checked"),
        *[F.count_if(level == v).alias(f"cited_{v}") for v in ("exact", "path", "host_only", "none")],
        F.array_sort(F.collect_set(F.when(rate < 0.8, F.col("engine")))).alias("weak_engines"),
    )
    df = per_url.join(lint.select("url", "fail_count", "warn_count"), "url", "left").join(facts, "url", "left")
    fails, warns, n = (F.coalesce(c, F.lit(0)) for c in ("fail_count", "warn_count", "declared_facts"))
    wanted = [n == 0, (fails > 0) | (warns > 0), F.size("weak_engines") > 0, F.col("cited_exact") == 0]
    made = F.array_compact(F.array(*[F.when(c, F.lit(a)) for c, a in zip(wanted, ACTIONS)]))
    return df.select(
        "url", "engines_checked", "cited_exact", "cited_path", "cited_host_only", "cited_none", "weak_engines",
        n.alias("declared_facts"),
        F.when(fails > 0, F.concat(fails.cast("string"), F.lit(" blockers")))
        .when(warns > 0, F.concat(warns.cast("string"), F.lit(" warnings")))
        .otherwise("ready")
        .alias("structure"),
        F.when(F.size(made) > 0, made).otherwise(F.array(F.lit("keep_stable"))).alias("next_actions"),
    )


def text_report(report: DataFrame) -> DataFrame:
    """Report lines per target, numbered; the writer keeps their order."""
    lines = F.array(
        F.lit("Official source report"),
        F.concat(F.lit("Target: "), "url"),
        F.concat(F.lit("Declared facts: "), F.col("declared_facts").cast("string")),
        F.concat(F.lit("Structure: "), "structure"),
        F.concat(F.lit("Exact citations: "), F.col("cited_exact").cast("string"), F.lit("/"), F.col("engines_checked").cast("string")),
        F.concat(F.lit("Next actions: "), F.array_join("next_actions", ", ")),
    )
    return report.select("url", F.posexplode(lines).alias("line_no", "line"))


def preflight_summary(pages: DataFrame) -> DataFrame:
    """gt_positive / gt_absent / crawl_error counts and the pages with JSON-LD in each."""
    status = (
        F.when(F.col("error").isNotNull(), "crawl_error").when(F.col("field_count") > 0, "gt_positive").otherwise("gt_absent")
    )
    return pages.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("urls"),
        F.count_if(F.size("jsonld_types") > 0).alias("with_jsonld"),
        F.sum("field_count").alias("fields"),
    )
