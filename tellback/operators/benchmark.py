"""Benchmark analysis: engine joins, rates, feature impact, blockage catalog, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellback import dims
from tellback.operators.pages import keeps_title
from tellback.operators.walks import reached
from tellback.sources.numbering import numbered

ENGINES = ["gpt", "gemini", "perplexity"]


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row of each key; a max_by aggregate combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return picked.select(*keys, "last.*")


def left_engines(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages with one rate column per engine (NULL when absent); duplicate results: last wins."""
    wide = (
        latest_per_key(results, ["page_id", "engine"], "run_no")
        .groupBy("page_id")
        .pivot("engine", ENGINES)
        .agg(F.first("delivery_rate"))
    )
    return pages.select("page_id").join(wide, "page_id", "left")


def inner_success(pages: DataFrame, results: DataFrame) -> DataFrame:
    return pages.select("page_id", "url").join(results.filter("status = 'success'"), "page_id")


def resume(work: DataFrame, done: DataFrame, key: str, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows still to do, finished rows kept): finished ones are skipped unless refreshed."""
    if refresh:
        return work, done.join(work.select(key), key, "left_anti")
    return work.join(done.select(key).distinct(), key, "left_anti"), done


def page_rates(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Mean available engine rates per page, 0 when none, and the A/B/C group."""
    per_page = results.groupBy("page_id").agg(
        F.avg("delivery_rate").alias("d"), F.avg("extraction_rate").alias("e")
    )
    out = pages.select("page_id").join(per_page, "page_id", "left")
    # float sums depend on order; nine digits are beyond any rate, so groups stay stable
    d = F.round(F.coalesce("d", F.lit(0.0)), 9)
    return out.select(
        "page_id",
        F.round(d, 3).alias("avg_delivery_rate"),
        F.round(F.round(F.coalesce("e", F.lit(0.0)), 9), 3).alias("avg_extraction_rate"),
        F.when(d >= 0.75, "A").when(d >= 0.4, "B").otherwise("C").alias("rate_group"),
    )


def engine_summary(results: DataFrame) -> DataFrame:
    """Count, success, error; mean rates over successes (missing rates count as 0, as the divisor is successes)."""
    ok = F.col("status") == "success"
    mean = lambda c: F.coalesce(
        F.round(F.try_divide(F.sum(F.when(ok, F.coalesce(c, F.lit(0.0)))), F.count_if(ok)), 3), F.lit(0.0)
    )
    return results.groupBy("engine").agg(
        F.count(F.lit(1)).alias("results"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("errors"),
        mean("extraction_rate").alias("avg_extraction_rate"),
        mean("delivery_rate").alias("avg_delivery_rate"),
    )


def group_rollup(rates: DataFrame) -> DataFrame:
    groups = dims.small_table(rates.sparkSession, [("A",), ("B",), ("C",)], "rate_group")
    own = rates.groupBy("rate_group").agg(
        F.count(F.lit(1)).alias("pages"), F.round(F.avg("avg_delivery_rate"), 3).alias("mean_rate")
    )
    return groups.join(own, "rate_group", "left").select(
        "rate_group", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("mean_rate", F.lit(0.0)).alias("mean_rate")
    )


def long_features(features: DataFrame, names: list[str]) -> DataFrame:
    """page_id, feature, value - one row per feature."""
    cols = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    return features.select("page_id", *cols).unpivot("page_id", names, "feature", "value")


def group_feature_means(features: DataFrame, names: list[str], rates: DataFrame) -> DataFrame:
    mean = lambda g: F.round(
        F.coalesce(F.avg(F.when(F.col("rate_group") == g, F.col("value"))), F.lit(0.0)), 3
    )
    return (
        features_with_rates(features, names, rates)
        .groupBy("feature")
        .agg(mean("A").alias("group_a_mean"), mean("C").alias("group_c_mean"))
    )


def features_with_rates(features: DataFrame, names: list[str], rates: DataFrame) -> DataFrame:
    """Rates are joined to the wide rows, then unpivoted: one row per page in the shuffle, not one per feature."""
    wide = features.select("page_id", *names).join(rates.select("page_id", "avg_delivery_rate", "rate_group"), "page_id")
    cols = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    ids = ["page_id", "avg_delivery_rate", "rate_group"]
    return wide.select(*ids, *cols).unpivot(ids, names, "feature", "value")


def normal_cdf(x: Column) -> Column:
    """Normal distribution function by the erf polynomial of Abramowitz and Stegun 7.1.26."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    # The polynomial's coefficients.
    poly = ((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592
    erf = 1 - poly * t * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def correlation(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    """Aggregate columns (r, p) of a Pearson correlation with a Fisher-z p-value.

    Centred sums come from Spark's own variance and covariance aggregates, which
    merge partial results stably. Fewer than three pairs or a constant side: (0, 1).
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    pair = x.isNotNull() & y.isNotNull()
    n = F.count_if(pair)
    sx, sy = F.var_pop(F.when(pair, x)), F.var_pop(F.when(pair, y))
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(sx * sy))
    ok = (n >= 3) & (sx > 1e-18) & (sy > 1e-18)
    capped = F.least(F.lit(0.999999), F.greatest(F.lit(-0.999999), r))
    score = F.abs(0.5 * F.log((1 + capped) / (1 - capped))) * F.sqrt(F.greatest(n - 3, F.lit(1)).cast("double"))
    p = 2 * (1 - normal_cdf(score))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.when(ok, F.round(r, 4)).otherwise(0.0), F.when(ok, F.round(bounded, 6)).otherwise(1.0)


def feature_impact(features: DataFrame, names: list[str], rates: DataFrame) -> DataFrame:
    """Correlation of every feature with the delivery rate, strongest first; one aggregation for all features."""
    r, p = correlation("value", "avg_delivery_rate")
    mean = lambda g: F.round(
        F.coalesce(F.avg(F.when(F.col("rate_group") == g, F.col("value"))), F.lit(0.0)), 3
    )
    out = (
        features_with_rates(features, names, rates)
        .groupBy("feature")
        .agg(
            r.alias("correlation_r"), p.alias("p_value"), mean("A").alias("group_a_mean"), mean("C").alias("group_c_mean")
        )
    )
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature"))
    # a dozen rows after the aggregation, so one window partition is fine
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("correlation_r")), order)))


def engine_correlation(wide: DataFrame) -> DataFrame:
    """Pairwise correlation of engine rates; a missing rate counts as 0."""
    rate = lambda e: F.coalesce(F.col(e), F.lit(0.0))
    pairs = [("gpt", "gemini"), ("gpt", "perplexity"), ("gemini", "perplexity")]
    aggs = []
    for a, b in pairs:
        r, p = correlation(rate(a), rate(b))
        aggs.append(F.struct(F.lit(f"{a}_{b}").alias("pair"), r.alias("r"), p.alias("p_value")).alias(f"{a}_{b}"))
    one = wide.agg(*aggs)
    return one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.pair", "x.r", "x.p_value")


def field_difficulty(evaluated: DataFrame, engines: int = 3) -> DataFrame:
    """Success rate per field over all engines of pages that declare it, and how engines agree."""
    per_page = evaluated.groupBy("field", "page_id").agg(F.count_if("matched").alias("hits"))
    rate = F.sum("hits") / F.greatest(F.count(F.lit(1)) * engines, F.lit(1))
    return per_page.groupBy("field").agg(
        F.count(F.lit(1)).alias("eligible_pages"),
        F.round(rate, 3).alias("success_rate"),
        F.when(rate >= 0.8, "easy").when(rate >= 0.5, "medium").otherwise("hard").alias("difficulty"),
        *[
            F.count_if(F.col("hits") == n).alias(name)
            for n, name in ((3, "all_three"), (2, "two"), (1, "one"), (0, "none_matched"))
        ],
    )


# --- blockages --------------------------------------------------------------------
# What each finding means.
DEFINITIONS = [
    ("B001", "blockage", "infobox facts not delivered", "engines do not flatten complex infobox tables", "repeat the facts as a plain facts block and JSON-LD"),
    ("B002", "blockage", "no defining first sentence", "the entity definition is too weak to find type and description", "open with 'X is a Y company'"),
    ("I001", "pattern", "too little content", "the source holds too little material", "raise key facts into a facts block or FAQ"),
    ("I002", "pattern", "weak section structure", "few headings, meaning units are not separated", "add static headings such as overview, history, products"),
    ("I003", "pattern", "no plain facts block", "facts are not shown as key-value lines", "put name, founding, seat, head, service in a top block"),
]


def missed_per_answer(evaluated: DataFrame) -> DataFrame:
    """Missed fields per page and engine (a dozen at most), with the infobox-sourced ones apart."""
    missed = ~F.col("matched")
    return evaluated.groupBy("page_id", "engine").agg(
        F.array_sort(F.collect_list(F.when(missed, F.col("field")))).alias("missed"),
        F.array_sort(F.collect_list(F.when(missed & (F.col("source") == "infobox"), F.col("field")))).alias("missed_infobox"),
        F.round(F.count_if("matched") / F.count(F.lit(1)), 3).alias("delivery_rate"),
    )


def findings(per_answer: DataFrame, features: DataFrame) -> DataFrame:
    """Observed blockages and inferred patterns per page and engine, one row each."""
    df = per_answer.join(
        features.select("page_id", "word_count", "section_count", "has_infobox", "defines_entity"), "page_id"
    )
    missed, boxed = F.col("missed"), F.col("missed_infobox")
    words, n = F.col("word_count"), F.size("missed")
    vague = F.array_intersect(F.array(F.lit("entity_type"), F.lit("description")), missed)

    def finding(code: str, when: Column, fields: Column, evidence: Column) -> Column:
        return F.when(
            when, F.struct(F.lit(code).alias("finding_id"), fields.alias("fields"), evidence.alias("evidence"))
        )

    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    made = F.array(
        finding("B001", F.size(boxed) > 0, boxed, text("infobox source missed ", F.size(boxed).cast("string"))),
        finding("B002", (n > 0) & ~F.col("defines_entity") & (F.size(vague) > 0), vague, F.lit("no defining sentence")),
        finding(
            "I001",
            (words < 50) | ((words < 100) & (n >= 2)),
            missed,
            text("word_count ", F.when(words < 50, "(<50)").otherwise("(<100)")),
        ),
        finding(
            "I002",
            (F.col("section_count") <= 2) & (n >= 2),
            missed,
            text("section_count ", F.col("section_count").cast("string")),
        ),
        finding("I003", ~F.col("has_infobox") & (F.size(boxed) > 0), boxed, F.lit("facts only in an infobox")),
    )
    return df.select(
        "page_id", "engine", "delivery_rate", F.explode(F.array_compact(made)).alias("f")
    ).select("page_id", "engine", "delivery_rate", "f.*")


def blockage_catalog(found: DataFrame, samples: int = 5) -> DataFrame:
    """Per engine and finding: frequency, fields, example evidence, lowest-rate pages.

    Rows are first reduced to one per evidence text, a small closed set, so the
    few (engine, finding) groups never see the rows themselves. Sample pages come
    from a rank limit. ``found`` is read twice; pass a stored table.
    """
    keys = ["engine", "finding_id"]
    per_evidence = found.groupBy(*keys, "evidence").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("page_id").alias("first"),
        *[F.bool_or(F.array_contains("fields", f)).alias(f"_{f}") for f in dims.FIELDS],
    )
    fields = F.array_sort(F.array_compact(F.array(*[F.when(F.bool_or(f"_{f}"), F.lit(f)) for f in dims.FIELDS])))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("first", "evidence"))), lambda s: s["evidence"])
    counted = per_evidence.groupBy(*keys).agg(
        F.sum("n").alias("frequency"), fields.alias("fields"), F.slice(texts, 1, samples).alias("examples")
    )
    pages = (
        review_samples(found, samples)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda s: s["page_id"]).alias("sample_pages"))
    )
    return counted.join(pages, keys)


def review_samples(found: DataFrame, samples: int = 5) -> DataFrame:
    w = Window.partitionBy("engine", "finding_id").orderBy(F.coalesce("delivery_rate", F.lit(0.0)), "page_id")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= samples)
        .select("engine", "finding_id", "rank", "page_id", "delivery_rate")
    )


def catalog_top(found: DataFrame, top: int = 5) -> DataFrame:
    counts = found.groupBy("engine", F.substring("finding_id", 1, 1).alias("family"), "finding_id").agg(
        F.count(F.lit(1)).alias("frequency")
    )
    w = Window.partitionBy("engine", "family").orderBy(F.desc("frequency"), "finding_id")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def with_definitions(found: DataFrame) -> DataFrame:
    rows = [(d[0], d[1], d[2], d[3], d[4]) for d in DEFINITIONS]
    table = dims.small_table(found.sparkSession, rows, "finding_id", "kind", "label", "cause", "fix")
    return found.join(table, "finding_id")


# --- targets ---------------------------------------------------------------------
def target_bucket(df: DataFrame, not_company: list[int], absent: int = 49, sparse: int = 99) -> DataFrame:
    """exclude / sparse / weak / fill bucket of a page and its source group."""
    words, group = F.col("word_count"), F.col("rate_group")
    bucket = (
        F.when(F.col("page_id").isin(not_company), "exclude_non_company")
        .when(words <= absent, "exclude_content_absent")
        .when((group == "C") & (words <= sparse), "C_content_sparse")
        .when(group == "C", "C_structure_weak")
        .when(group == "B", "B_fill")
        .otherwise("ignore")
    )
    out = df.withColumn("bucket", bucket)
    return out.withColumn(
        "source_group", F.when(F.col("bucket").startswith("C_"), "C").when(F.col("bucket") == "B_fill", "B")
    )


def target_ranking(bucketed: DataFrame, total: int = 30) -> DataFrame:
    """The study's targets: weakest C pages first, B pages fill up to ``total``.

    orderBy + limit keeps only ``total`` rows per task before the last step.
    """
    picked = (
        bucketed.filter("source_group is not null")
        .orderBy(F.desc("source_group"), "avg_extraction_rate", "word_count", "page_id")
        .limit(total)
    )
    w = Window.orderBy(F.desc("source_group"), "avg_extraction_rate", "word_count", "page_id")
    return picked.withColumn("target_rank", F.row_number().over(w))


def target_summary(bucketed: DataFrame, total: int = 30) -> DataFrame:
    n = lambda b: F.count_if(F.col("bucket") == b)
    c_total = n("C_content_sparse") + n("C_structure_weak")
    return bucketed.agg(
        n("exclude_non_company").alias("excluded_non_company"),
        n("exclude_content_absent").alias("excluded_content_absent"),
        n("C_content_sparse").alias("c_content_sparse"),
        n("C_structure_weak").alias("c_structure_weak"),
        n("B_fill").alias("b_fill_available"),
        F.least(n("B_fill"), F.greatest(F.lit(total) - c_total, F.lit(0))).alias("b_fill_used"),
    )


def selection_summary(selected: DataFrame) -> DataFrame:
    """Counts by language, by tier, and in total, in one pass over the rows."""
    grouped = selected.groupingSets([["lang"], ["tier"], []], "lang", "tier")
    return grouped.agg(F.count(F.lit(1)).alias("pages")).select(
        F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("tier", F.lit("*")).alias("tier"), "pages"
    )


# Pages wanted per language and tier.
SELECTION_PLAN = [
    ("ko", "global_large", 5),
    ("ko", "national_mid", 25),
    ("ko", "small_startup", 20),
    ("ko", "sparse_stub", 25),
    ("en", "global_large", 5),
    ("en", "national_mid", 5),
    ("en", "small_startup", 5),
    ("en", "sparse_stub", 10),
]


def stratified_selection(candidates: DataFrame, plan: list[tuple] | None = None, total: int = 100) -> DataFrame:
    """Quota per stratum by score then stable hash rank; no title twice; the best leftovers fill the total.

    A title in several strata belongs to the first of the plan. Quotas and the
    total are small, so ranks are limited before the shuffles.
    """
    plan = plan or SELECTION_PLAN
    table = dims.small_table(
        candidates.sparkSession, [(*row, i) for i, row in enumerate(plan)], "lang", "tier", "quota", "plan_no"
    )
    ranked = candidates.join(table, ["lang", "tier"]).withColumn(
        "stable_rank", F.substring(F.sha1(F.concat_ws(":", "lang", "title")), 1, 12)
    )
    title = ["lang", "title"]
    pool = ranked.groupBy(*title).agg(
        F.min_by(F.struct("tier", "quota", "plan_no", "page_id", "selection_score", "stable_rank"), F.struct("plan_no", "page_id")).alias("p")
    ).select(*title, "p.*")
    best = [F.desc("selection_score"), "stable_rank", "page_id"]
    w = Window.partitionBy("plan_no").orderBy(*best)
    biggest = max(row[2] for row in plan)
    first = (
        pool.withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= biggest)
        .filter(F.col("n") <= F.col("quota"))
        .withColumn("phase", F.lit("quota"))
    )
    rest = pool.join(first.select(*title), title, "left_anti").orderBy(*best).limit(total)
    rest = rest.withColumn("n", F.row_number().over(Window.orderBy(*best))).withColumn("phase", F.lit("fill"))
    both = first.select("phase", "plan_no", "n", *title, "tier", "page_id", "selection_score").unionByName(
        rest.select("phase", "plan_no", "n", *title, "tier", "page_id", "selection_score")
    )
    order = Window.orderBy(F.desc("phase"), F.when(F.col("phase") == "quota", F.col("plan_no")).otherwise(0), "n")
    return both.withColumn("pick_no", F.row_number().over(order)).filter(F.col("pick_no") <= total)


def category_walk(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = 2, fan_out: int | None = None, per_seed: int | None = None
) -> DataFrame:
    """Distinct pages below seed categories: (parent, child, kind) edges, down to ``max_depth``, or as far as they go (None).

    ``fan_out`` and ``per_seed`` keep the first sub-categories and pages when given.
    """
    subs = edges.filter("kind = 'category'").select("parent", "child")
    if fan_out is not None:
        subs = numbered(subs, ["parent"], F.col("child"), limit=fan_out).drop("n")
    below = reached(subs, seeds, max_depth).withColumnRenamed("node", "category")
    pages = edges.filter("kind = 'page'").select(F.col("parent").alias("category"), F.col("child").alias("title"))
    found = (
        below.join(pages, "category")
        .filter(keeps_title(F.col("title")))
        .groupBy("seed", "title")
        .agg(F.min("depth").alias("depth"))
        .withColumn("stable_rank", F.substring(F.sha1("title"), 1, 12))
    )
    return numbered(found, ["seed"], F.col("stable_rank"), F.col("title"), name="rank", limit=per_seed)


def rehydrate(stored: DataFrame, recomputed: DataFrame, version: str) -> DataFrame:
    """Stored truth where its version is current, else the recomputed truth."""
    current = stored.filter(F.col("version") == version).select("page_id", "field", "value_text")
    stale = recomputed.join(current.select("page_id").distinct(), "page_id", "left_anti")
    return current.withColumn("origin", F.lit("stored")).unionByName(
        stale.select("page_id", "field", "value_text").withColumn("origin", F.lit("recomputed"))
    )


# --- experiment stages -------------------------------------------------------------
STAGES = ["original", "step_a", "step_b", "step_c", "step_d"]


def stage_metrics(runs: DataFrame) -> DataFrame:
    """Mean rates per page and stage; missing rates are skipped."""
    return runs.groupBy("page_id", "stage_no").agg(
        F.round(F.avg("delivery_rate"), 3).alias("delivery_rate"),
        F.round(F.avg("extraction_rate"), 3).alias("extraction_rate"),
        F.bool_or("applied").alias("applied"),
    )


def step_progression(stages: DataFrame) -> DataFrame:
    """Change against the last earlier stage that has a rate. Five rows per page."""
    w = Window.partitionBy("page_id").orderBy("stage_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("delivery_rate", ignorenulls=True).over(w)
    return stages.withColumn("delta", F.round(F.col("delivery_rate") - before, 3))


def best_step(progress: DataFrame) -> DataFrame:
    """Step with the largest change per page (first on a tie), total change, threshold flag."""
    later = F.col("stage_no") > 0
    key = F.struct(F.col("delta"), (-F.col("stage_no")).alias("s"))
    last, first = F.max(F.when(F.col("stage_no") == 4, F.col("delivery_rate"))), F.max(F.when(F.col("stage_no") == 0, F.col("delivery_rate")))
    out = progress.groupBy("page_id").agg(
        F.max(F.when(later & F.col("delta").isNotNull(), key)).alias("best"),
        F.round(last - first, 3).alias("total_improvement"),
        (last >= 0.75).alias("reached_threshold"),
    )
    name = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (1 - F.col("best.s")).cast("int"))
    return out.select("page_id", name.alias("best_stage"), F.col("best.delta").alias("best_delta"), "total_improvement", "reached_threshold")


def step_effectiveness(progress: DataFrame) -> DataFrame:
    return progress.groupBy("stage_no").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("applied").alias("applied_pages"),
        F.round(F.avg("delivery_rate"), 3).alias("avg_delivery_rate"),
        F.round(F.avg("extraction_rate"), 3).alias("avg_extraction_rate"),
        F.round(F.avg("delta"), 3).alias("avg_delta"),
    )


def calibration_wide(stages: DataFrame) -> DataFrame:
    wide = stages.groupBy("page_id").pivot("stage_no", list(range(5))).agg(
        F.first("delivery_rate").alias("delivery"), F.first("extraction_rate").alias("extraction")
    )
    return wide.select(
        "page_id",
        *[
            F.col(f"{i}_{kind}").alias(f"{stage}_{kind}")
            for i, stage in enumerate(STAGES)
            for kind in ("delivery", "extraction")
        ],
    )


def experiment_summary(best: DataFrame, wide: DataFrame, buckets: DataFrame) -> DataFrame:
    df = wide.join(best, "page_id").join(buckets, "page_id")
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    return df.agg(
        F.count(F.lit(1)).alias("targets"),
        *[F.count_if(F.col("bucket") == b).alias(b.lower()) for b in ("C_content_sparse", "C_structure_weak", "B_fill")],
        mean("original_delivery").alias("avg_original_rate"),
        mean("step_d_delivery").alias("avg_final_rate"),
        mean("total_improvement").alias("avg_improvement"),
        F.count_if("reached_threshold").alias("reached_threshold"),
    )


def consensus_facts(infobox: DataFrame, votes: DataFrame) -> DataFrame:
    """Infobox value of a field, else the value most engines gave (first engine wins ties)."""
    tally = votes.groupBy("page_id", "field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("engine_no").alias("first_engine")
    )
    winner = tally.groupBy("page_id", "field").agg(
        F.max_by("value", F.struct("n", (-F.col("first_engine")).alias("e"))).alias("voted")
    )
    return (
        infobox.select("page_id", "field", F.col("value").alias("boxed"))
        .join(winner, ["page_id", "field"], "full_outer")
        .select(
            "page_id", "field", F.coalesce("boxed", "voted").alias("value"),
            F.when(F.col("boxed").isNotNull(), "infobox").otherwise("vote").alias("origin"),
        )
    )
