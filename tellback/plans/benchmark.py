"""Queries over benchmark results, targets and experiment stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import text as T
from tellback.operators import benchmark as A
from tellback.operators import experiment as E
from tellback.operators import pages as P
from tellback.plans import delivery as PD
from tellback.plans import osql as O
from tellback.plans import pages as PP
from tellback.plans.fixtures import _view, table, view
from tellback.plans.registry import query
from tellback.sources.sinks import store

B = chr(92)

_view(
    "fv_results",
    [],
    """
SELECT p.page_id, e.engine, e.engine_no, r.run_no,
  CASE WHEN (p.page_id + e.engine_no * 2 + r.run_no) % 9 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN (p.page_id + e.engine_no) % 13 = 0 THEN NULL ELSE CAST((p.page_id * 7 + e.engine_no * (3 + p.page_id % 4) + r.run_no * 5) % 21 AS DOUBLE) / 20 END AS delivery_rate,
  CAST((p.page_id * 5 + e.engine_no * 2 + r.run_no) % 13 AS DOUBLE) / 12 AS extraction_rate
FROM pages p CROSS JOIN (VALUES ('gpt',1),('gemini',2),('perplexity',3)) AS e(engine, engine_no) CROSS JOIN (VALUES (1),(2)) AS r(run_no)
WHERE (p.page_id + e.engine_no) % 7 <> 0 AND (r.run_no = 1 OR p.page_id % 4 = 0)
""",
)

LATEST = "res AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, engine ORDER BY run_no DESC) AS rn FROM fv_results) t WHERE rn = 1)"
WIDE = "wide AS MATERIALIZED (SELECT p.page_id, max(CASE WHEN engine = 'gpt' THEN delivery_rate END) AS gpt, max(CASE WHEN engine = 'gemini' THEN delivery_rate END) AS gemini, max(CASE WHEN engine = 'perplexity' THEN delivery_rate END) AS perplexity FROM pages p LEFT JOIN res r ON r.page_id = p.page_id GROUP BY p.page_id)"
RATES = """rates AS MATERIALIZED (SELECT page_id, round(d, 3) AS avg_delivery_rate, round(e, 3) AS avg_extraction_rate, CASE WHEN d >= 0.75 THEN 'A' WHEN d >= 0.4 THEN 'B' ELSE 'C' END AS rate_group
   FROM (SELECT p.page_id, round(coalesce(avg(delivery_rate), 0.0::DOUBLE), 9) AS d, round(coalesce(avg(extraction_rate), 0.0::DOUBLE), 9) AS e FROM pages p LEFT JOIN res r ON r.page_id = p.page_id GROUP BY p.page_id) t)"""


def results(spark, sf_dir):
    return view(spark, sf_dir, "fv_results")


def latest(spark, sf_dir):
    return A.latest_per_key(results(spark, sf_dir), ["page_id", "engine"], "run_no")


def page_rates_of(spark, sf_dir):
    return A.page_rates(latest(spark, sf_dir), table(spark, sf_dir, "pages"))


def features_of(spark, sf_dir):
    return P.structural_features(view(spark, sf_dir, "fv_rich"))


# --- joins -----------------------------------------------------------------------
@query("pages_left_engines", ["fv_results"], "SELECT page_id, gpt, gemini, perplexity FROM wide", [LATEST, WIDE])
def pages_left_engines(spark, sf_dir):
    return A.left_engines(table(spark, sf_dir, "pages"), results(spark, sf_dir))


@query(
    "pages_inner_success",
    ["fv_results"],
    "SELECT p.page_id, p.url, r.engine, CAST(r.run_no AS BIGINT) AS run_no, r.delivery_rate FROM pages p JOIN fv_results r ON r.page_id = p.page_id WHERE r.status = 'success'",
)
def pages_inner_success(spark, sf_dir):
    df = A.inner_success(table(spark, sf_dir, "pages"), results(spark, sf_dir))
    return df.select("page_id", "url", "engine", F.col("run_no").cast("int").alias("run_no"), "delivery_rate")


@query(
    "resume_anti_join",
    ["fv_results"],
    "SELECT page_id, 'todo' AS state FROM pages WHERE page_id NOT IN (SELECT page_id FROM fv_results WHERE engine = 'gpt' AND status = 'success') UNION ALL SELECT DISTINCT page_id, 'done' FROM fv_results WHERE engine = 'gpt' AND status = 'success'",
)
def resume_anti_join(spark, sf_dir):
    done = results(spark, sf_dir).filter("engine = 'gpt' and status = 'success'").select("page_id").distinct()
    todo, kept = A.resume(table(spark, sf_dir, "pages").select("page_id"), done, "page_id")
    return todo.withColumn("state", F.lit("todo")).unionByName(kept.withColumn("state", F.lit("done")))


@query(
    "classification_features",
    ["fv_rich", "fv_results"],
    "SELECT r.page_id, r.rate_group, r.avg_delivery_rate, f.word_count, f.section_count, f.has_infobox FROM rates r LEFT JOIN feat f USING (page_id)",
    [LATEST, RATES, *PP.FEATURE_CTES],
)
def classification_features(spark, sf_dir):
    f = features_of(spark, sf_dir).select("page_id", "word_count", "section_count", "has_infobox")
    return page_rates_of(spark, sf_dir).drop("avg_extraction_rate").join(f, "page_id", "left")


# --- rates ------------------------------------------------------------------------
@query(
    "engine_summary",
    ["fv_results"],
    """SELECT engine, count(*) AS results, CAST(count_if(status = 'success') AS BIGINT) AS success, CAST(count_if(status <> 'success') AS BIGINT) AS errors,
  round(sum(CASE WHEN status = 'success' THEN extraction_rate END) / count_if(status = 'success'), 3) AS avg_extraction_rate, round(sum(CASE WHEN status = 'success' THEN coalesce(delivery_rate, 0) END) / count_if(status = 'success'), 3) AS avg_delivery_rate FROM fv_results GROUP BY engine""",
)
def engine_summary(spark, sf_dir):
    return A.engine_summary(results(spark, sf_dir))


@query(
    "page_rates",
    ["fv_results"],
    "SELECT page_id, avg_delivery_rate, avg_extraction_rate, rate_group FROM rates",
    [LATEST, RATES],
)
def page_rates(spark, sf_dir):
    return page_rates_of(spark, sf_dir)


@query(
    "group_rollup",
    ["fv_results"],
    "SELECT g.rate_group, count(r.page_id) AS pages, coalesce(round(avg(r.avg_delivery_rate), 3), 0) AS mean_rate FROM (VALUES ('A'),('B'),('C')) AS g(rate_group) LEFT JOIN rates r ON r.rate_group = g.rate_group GROUP BY 1",
    [LATEST, RATES],
)
def group_rollup(spark, sf_dir):
    return A.group_rollup(page_rates_of(spark, sf_dir))


IMPACT_FEATURES = [f for f in PP.FEATURES if f != "avg_paragraph_length"]
_UNP = " UNION ALL ".join(
    f"SELECT f.page_id, '{n}' AS feature, {i} AS fno, CAST(f.{n} AS DOUBLE) AS value, r.avg_delivery_rate AS rate, r.rate_group FROM feat f JOIN rates r USING (page_id)"
    for i, n in enumerate(IMPACT_FEATURES)
)


def corr_sql(x: str, y: str) -> tuple[str, str]:
    r = f"(covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})))"
    ok = f"(count(*) >= 3 AND var_pop({x}) > 1e-18 AND var_pop({y}) > 1e-18)"
    c = f"least(0.999999::DOUBLE, greatest(-0.999999::DOUBLE, {r}))"
    z = f"(abs(0.5::DOUBLE * ln((1 + {c}) / (1 - {c}))) * sqrt(CAST(greatest(count(*) - 3, 1) AS DOUBLE)) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * {z}))"
    erf = f"(1 - (((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t}) + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t} * exp(-{z} * {z}))"
    p = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * (1 - 0.5::DOUBLE * (1 + {erf}))))"
    return f"CASE WHEN {ok} THEN round({r}, 4) ELSE 0.0::DOUBLE END", f"CASE WHEN {ok} THEN round({p}, 6) ELSE 1.0::DOUBLE END"


_R, _P = corr_sql("value", "rate")
IMPACT_CTES = [
    LATEST,
    RATES,
    *PP.FEATURE_CTES,
    f"unp AS MATERIALIZED ({_UNP})",
    f"""imp AS MATERIALIZED (SELECT feature, fno, {_R} AS correlation_r, {_P} AS p_value, round(coalesce(avg(CASE WHEN rate_group = 'A' THEN value END), 0), 3) AS group_a_mean, round(coalesce(avg(CASE WHEN rate_group = 'C' THEN value END), 0), 3) AS group_c_mean FROM unp GROUP BY feature, fno)""",
]


@query(
    "feature_impact",
    ["fv_rich", "fv_results"],
    "SELECT row_number() OVER (ORDER BY abs(correlation_r) DESC, fno) AS rank, feature, correlation_r, p_value, group_a_mean, group_c_mean FROM imp",
    IMPACT_CTES,
)
def feature_impact(spark, sf_dir):
    return A.feature_impact(features_of(spark, sf_dir), IMPACT_FEATURES, page_rates_of(spark, sf_dir))


@query(
    "group_feature_means",
    ["fv_rich", "fv_results"],
    "SELECT feature, group_a_mean, group_c_mean FROM imp",
    IMPACT_CTES,
)
def group_feature_means(spark, sf_dir):
    return A.group_feature_means(features_of(spark, sf_dir), IMPACT_FEATURES, page_rates_of(spark, sf_dir))


_QR, _QP = corr_sql("l.quality", "d.n")


@query(
    "label_correlation",
    [],
    f"SELECT d.lang, {_QR} AS r, {_QP} AS p_value, count(*) AS docs FROM (SELECT doc_id, quality::DOUBLE AS quality FROM labels) l JOIN (SELECT doc_id, lang, n_chars::DOUBLE AS n FROM documents) d ON d.doc_id = l.doc_id GROUP BY d.lang",
)
def label_correlation(spark, sf_dir):
    # the same statistic on the labelled documents: length against quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    r, p = A.correlation("quality", "n")
    return labels.join(docs, "doc_id").groupBy("lang").agg(r.alias("r"), p.alias("p_value"), F.count(F.lit(1)).alias("docs"))


def _pair_sql(a: str, b: str) -> str:
    r, p = corr_sql("x", "y")
    return f"SELECT '{a}_{b}' AS pair, {r} AS r, {p} AS p_value FROM (SELECT coalesce({a}, 0.0::DOUBLE) AS x, coalesce({b}, 0.0::DOUBLE) AS y FROM wide) t"


@query(
    "engine_correlation",
    ["fv_results"],
    " UNION ALL ".join(_pair_sql(a, b) for a, b in (("gpt", "gemini"), ("gpt", "perplexity"), ("gemini", "perplexity"))),
    [LATEST, WIDE],
)
def engine_correlation(spark, sf_dir):
    return A.engine_correlation(A.left_engines(table(spark, sf_dir, "pages"), results(spark, sf_dir)))


DIFF_CTES = PD.EVAL_CTES + [
    """fd AS MATERIALIZED (SELECT field, count(*) AS eligible_pages, round(sum(hits)::DOUBLE / (count(*) * 3), 3) AS success_rate, sum(hits)::DOUBLE / (count(*) * 3) AS sr,
   CAST(count_if(hits = 3) AS BIGINT) AS all_three, CAST(count_if(hits = 2) AS BIGINT) AS two, CAST(count_if(hits = 1) AS BIGINT) AS one, CAST(count_if(hits = 0) AS BIGINT) AS none_matched
  FROM (SELECT field, page_id, count_if(matched) AS hits FROM ev GROUP BY ALL) t GROUP BY field)"""
]


@query(
    "field_difficulty",
    ["fv_truth", "fv_extract"],
    "SELECT field, eligible_pages, success_rate, CASE WHEN sr >= 0.8 THEN 'easy' WHEN sr >= 0.5 THEN 'medium' ELSE 'hard' END AS difficulty FROM fd",
    DIFF_CTES,
)
def field_difficulty(spark, sf_dir):
    return A.field_difficulty(PD.evaluated(spark, sf_dir)).select("field", "eligible_pages", "success_rate", "difficulty")


@query(
    "engine_agreement",
    ["fv_truth", "fv_extract"],
    "SELECT field, all_three, two, one, none_matched FROM fd",
    DIFF_CTES,
)
def engine_agreement(spark, sf_dir):
    return A.field_difficulty(PD.evaluated(spark, sf_dir)).select("field", "all_three", "two", "one", "none_matched")


@query(
    "hardest_fields",
    ["fv_truth", "fv_extract"],
    "SELECT field, success_rate FROM fd ORDER BY success_rate, field LIMIT 5",
    DIFF_CTES,
)
def hardest_fields(spark, sf_dir):
    df = A.field_difficulty(PD.evaluated(spark, sf_dir)).select("field", "success_rate")
    return df.orderBy("success_rate", "field").limit(5)


# --- blockages -----------------------------------------------------------------------
FIND_CTES = (
    PD.EVAL_CTES
    + PP.FEATURE_CTES
    + [
        """pa AS MATERIALIZED (SELECT page_id, engine, list_sort(list_filter(list(CASE WHEN NOT matched THEN field END), lambda f: f IS NOT NULL)) AS missed,
    list_sort(list_filter(list(CASE WHEN NOT matched AND field IN ('founded', 'headquarters', 'key_products') THEN field END), lambda f: f IS NOT NULL)) AS boxed, round(count_if(matched)::DOUBLE / count(*), 3) AS delivery_rate FROM ev GROUP BY ALL)""",
        """paf AS MATERIALIZED (SELECT p.*, f.word_count, f.section_count, f.has_infobox, f.defines_entity, list_filter(['entity_type', 'description'], lambda v: list_contains(missed, v)) AS vague FROM pa p JOIN feat f USING (page_id))""",
        """fnd AS MATERIALIZED (SELECT page_id, engine, delivery_rate, 'B001' AS finding_id, boxed AS fields, 'infobox source missed ' || len(boxed) AS evidence FROM paf WHERE len(boxed) > 0
  UNION ALL SELECT page_id, engine, delivery_rate, 'B002', vague, 'no defining sentence' FROM paf WHERE NOT defines_entity AND len(vague) > 0
  UNION ALL SELECT page_id, engine, delivery_rate, 'I001', missed, 'word_count ' || CASE WHEN word_count < 50 THEN '(<50)' ELSE '(<100)' END FROM paf WHERE word_count < 50 OR (word_count < 100 AND len(missed) >= 2)
  UNION ALL SELECT page_id, engine, delivery_rate, 'I002', missed, 'section_count ' || section_count FROM paf WHERE section_count <= 2 AND len(missed) >= 2
  UNION ALL SELECT page_id, engine, delivery_rate, 'I003', boxed, 'facts only in an infobox' FROM paf WHERE NOT has_infobox AND len(boxed) > 0)""",
    ]
)


def found(spark, sf_dir):
    boxed = F.col("field").isin("founded", "headquarters", "key_products")
    ev = PD.evaluated(spark, sf_dir).withColumn("source", F.when(boxed, "infobox").otherwise("title"))
    return A.findings(A.missed_per_answer(ev), features_of(spark, sf_dir))


_FIND_COLS = f"page_id, engine, finding_id, {O.joined('fields')} AS fields, evidence"


@query(
    "blockage_findings",
    ["fv_truth", "fv_extract", "fv_rich"],
    f"SELECT {_FIND_COLS} FROM fnd WHERE finding_id LIKE 'B%'",
    FIND_CTES,
)
def blockage_findings(spark, sf_dir):
    return found(spark, sf_dir).filter("finding_id like 'B%'").drop("delivery_rate")


@query(
    "pattern_findings",
    ["fv_truth", "fv_extract", "fv_rich"],
    f"SELECT {_FIND_COLS} FROM fnd WHERE finding_id LIKE 'I%'",
    FIND_CTES,
)
def pattern_findings(spark, sf_dir):
    return found(spark, sf_dir).filter("finding_id like 'I%'").drop("delivery_rate")


@query(
    "blockage_catalog",
    ["fv_truth", "fv_extract", "fv_rich"],
    f"""SELECT c.engine, c.finding_id, c.frequency, c.fields, e.examples, s.sample_pages FROM (SELECT engine, finding_id, count(*) AS frequency FROM fnd GROUP BY ALL) k
  JOIN (SELECT engine, finding_id, count(*) AS frequency, '' AS x, (SELECT string_agg(f, ' | ' ORDER BY f) FROM (SELECT DISTINCT unnest(z.fields) AS f FROM fnd z WHERE z.engine = o.engine AND z.finding_id = o.finding_id) q) AS fields FROM fnd o GROUP BY o.engine, o.finding_id) c ON c.engine = k.engine AND c.finding_id = k.finding_id
  JOIN (SELECT engine, finding_id, string_agg(evidence, ' | ' ORDER BY n) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY engine, finding_id ORDER BY f, evidence) AS n FROM (SELECT engine, finding_id, evidence, min(page_id) AS f FROM fnd GROUP BY ALL) a) b WHERE n <= 5 GROUP BY ALL) e ON e.engine = k.engine AND e.finding_id = k.finding_id
  JOIN (SELECT engine, finding_id, string_agg(CAST(page_id AS VARCHAR), ' | ' ORDER BY n) AS sample_pages FROM (SELECT *, row_number() OVER (PARTITION BY engine, finding_id ORDER BY delivery_rate, page_id) AS n FROM fnd) c WHERE n <= 5 GROUP BY ALL) s ON s.engine = k.engine AND s.finding_id = k.finding_id""",
    FIND_CTES,
)
def blockage_catalog(spark, sf_dir):
    return A.blockage_catalog(store(found(spark, sf_dir), "findings"))


@query(
    "review_samples",
    ["fv_truth", "fv_extract", "fv_rich"],
    "SELECT engine, finding_id, rank, page_id, delivery_rate FROM (SELECT *, row_number() OVER (PARTITION BY engine, finding_id ORDER BY delivery_rate, page_id) AS rank FROM fnd) t WHERE rank <= 5",
    FIND_CTES,
)
def review_samples(spark, sf_dir):
    return A.review_samples(found(spark, sf_dir))


@query(
    "catalog_top",
    ["fv_truth", "fv_extract", "fv_rich"],
    "SELECT engine, family, finding_id, frequency, row_number() OVER (PARTITION BY engine, family ORDER BY frequency DESC, finding_id) AS rank FROM (SELECT engine, substr(finding_id, 1, 1) AS family, finding_id, count(*) AS frequency FROM fnd GROUP BY ALL) t",
    FIND_CTES,
)
def catalog_top(spark, sf_dir):
    return A.catalog_top(found(spark, sf_dir))


_DEFS = ", ".join("(" + ", ".join(O.lit(x) for x in d[:3]) + ")" for d in A.DEFINITIONS)


@query(
    "definition_join",
    ["fv_truth", "fv_extract", "fv_rich"],
    f"SELECT d.kind, d.label, count(*) AS findings FROM fnd f JOIN (VALUES {_DEFS}) AS d(finding_id, kind, label) ON d.finding_id = f.finding_id GROUP BY ALL",
    FIND_CTES,
)
def definition_join(spark, sf_dir):
    df = A.with_definitions(found(spark, sf_dir))
    return df.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("findings"))


# --- targets --------------------------------------------------------------------------
BUCKETS = """bk AS MATERIALIZED (SELECT *, CASE WHEN bucket LIKE 'C_%' THEN 'C' WHEN bucket = 'B_fill' THEN 'B' END AS source_group FROM (
  SELECT r.*, f.word_count, CASE WHEN r.page_id IN (17, 76, 92) THEN 'exclude_non_company' WHEN f.word_count <= 80 THEN 'exclude_content_absent' WHEN rate_group = 'C' AND f.word_count <= 400 THEN 'C_content_sparse' WHEN rate_group = 'C' THEN 'C_structure_weak' WHEN rate_group = 'B' THEN 'B_fill' ELSE 'ignore' END AS bucket
  FROM rates r JOIN feat f USING (page_id)) t)"""
BUCKET_CTES = [LATEST, RATES, *PP.FEATURE_CTES, BUCKETS]


def bucketed(spark, sf_dir):
    # word limits are raised over the reference's 49 / 99, so that the test pages fill every bucket
    words = features_of(spark, sf_dir).select("page_id", "word_count")
    df = page_rates_of(spark, sf_dir).join(words, "page_id")
    return A.target_bucket(df, [17, 76, 92], absent=80, sparse=400)


@query("target_bucket", ["fv_rich", "fv_results"], "SELECT page_id, bucket, source_group FROM bk", BUCKET_CTES)
def target_bucket(spark, sf_dir):
    return bucketed(spark, sf_dir).select("page_id", "bucket", "source_group")


@query(
    "target_ranking",
    ["fv_rich", "fv_results"],
    "SELECT page_id, source_group, row_number() OVER (ORDER BY source_group DESC, avg_extraction_rate, word_count, page_id) AS target_rank FROM bk WHERE source_group IS NOT NULL QUALIFY target_rank <= 30",
    BUCKET_CTES,
)
def target_ranking(spark, sf_dir):
    return A.target_ranking(bucketed(spark, sf_dir)).select("page_id", "source_group", "target_rank")


@query(
    "target_summary",
    ["fv_rich", "fv_results"],
    """SELECT CAST(count_if(bucket = 'exclude_non_company') AS BIGINT) AS excluded_non_company, CAST(count_if(bucket = 'exclude_content_absent') AS BIGINT) AS excluded_content_absent, CAST(count_if(bucket = 'C_content_sparse') AS BIGINT) AS c_content_sparse,
  CAST(count_if(bucket = 'C_structure_weak') AS BIGINT) AS c_structure_weak, CAST(count_if(bucket = 'B_fill') AS BIGINT) AS b_fill_available, CAST(least(count_if(bucket = 'B_fill'), greatest(30 - count_if(bucket LIKE 'C_%'), 0)) AS BIGINT) AS b_fill_used FROM bk""",
    BUCKET_CTES,
)
def target_summary(spark, sf_dir):
    return A.target_summary(bucketed(spark, sf_dir))


@query(
    "selection_summary",
    ["fv_candidates"],
    "SELECT coalesce(lang, '*') AS lang, coalesce(tier, '*') AS tier, count(*) AS pages FROM fv_candidates GROUP BY GROUPING SETS ((lang), (tier), ())",
)
def selection_summary(spark, sf_dir):
    return A.selection_summary(view(spark, sf_dir, "fv_candidates"))


_PLAN = ", ".join(f"('{lang}', '{tier}', {q}, {i})" for i, (lang, tier, q) in enumerate(A.SELECTION_PLAN))


@query(
    "stratified_selection",
    ["fv_candidates"],
    """SELECT page_id, phase, row_number() OVER (ORDER BY phase DESC, CASE WHEN phase = 'quota' THEN plan_no ELSE 0 END, n) AS pick_no FROM (
   SELECT page_id, 'quota' AS phase, plan_no, n FROM q1 WHERE n <= quota UNION ALL
   SELECT page_id, 'fill', plan_no, row_number() OVER (ORDER BY selection_score DESC, stable_rank, page_id) AS n FROM pool p WHERE NOT EXISTS (SELECT 1 FROM q1 WHERE q1.n <= q1.quota AND q1.lang = p.lang AND q1.title = p.title)) u QUALIFY pick_no <= 100""",
    [
        f"""pool AS MATERIALIZED (SELECT * FROM (SELECT c.lang, c.title, c.page_id, l.quota, l.plan_no, {PP.SCORE_SQL} AS selection_score, substr(sha1(c.lang || ':' || c.title), 1, 12) AS stable_rank,
     row_number() OVER (PARTITION BY c.lang, c.title ORDER BY l.plan_no, c.page_id) AS first_no FROM fv_candidates c JOIN (VALUES {_PLAN}) AS l(lang, tier, quota, plan_no) ON l.lang = c.lang AND l.tier = c.tier) t WHERE first_no = 1)""".replace(
            "CASE tier", "CASE c.tier"
        ),
        "q1 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY plan_no ORDER BY selection_score DESC, stable_rank, page_id) AS n FROM pool)",
    ],
)
def stratified_selection(spark, sf_dir):
    scored = P.selection_score(view(spark, sf_dir, "fv_candidates"))
    return A.stratified_selection(scored).select("page_id", "phase", "pick_no")


_view(
    "fv_edges",
    [],
    """
SELECT r.r_name AS parent, n.n_name AS child, 'category' AS kind FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
UNION ALL SELECT n.n_name, CASE WHEN c.c_custkey % 11 = 0 THEN 'List of ' || c.c_name ELSE c.c_name END, 'page' FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey
UNION ALL SELECT r.r_name, s.s_name, 'page' FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey
""",
)


@query(
    "category_walk",
    ["fv_edges"],
    f"""SELECT seed, title, depth, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY substr(sha1(title), 1, 12), title) AS rank FROM (
   SELECT w.seed, e.child AS title, CAST(min(w.depth) AS BIGINT) AS depth FROM walk w JOIN fv_edges e ON e.parent = w.category AND e.kind = 'page' WHERE {PP.KEEPS.replace('title', 'e.child')} GROUP BY ALL) t) u""",
    [
        "walk AS (SELECT r_name AS seed, r_name AS category, 0 AS depth FROM region UNION SELECT w.seed, e.child, w.depth + 1 FROM walk w JOIN (SELECT * FROM fv_edges WHERE kind = 'category' ) e ON e.parent = w.category WHERE w.depth < 2)"
    ],
)
def category_walk(spark, sf_dir):
    seeds = table(spark, sf_dir, "region").select(F.col("r_name").alias("seed"))
    return A.category_walk(view(spark, sf_dir, "fv_edges"), seeds).select("seed", "title", "depth", "rank")


_view(
    "fv_ring",
    ["fv_edges"],
    """
SELECT parent, child, kind FROM fv_edges WHERE kind = 'page'
UNION ALL SELECT r.r_name, n.n_name, 'category' FROM region r JOIN nation n ON n.n_nationkey = r.r_regionkey * 4
UNION ALL SELECT a.n_name, b.n_name, 'category' FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 23 OR b.n_nationkey = (a.n_nationkey * 5) % 19
UNION ALL SELECT n.n_name, r.r_name, 'category' FROM nation n JOIN region r ON r.r_regionkey = n.n_nationkey % 3 WHERE n.n_nationkey > 17
""",
)


@query(
    "category_walk_any_depth",
    ["fv_ring"],
    f"""SELECT seed, title, depth, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY substr(sha1(title), 1, 12), title) AS rank FROM (
   SELECT w.seed, e.child AS title, CAST(min(w.depth) AS BIGINT) AS depth FROM walk w JOIN fv_ring e ON e.parent = w.category AND e.kind = 'page' WHERE {PP.KEEPS.replace('title', 'e.child')} GROUP BY ALL) t) u""",
    [
        # no path to a category is longer than there are categories
        "walk AS (SELECT r_name AS seed, r_name AS category, 0 AS depth FROM region UNION SELECT w.seed, e.child, w.depth + 1 FROM walk w JOIN (SELECT * FROM fv_ring WHERE kind = 'category') e ON e.parent = w.category WHERE w.depth < 31)"
    ],
)
def category_walk_any_depth(spark, sf_dir):
    """The walk over categories that lead back to each other, to its end."""
    seeds = table(spark, sf_dir, "region").select(F.col("r_name").alias("seed"))
    return A.category_walk(view(spark, sf_dir, "fv_ring"), seeds, max_depth=None).select("seed", "title", "depth", "rank")


@query(
    "log_result_rehydrate",
    ["fv_truth"],
    """SELECT page_id, field, value_text, 'stored' AS origin FROM fv_truth WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, field, upper(value_text), 'recomputed' FROM fv_truth WHERE page_id % 3 = 0""",
)
def log_result_rehydrate(spark, sf_dir):
    truth = view(spark, sf_dir, "fv_truth")
    stored = truth.withColumn("version", F.when(F.col("page_id") % 3 == 0, "v1").otherwise("v2"))
    return A.rehydrate(stored, truth.withColumn("value_text", F.upper("value_text")), "v2")


# --- experiment -----------------------------------------------------------------------
_view(
    "fv_runs",
    [],
    """
SELECT p.page_id, s.stage_no, e.engine,
  CASE WHEN (p.page_id + s.stage_no) % 6 = 0 THEN NULL WHEN (p.page_id + e.engine_no) % 10 = 0 THEN NULL ELSE CAST((p.page_id * 3 + s.stage_no * 5 + e.engine_no) % 17 AS DOUBLE) / 16 END AS delivery_rate,
  CAST((p.page_id + s.stage_no * 2 + e.engine_no * 3) % 13 AS DOUBLE) / 12 AS extraction_rate,
  (p.page_id + s.stage_no) % 3 > 0 AS applied
FROM pages p CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS s(stage_no) CROSS JOIN (VALUES ('gpt',1),('gemini',2),('perplexity',3)) AS e(engine, engine_no)
""",
)
STAGE_CTES = [
    "stg AS MATERIALIZED (SELECT page_id, stage_no, round(avg(delivery_rate), 3) AS delivery_rate, round(avg(extraction_rate), 3) AS extraction_rate, bool_or(applied) AS applied FROM fv_runs GROUP BY ALL)",
    "prog AS MATERIALIZED (SELECT *, round(delivery_rate - last_value(delivery_rate IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY stage_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) AS delta FROM stg)",
    """bst AS MATERIALIZED (SELECT page_id, arg_max(stage_no, delta * 1000 - stage_no * 0.001::DOUBLE) FILTER (WHERE delta IS NOT NULL AND stage_no > 0) AS b, max(delta) FILTER (WHERE stage_no > 0) AS best_delta,
   round(max(CASE WHEN stage_no = 4 THEN delivery_rate END) - max(CASE WHEN stage_no = 0 THEN delivery_rate END), 3) AS total_improvement, max(CASE WHEN stage_no = 4 THEN delivery_rate END) >= 0.75 AS reached_threshold FROM prog GROUP BY page_id)""",
]


def stages(spark, sf_dir):
    return A.stage_metrics(view(spark, sf_dir, "fv_runs"))


@query(
    "stage_metrics",
    ["fv_runs"],
    "SELECT page_id, CAST(stage_no AS BIGINT) AS stage_no, delivery_rate, extraction_rate, applied FROM stg",
    STAGE_CTES,
)
def stage_metrics(spark, sf_dir):
    return stages(spark, sf_dir)


@query(
    "step_progression",
    ["fv_runs"],
    "SELECT page_id, CAST(stage_no AS BIGINT) AS stage_no, delivery_rate, delta FROM prog",
    STAGE_CTES,
)
def step_progression(spark, sf_dir):
    return A.step_progression(stages(spark, sf_dir)).select("page_id", "stage_no", "delivery_rate", "delta")


@query(
    "best_step",
    ["fv_runs"],
    "SELECT page_id, ['original', 'step_a', 'step_b', 'step_c', 'step_d'][b + 1] AS best_stage, best_delta, total_improvement, reached_threshold FROM bst",
    STAGE_CTES,
)
def best_step(spark, sf_dir):
    return A.best_step(A.step_progression(stages(spark, sf_dir)))


@query(
    "step_effectiveness",
    ["fv_runs"],
    "SELECT CAST(stage_no AS BIGINT) AS stage_no, count(*) AS pages, CAST(count_if(applied) AS BIGINT) AS applied_pages, round(avg(delivery_rate), 3) AS avg_delivery_rate, round(avg(extraction_rate), 3) AS avg_extraction_rate, round(avg(delta), 3) AS avg_delta FROM prog GROUP BY stage_no",
    STAGE_CTES,
)
def step_effectiveness(spark, sf_dir):
    return A.step_effectiveness(A.step_progression(stages(spark, sf_dir)))


_CAL = ", ".join(
    f"max(CASE WHEN stage_no = {i} THEN {k}_rate END) AS {s}_{k}" for i, s in enumerate(A.STAGES) for k in ("delivery", "extraction")
)


@query("calibration_wide", ["fv_runs"], f"SELECT page_id, {_CAL} FROM stg GROUP BY page_id", STAGE_CTES)
def calibration_wide(spark, sf_dir):
    return A.calibration_wide(stages(spark, sf_dir))


@query(
    "experiment_summary",
    ["fv_rich", "fv_results", "fv_runs"],
    f"""SELECT count(*) AS targets, CAST(count_if(bucket = 'C_content_sparse') AS BIGINT) AS c_content_sparse, CAST(count_if(bucket = 'C_structure_weak') AS BIGINT) AS c_structure_weak, CAST(count_if(bucket = 'B_fill') AS BIGINT) AS b_fill,
  round(avg(original_delivery), 3) AS avg_original_rate, round(avg(step_d_delivery), 3) AS avg_final_rate, round(avg(total_improvement), 3) AS avg_improvement, CAST(count_if(reached_threshold) AS BIGINT) AS reached_threshold
 FROM (SELECT page_id, {_CAL} FROM stg GROUP BY page_id) w JOIN bst USING (page_id) JOIN bk USING (page_id) WHERE source_group IS NOT NULL""",
    STAGE_CTES + BUCKET_CTES,
)
def experiment_summary(spark, sf_dir):
    s = stages(spark, sf_dir)
    targets = bucketed(spark, sf_dir).filter("source_group is not null").select("page_id", "bucket")
    return A.experiment_summary(A.best_step(A.step_progression(s)), A.calibration_wide(s), targets)


_view(
    "fv_votes",
    ["fv_rich"],
    """
SELECT r.page_id, f.field, e.engine_no, CASE WHEN (r.page_id + f.field_no + e.engine_no) % 4 = 0 THEN r.hq WHEN (r.page_id + f.field_no * e.engine_no) % 4 = 1 THEN r.founded ELSE 'v' || CAST(e.engine_no % 2 AS STRING) END AS value
FROM fv_rich r CROSS JOIN (VALUES ('founded',1),('headquarters',2)) AS f(field, field_no) CROSS JOIN (VALUES (1),(2),(3)) AS e(engine_no) WHERE (r.page_id + e.engine_no + f.field_no) % 5 <> 0
""",
)
_view(
    "fv_boxed",
    ["fv_rich"],
    """
SELECT page_id, 'headquarters' AS field, hq || ', Earth' AS value FROM fv_rich WHERE page_id % 3 = 1
""",
)


@query(
    "consensus_facts",
    ["fv_votes", "fv_boxed"],
    """SELECT coalesce(b.page_id, v.page_id) AS page_id, coalesce(b.field, v.field) AS field, coalesce(b.value, v.value) AS value, CASE WHEN b.value IS NOT NULL THEN 'infobox' ELSE 'vote' END AS origin
 FROM fv_boxed b FULL OUTER JOIN (SELECT page_id, field, value FROM (SELECT page_id, field, value, row_number() OVER (PARTITION BY page_id, field ORDER BY count(*) DESC, min(engine_no)) AS n FROM fv_votes GROUP BY page_id, field, value) t WHERE n = 1) v ON v.page_id = b.page_id AND v.field = b.field""",
)
def consensus_facts(spark, sf_dir):
    return A.consensus_facts(view(spark, sf_dir, "fv_boxed"), view(spark, sf_dir, "fv_votes"))


@query(
    "union_engine_results",
    ["fv_results"],
    "SELECT engine, CAST(run_no AS BIGINT) AS run_no, count(*) AS results FROM fv_results GROUP BY ALL",
)
def union_engine_results(spark, sf_dir):
    df = results(spark, sf_dir).select("page_id", "engine", F.col("run_no").cast("int").alias("run_no"))
    first, *rest = [df.filter(F.col("engine") == e) for e in A.ENGINES]
    for one in rest:
        first = first.unionByName(one)
    return first.groupBy("engine", "run_no").agg(F.count(F.lit(1)).alias("results"))


# --- rewrites ---------------------------------------------------------------------------
_view(
    "fv_study",
    [],
    """
SELECT doc_id AS page_id, text, CASE WHEN doc_id % 3 = 0 THEN 'ko' ELSE 'en' END AS lang,
  CASE doc_id % 5 WHEN 0 THEN '한국전자' WHEN 1 THEN '로봇산업' WHEN 2 THEN 'Acme' WHEN 3 THEN '' ELSE '삼손' END AS name,
  CASE doc_id % 4 WHEN 0 THEN 'robot company.' WHEN 1 THEN '로봇 제조 기업' WHEN 2 THEN NULL ELSE 'Brand maker' END AS entity_type,
  CASE WHEN doc_id % 2 = 0 THEN 'Seoul' ELSE NULL END AS headquarters, CASE WHEN doc_id % 3 = 1 THEN CAST(1950 + doc_id % 70 AS STRING) ELSE NULL END AS founded,
  CASE WHEN doc_id % 7 = 0 THEN 'Kim' ELSE ' ' END AS leader, CAST(NULL AS STRING) AS employees, CASE WHEN doc_id % 6 = 0 THEN '5 bn' ELSE NULL END AS revenue,
  doc_id % 4 = 3 AS defines_entity, doc_id % 5 = 4 AS has_infobox, doc_id % 6 AS section_count,
  split('the;of the;and;12;x;tion;of the;la;' || source || ';de la', ';') AS anchors
FROM documents
""",
)
_KO_BATCHIM = "unicode(right(trim({x}), 1)) BETWEEN 44032 AND 55203 AND (unicode(right(trim({x}), 1)) - 44032) % 28 <> 0"
_NAME = "nullif(trim(name), '')"
_KIND = O.squeeze(O.sub("entity_type", "[.。]+$"))
_KK = f"nullif(trim({O.sub(_KIND, '(회사|기업|브랜드) *$')}), '')"
_KE = f"nullif(trim({O.sub(_KIND, '(?i)' + B + 'b(company|corporation|business|brand)$')}), '')"
DEF_SQL = f"""(CASE WHEN lang = 'en' THEN coalesce({_NAME}, 'This company') || ' is a ' || coalesce({_KE} || ' ', '') || 'company' || coalesce(' based in ' || headquarters, '') || '.'
  ELSE coalesce({_NAME}, '이 기업') || (CASE WHEN {_KO_BATCHIM.format(x="coalesce(" + _NAME + ", '이 기업')")} THEN '은' ELSE '는' END) || ' ' || coalesce(headquarters || '에 본사를 둔 ', '') || coalesce({_KK} || ' ', '') || '기업이다.' END)"""
_V = {c: f"nullif(trim({c}), '')" for c in E.FACT_COLUMNS}
_LINES_SQL = (
    "list_filter(CASE WHEN lang = 'en' THEN ["
    + ", ".join(f"'{n}: ' || {_V[c]}" for n, c in zip(E.LABELS["en"], E.FACT_COLUMNS))
    + "] ELSE ["
    + ", ".join(f"'{n}: ' || {_V[c]}" for n, c in zip(E.LABELS["ko"], E.FACT_COLUMNS))
    + "] END, lambda l: l IS NOT NULL)"
)


def _sent_sql(x: str) -> str:
    return f"list_filter(list_transform({O.every(O.squeeze(x), '[^.!?。]+[.!?。]?')}, lambda s: trim(s)), lambda s: s <> '')"


def _heads_sql() -> str:
    return "CASE WHEN lang = 'en' THEN " + str(E.HEADINGS["en"]) + " ELSE " + str(E.HEADINGS["ko"]) + " END"


_SECT = """array_to_string(list_transform(range(0, CAST(ceil(len({s})::DOUBLE / per) AS BIGINT)), lambda i: hs[i + 1] || chr(10) || array_to_string({s}[i * per + 1 : i * per + per], ' ')), chr(10) || chr(10))"""


def _per(s: str) -> str:
    return f"CAST(ceil(len({s})::DOUBLE / least(5, greatest(2, ceil(len({s})::DOUBLE / 3)))) AS BIGINT)"


_ANCHORS = (
    "list_transform(list_sort(list_transform(list_filter("
    + O.uniq(f"list_transform(anchors, lambda a: {O.strip('a')})", "true")
    + ", lambda a: length(a) >= 2 AND NOT regexp_matches(a, '^[0-9]+$')), lambda a, i: {'l': -length(a), 'i': i, 'a': a})), lambda s: s.a)"
)


def _link_sql(x: str) -> str:
    return f"list_reduce({_ANCHORS}, lambda t, a: CASE WHEN contains(t, '[[' || a || ']]') OR NOT contains(t, a) THEN t ELSE substr(t, 1, strpos(t, a) - 1) || '[[' || a || ']]' || substr(t, strpos(t, a) + length(a)) END, {x})"


_NL2 = "chr(10) || chr(10)"
STUDY_CTES = [
    f"s0 AS MATERIALIZED (SELECT *, {O.strip('text')} AS t0, {DEF_SQL} AS def, {_LINES_SQL} AS lns, {_heads_sql()} AS hs FROM fv_study)",
    f"s1 AS MATERIALIZED (SELECT *, NOT defines_entity AS a1, CASE WHEN defines_entity THEN t0 ELSE {O.strip('def || ' + _NL2 + ' || t0')} END AS t1 FROM s0)",
    f"s2 AS MATERIALIZED (SELECT *, NOT has_infobox AND len(lns) >= 3 AS a2, CASE WHEN NOT has_infobox AND len(lns) >= 3 THEN {O.strip('(CASE WHEN lang = ' + O.lit('en') + ' THEN ' + O.lit('[Company Facts]') + ' ELSE ' + O.lit('[기업 정보]') + ' END) || chr(10) || array_to_string(lns, chr(10)) || ' + _NL2 + ' || t1')} ELSE t1 END AS t2 FROM s1)",
    f"s3a AS MATERIALIZED (SELECT *, {_sent_sql('t2')} AS ss FROM s2)",
    f"s3b AS MATERIALIZED (SELECT *, section_count <= 2 AND len(ss) >= 4 AS a3, {_per('ss')} AS per FROM s3a)",
    f"s3 AS MATERIALIZED (SELECT *, CASE WHEN a3 THEN {O.strip(_SECT.format(s='ss'))} ELSE t2 END AS t3 FROM s3b)",
    f"s4 AS MATERIALIZED (SELECT *, {_link_sql('t3')} AS t4, {_link_sql('t3')} <> t3 AS a4 FROM s3)",
]


def study(spark, sf_dir):
    return view(spark, sf_dir, "fv_study")


def _made(df, step):
    text, applied = step(T.strip(F.col("text")))
    return df.select("page_id", F.md5(F.encode(text, "UTF-8")).alias("text_md5"), applied.alias("applied"))


@query(
    "rewrite_definition",
    ["fv_study"],
    "SELECT page_id, md5(t1) AS text_md5, a1 AS applied, def AS sentence FROM s1",
    STUDY_CTES[:2],
)
def rewrite_definition(spark, sf_dir):
    df = study(spark, sf_dir)
    made, applied = E.rewrite_definition(T.strip(F.col("text")))
    return df.select(
        "page_id", F.md5(F.encode(made, "UTF-8")).alias("text_md5"), applied.alias("applied"), E.definition_sentence().alias("sentence")
    )


@query(
    "rewrite_facts",
    ["fv_study"],
    "SELECT page_id, md5(t2) AS text_md5, a2 AS applied FROM s2",
    [STUDY_CTES[0], "s1 AS (SELECT *, t0 AS t1 FROM s0)", STUDY_CTES[2]],
)
def rewrite_facts(spark, sf_dir):
    return _made(study(spark, sf_dir), E.rewrite_facts)


@query(
    "rewrite_sections",
    ["fv_study"],
    "SELECT page_id, md5(t3) AS text_md5, a3 AS applied FROM s3",
    [STUDY_CTES[0], "s2 AS (SELECT *, t0 AS t2 FROM s0)", *STUDY_CTES[3:6]],
)
def rewrite_sections(spark, sf_dir):
    return _made(study(spark, sf_dir), E.rewrite_sections)


@query(
    "rewrite_links",
    ["fv_study"],
    "SELECT page_id, md5(t4) AS text_md5, a4 AS applied FROM s4",
    [STUDY_CTES[0], "s3 AS (SELECT *, t0 AS t3 FROM s0)", STUDY_CTES[6]],
)
def rewrite_links(spark, sf_dir):
    return _made(study(spark, sf_dir), E.rewrite_links)


_STG = " UNION ALL ".join(
    f"SELECT page_id, CAST({i} AS BIGINT) AS stage_no, md5(t{i}) AS text_md5, {'a' + str(i) if i else 'false'} AS applied, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN a{j} THEN '{A.STAGES[j]}' END" for j in range(1, i + 1))
    + ("" if i else "NULL::VARCHAR")
    + "], lambda s: s IS NOT NULL), ' | ') AS steps FROM s4"
    for i in range(5)
)


@query("stage_texts", ["fv_study"], _STG, STUDY_CTES)
def stage_texts(spark, sf_dir):
    return E.stage_texts(study(spark, sf_dir)).select(
        "page_id", "stage_no", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "applied", "steps"
    )


@query(
    "sentence_sections",
    ["fv_study"],
    f"SELECT page_id, CAST(i AS BIGINT) AS section_no, md5(array_to_string(ss[i * per + 1 : i * per + per], ' ')) AS text_md5 FROM (SELECT page_id, ss, per, unnest(range(0, CAST(ceil(len(ss)::DOUBLE / per) AS BIGINT))) AS i FROM (SELECT page_id, ss, {_per('ss')} AS per FROM (SELECT page_id, {_sent_sql('text')} AS ss FROM fv_study) a WHERE len(ss) > 0) b) c",
)
def sentence_sections(spark, sf_dir):
    df = study(spark, sf_dir).select("page_id", E.plain_sentences(F.col("text")).alias("s"))
    rows = df.select("page_id", F.posexplode(E.sections(F.col("s"))).alias("section_no", "section"))
    return rows.select("page_id", "section_no", F.md5(F.encode("section", "UTF-8")).alias("text_md5"))
