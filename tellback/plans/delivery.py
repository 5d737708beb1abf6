"""Queries over extractions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import text as T
from tellback.operators import delivery as D
from tellback.operators import facts as X
from tellback.plans import facts as PF
from tellback.plans import osql as O
from tellback.plans import pages as PP
from tellback.plans import sites as PS
from tellback.plans.fixtures import _view, table, view
from tellback.plans.registry import query

B = chr(92)
KEYS = ["page_id", "engine"]

_view(
    "fv_extract",
    ["fv_rich"],
    """
SELECT r.page_id, e.engine, e.engine_no,
  CASE (r.page_id + e.engine_no * 3) % 9
   WHEN 0 THEN 'Sure! ```json' || chr(10) || js || chr(10) || '``` done'
   WHEN 1 THEN '{"entity_name": "' || r.org_name || '", "founded": '
   WHEN 2 THEN '{"entity_name": {"value": " ' || r.org_name || ' "}, "founded": ' || r.founded || ', "key_products": {"value": ["Beta"]}, "description": null}'
   WHEN 3 THEN '{"entity_name": "Wrong ' || r.n || '", "founded": "1800", "headquarters": "Oslo", "key_products": ["Gizmo", ""], "entity_type": ""}'
   WHEN 4 THEN '{}'
   WHEN 5 THEN 'no json here'
   ELSE js END AS raw_text
FROM (SELECT *, CAST(page_id AS STRING) AS n, '{"entity_name": "' || org_name || ' Inc.", "founded": "since ' || founded || '", "headquarters": "' || hq || '", "key_products": ["alpha suite pro", "Other"], "description": "'
    || org_name || ' builds industrial robots", "employee_count": "about ' || CAST(100 + page_id % 50 AS STRING) || ' people", "entity_type": "robotics maker", "revenue": null, "competitors": []}' AS js FROM fv_rich) r
CROSS JOIN (VALUES ('gpt',1),('gemini',2),('perplexity',3)) AS e(engine, engine_no)
""",
)


def truth(spark, sf_dir):
    df = view(spark, sf_dir, "fv_truth")
    return df.select(
        "page_id", "field", F.split("value_text", ";").alias("values"), "source", F.split("sources_text", ";").alias("sources")
    )


def parsed(spark, sf_dir):
    return D.extraction_parse(view(spark, sf_dir, "fv_extract"), KEYS)


def evaluated(spark, sf_dir):
    return D.delivery_eval_extracted(truth(spark, sf_dir), parsed(spark, sf_dir), KEYS)


_BODY = O.sub("coalesce(raw_text, '')", "(?i)```json" + B + "s*|```")
_INNER = O.get("body", "(?s)" + B + "{.*" + B + "}", 0)


def _field_sql(f: str) -> str:
    if f in dims.ARRAY_FIELDS:
        items = f"CASE WHEN json_type(doc, '$.{f}') = 'ARRAY' THEN json_extract_string(doc, '$.{f}[*]') WHEN json_type(doc, '$.{f}.value') = 'ARRAY' THEN json_extract_string(doc, '$.{f}.value[*]') ELSE []::VARCHAR[] END"
        return f"SELECT page_id, engine, broken, '{f}' AS field, list_filter(list_transform({items}, lambda v: trim(coalesce(v, ''))), lambda v: v <> '') AS vals FROM xd"
    v = f"nullif(trim(CASE json_type(doc, '$.{f}') WHEN 'OBJECT' THEN json_extract_string(doc, '$.{f}.value') WHEN 'NULL' THEN NULL ELSE json_extract_string(doc, '$.{f}') END), '')"
    return f"SELECT page_id, engine, broken, '{f}' AS field, CASE WHEN {v} IS NULL THEN []::VARCHAR[] ELSE [{v}] END AS vals FROM xd"


PARSE_CTES = [
    f"xb AS (SELECT page_id, engine, trim({_BODY}) AS body FROM fv_extract)",
    f"xd AS MATERIALIZED (SELECT page_id, engine, NOT json_valid(j) AS broken, CASE WHEN json_valid(j) THEN j::JSON END AS doc FROM (SELECT page_id, engine, CASE WHEN {_INNER} <> '' THEN {_INNER} ELSE body END AS j FROM xb) t)",
    "xp AS MATERIALIZED (" + " UNION ALL ".join(_field_sql(f) for f in dims.FIELDS) + ")",
    "xrate AS MATERIALIZED (SELECT page_id, engine, CASE WHEN bool_or(broken) THEN 'error' ELSE 'success' END AS status, CAST(count_if(len(vals) > 0) AS BIGINT) AS fields_present, round(count_if(len(vals) > 0)::DOUBLE / 12, 3) AS extraction_rate FROM xp GROUP BY ALL)",
]


@query(
    "extraction_parse",
    ["fv_extract"],
    f"SELECT page_id, engine, field, CASE WHEN broken THEN 'error' WHEN len(vals) > 0 THEN 'present' ELSE 'missing' END AS state, {O.joined('vals')} AS vals FROM xp",
    PARSE_CTES,
)
def extraction_parse(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "page_id", "engine", "field", "state", F.coalesce(F.array_join("values", " | "), F.lit("")).alias("vals")
    )


@query(
    "extraction_rates",
    ["fv_extract"],
    "SELECT page_id, engine, status, fields_present, extraction_rate FROM xrate",
    PARSE_CTES,
)
def extraction_rates(spark, sf_dir):
    return D.extraction_rates(parsed(spark, sf_dir), KEYS)


def scalar_rule(field: str, tc: str, fc: str, tt: str, ft: str, ty: str, fy: str) -> str:
    share, inside, year = O.token_share(tt, ft), O.hold_each_other(tc, fc), f"list_has_any({ty}, {fy})"
    return (
        f"(CASE WHEN {field} = 'founded' THEN {year} WHEN {field} IN ('description', 'unique_value') THEN {share} >= 0.35 OR {inside} "
        f"WHEN {field} IN ('entity_type', 'headquarters') THEN {share} >= 0.4 OR {inside} WHEN {field} IN ('employee_count', 'revenue') THEN {year} OR {inside} "
        f"ELSE {inside} OR {share} >= 0.5 END)"
    )


EVAL_CTES = PARSE_CTES + [
    f"""te AS MATERIALIZED (SELECT t.page_id, x.engine, t.field, t.source, split(t.value_text, ';') AS tv, x.vals AS fv, x.broken FROM fv_truth t JOIN xp x ON x.page_id = t.page_id AND x.field = t.field)""",
    f"""tpair AS MATERIALIZED (SELECT page_id, engine, field, a, b, {O.comparable('a', False)} AS ac, {O.comparable('b', False)} AS bc FROM (SELECT page_id, engine, field, a, unnest(fv) AS b FROM (SELECT *, unnest(tv) AS a FROM te) q) r)""",
    f"""tmatch AS MATERIALIZED (SELECT page_id, engine, field, bool_or(CASE WHEN field = 'key_products' THEN {O.hold_each_other('ac', 'bc')} OR {O.token_share(O.tokens('ac'), O.tokens('bc'))} >= 0.4
    ELSE {scalar_rule('field', 'ac', 'bc', O.tokens('ac'), O.tokens('bc'), O.years('a', '18|19|20'), O.years('b', '18|19|20'))} END) AS m FROM tpair GROUP BY ALL)""",
    "ev AS MATERIALIZED (SELECT te.page_id, te.engine, te.field, te.source, te.broken, coalesce(m.m, false) AS matched FROM te LEFT JOIN tmatch m USING (page_id, engine, field))",
    "evrate AS MATERIALIZED (SELECT page_id, engine, count(*) AS truth_fields, CAST(count_if(matched) AS BIGINT) AS matched_fields, round(count_if(matched)::DOUBLE / count(*), 3) AS delivery_rate FROM ev GROUP BY ALL)",
]


@query(
    "delivery_eval_extracted",
    ["fv_truth", "fv_extract"],
    "SELECT page_id, engine, field, source, matched FROM ev",
    EVAL_CTES,
)
def delivery_eval_extracted(spark, sf_dir):
    return evaluated(spark, sf_dir).select("page_id", "engine", "field", "source", "matched")


@query(
    "delivery_rates",
    ["fv_truth", "fv_extract"],
    "SELECT page_id, engine, truth_fields, matched_fields, delivery_rate FROM evrate",
    EVAL_CTES,
)
def delivery_rates(spark, sf_dir):
    return D.delivery_rates(evaluated(spark, sf_dir), KEYS)


@query(
    "array_fuzzy_match",
    ["fv_truth", "fv_extract"],
    f"""SELECT page_id, engine, bool_or(coalesce({O.hold_each_other('ac', 'bc')} OR {O.token_share(O.tokens('ac'), O.tokens('bc'))} >= 0.4, false)) AS matched
  FROM te LEFT JOIN (SELECT page_id, engine, field, ac, bc FROM tpair) p USING (page_id, engine, field) WHERE te.field = 'key_products' GROUP BY page_id, engine""",
    EVAL_CTES[:-3],
)
def array_fuzzy_match(spark, sf_dir):
    # declared against extracted products of the same page
    measure = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: D.measured(v, False))
    left = truth(spark, sf_dir).filter("field = 'key_products'").select("page_id", measure(F.col("values")).alias("a"))
    right = parsed(spark, sf_dir).filter("field = 'key_products'").select("page_id", "engine", measure(F.col("values")).alias("b"))
    return left.join(right, "page_id").select(
        "page_id", "engine", F.coalesce(D.fuzzy_any(F.col("a"), F.col("b")), F.lit(False)).alias("matched")
    )


# --- free text -----------------------------------------------------------------------
def responses(spark, sf_dir):
    return view(spark, sf_dir, "fv_resp").withColumn(
        "citations", F.filter(F.split("citations_text", ";"), lambda c: c != "")
    )


def answered(spark, sf_dir):
    return responses(spark, sf_dir).filter("status = 'success'")


_NEG = "(?i)찾지\\s*못|확인할?\\s*수\\s*없|not\\s*found|없음|n/a"
_OTHER = "\\*\\*[^*]+\\*\\*\\s*:|[-*]\\s*\\*\\*[^*]+\\*\\*\\s*:|^[a-z_ ]+\\s*:|^[가-힣A-Za-z ]+\\s*:"
_NAMES = ", ".join(f"('{f}', {O.lit(n)})" for f, ns in dims.FIELD_MENTIONS.items() for n in [*ns, f.replace("_", " "), f])
NEG_CTES = [
    f"mention(f, n) AS (VALUES {_NAMES}, ('employee_count', 'employee count'), ('employee_count', 'employee_count'))",
    """rline AS MATERIALIZED (SELECT page_id, engine, p, l, coalesce(lead(l) OVER (PARTITION BY page_id, engine ORDER BY p), '') AS nx FROM (SELECT page_id, engine, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM (
   SELECT page_id, engine, string_split(text, chr(10)) AS ls FROM fv_resp WHERE status = 'success') a) b)""",
    f"""neg AS MATERIALIZED (SELECT DISTINCT r.page_id, r.engine, m.f AS field FROM rline r JOIN mention m ON contains(lower(r.l), m.n)
   WHERE {O.has('l', _NEG)} OR (trim(nx) <> '' AND NOT {O.has('trim(nx)', _OTHER)} AND {O.has('nx', _NEG)}))""",
]


@query(
    "negative_context",
    ["fv_resp", "fv_truth"],
    "SELECT t.page_id, r.engine, t.field, n.field IS NOT NULL AS negative FROM fv_truth t JOIN fv_resp r ON r.page_id = t.page_id AND r.status = 'success' LEFT JOIN neg n ON n.page_id = t.page_id AND n.engine = r.engine AND n.field = t.field",
    NEG_CTES,
)
def negative_context(spark, sf_dir):
    fields = truth(spark, sf_dir).select("page_id", "field")
    return (
        answered(spark, sf_dir)
        .join(fields, "page_id")
        .select("page_id", "engine", "field", D.negative_context(F.col("text"), F.col("field")).alias("negative"))
    )


TEXT_CTES = NEG_CTES + [
    f"""sd AS MATERIALIZED (SELECT page_id, engine, text, c, {O.tokens('c')} AS tok, {O.years('text', '18|19|20')} AS yrs FROM (SELECT page_id, engine, text, {O.comparable('text')} AS c FROM fv_resp WHERE status = 'success') q)""",
    f"""tx AS MATERIALIZED (SELECT page_id, field, source, sources_text, v, c, {O.tokens('c')} AS tok, {O.years('v', '18|19|20')} AS yrs FROM (SELECT page_id, field, source, sources_text, v, {O.comparable('v')} AS c FROM (SELECT *, unnest(split(value_text, ';')) AS v FROM fv_truth) a) b)""",
    f"""dt AS MATERIALIZED (SELECT t.page_id, s.engine, t.field, any_value(t.source) AS source, any_value(t.sources_text) AS sources_text,
   bool_or(CASE WHEN t.field = 'key_products' THEN (t.c <> '' AND contains(s.c, t.c)) OR {O.token_share('t.tok', 's.tok')} >= 0.4
     ELSE (t.c <> '' AND contains(s.c, t.c)) OR {scalar_rule('t.field', 't.c', 's.c', 't.tok', 's.tok', 't.yrs', 's.yrs')} OR (t.field IN ('entity_name', 'ceo_or_leader') AND contains(s.c, {O.comparable("'Org' || t.page_id || ' Laboratories'")})) END)
   AND NOT bool_or(n.field IS NOT NULL) AS delivered
  FROM tx t JOIN sd s ON s.page_id = t.page_id LEFT JOIN neg n ON n.page_id = t.page_id AND n.engine = s.engine AND n.field = t.field GROUP BY t.page_id, s.engine, t.field)""",
]


def alternates(spark, sf_dir):
    return view(spark, sf_dir, "fv_rich").select(
        "page_id", F.array(F.concat(F.lit("Org"), F.col("page_id").cast("string"), F.lit(" Laboratories"))).alias("alternate_names")
    )


def delivered(spark, sf_dir):
    return D.delivery_eval_text(answered(spark, sf_dir), truth(spark, sf_dir), KEYS, alternates(spark, sf_dir))


@query(
    "delivery_eval_text",
    ["fv_resp", "fv_truth"],
    "SELECT page_id, engine, field, source, delivered FROM dt",
    TEXT_CTES,
)
def delivery_eval_text(spark, sf_dir):
    return delivered(spark, sf_dir).drop("sources")


@query(
    "delivery_summary",
    ["fv_resp", "fv_truth"],
    "SELECT page_id, engine, count(*) AS declared, CAST(count_if(delivered) AS BIGINT) AS delivered, round(count_if(delivered)::DOUBLE / count(*), 3) AS delivery_rate FROM dt GROUP BY ALL",
    TEXT_CTES,
)
def delivery_summary(spark, sf_dir):
    return D.delivery_summary(delivered(spark, sf_dir), KEYS)


@query(
    "faq_delivery",
    ["fv_resp", "fv_facts"],
    f"""SELECT page_id, engine, pair_no, question, c <> '' AND {O.token_share(O.tokens('c'), 'tok')} >= 0.3 AS delivered FROM (
  SELECT q.page_id, s.engine, q.n AS pair_no, q.question, q.c, s.tok FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY p) AS n, question, {O.comparable('answer')} AS c FROM (
     SELECT page_id, p, {O.strip(O.get('l', PF._QL))} AS question, {O.strip(O.get('nx', PF._AL))} AS answer FROM (SELECT page_id, p, l, coalesce(lead(l) OVER (PARTITION BY page_id ORDER BY p), '') AS nx FROM (
      SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM (SELECT page_id, string_split_regex(content, '\\n+') AS ls FROM fv_facts) c) d) e) f WHERE question <> '' AND answer <> '') q
  JOIN (SELECT page_id, engine, {O.tokens(O.comparable("text || ' robot maker number'"))} AS tok FROM fv_resp WHERE status = 'success') s ON s.page_id = q.page_id) z""",
)
def faq_delivery(spark, sf_dir):
    pages = view(spark, sf_dir, "fv_facts").withColumn("jsonld_blocks", F.array().cast("array<string>"))
    said = answered(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" robot maker number")))
    return D.faq_delivery(said, X.faq_pairs(pages), KEYS)


def evidence_rows(spark, sf_dir):
    """Evidence flags per page, by a fixed rule over all pages."""
    p = F.col("page_id")
    return view(spark, sf_dir, "fv_rich").select(
        "page_id", (p % 6 == 0).alias("robots_blocked"), (p % 6 == 1).alias("no_static_html"), (p % 6 == 2).alias("js_rendered"),
        (p % 6 == 3).alias("low_words"), (p % 4 == 0).alias("has_facts_block"),
    )


CAUSE_SQL = """CASE WHEN page_id % 6 = 0 THEN 'robots_blocked' WHEN page_id % 6 = 1 THEN 'no_static_html' WHEN page_id % 6 = 2 THEN 'js_rendering_only' WHEN page_id % 6 = 3 THEN 'content_sparse'
  WHEN contains(sources_text, 'jsonld') AND (contains(sources_text, 'facts_block') OR page_id % 4 = 0) THEN 'dual_source_missed' WHEN contains(sources_text, 'jsonld') THEN 'jsonld_only' WHEN contains(sources_text, 'facts_block') THEN 'facts_block_only' ELSE 'unknown' END"""
CAUSE_CTES = TEXT_CTES + [
    f"""mc AS MATERIALIZED (SELECT page_id, engine, field, signal, CASE WHEN signal IN ('robots_blocked', 'no_static_html') THEN 'high' WHEN signal IN ('js_rendering_only', 'content_sparse') THEN 'medium' ELSE 'low' END AS confidence
   FROM (SELECT *, {CAUSE_SQL} AS signal FROM dt WHERE NOT delivered) t)"""
]


def causes(spark, sf_dir):
    missed = delivered(spark, sf_dir).filter("not delivered")
    return D.missed_cause(missed.join(evidence_rows(spark, sf_dir), "page_id", "left"))


@query(
    "missed_cause",
    ["fv_resp", "fv_truth"],
    "SELECT page_id, engine, field, signal, confidence FROM mc",
    CAUSE_CTES,
)
def missed_cause(spark, sf_dir):
    return causes(spark, sf_dir).select("page_id", "engine", "field", "signal", "confidence")


_CPATH = lambda x: f"coalesce(CASE WHEN {O.host(x)} <> '' THEN {O.trimmed_path(x)} END, '')"
LEVEL_CTES = [
    f"""cl AS MATERIALIZED (SELECT page_id, engine, coalesce(min(CASE WHEN c IS NULL OR {O.bare_host('c')} = '' OR {O.bare_host('c')} <> {O.bare_host('url')} THEN 3 WHEN {_CPATH('c')} = {_CPATH('url')} THEN 0
    WHEN starts_with({_CPATH('c')}, {_CPATH('url')}) OR starts_with({_CPATH('url')}, {_CPATH('c')}) THEN 1 ELSE 2 END), 3) AS r FROM (
     SELECT page_id, engine, url, unnest(CASE WHEN citations_text = '' THEN [NULL] ELSE split(citations_text, ';') END) AS c FROM fv_resp) t GROUP BY page_id, engine)"""
]


@query(
    "citation_match_level",
    ["fv_resp"],
    "SELECT page_id, engine, CASE r WHEN 0 THEN 'exact' WHEN 1 THEN 'path' WHEN 2 THEN 'host_only' ELSE 'none' END AS citation_level, r < 3 AS cited_official FROM cl",
    LEVEL_CTES,
)
def citation_match_level(spark, sf_dir):
    return D.citation_match_level(responses(spark, sf_dir), KEYS)


_view(
    "fv_subpages",
    ["fv_rich"],
    """
SELECT r.page_id, 'https://' || r.host || s.tail AS sub_url, s.sub_no FROM fv_rich r CROSS JOIN (VALUES ('/about', 1), ('/Service/List', 2), ('/en', 3)) AS s(tail, sub_no)
""",
)
_view(
    "fv_subresp",
    ["fv_resp"],
    """
SELECT page_id, engine, citations_text, CASE (page_id + engine_no) % 5
  WHEN 0 THEN 'https://' || host || '/about 접근성공 제목: About ' || chr(10) || '/service/list 접근 실패 (404 not found)'
  WHEN 1 THEN '1. https://' || host || '/service/list - 접근실패, robots 차단됨'
  WHEN 2 THEN 'The page /about 요약: it tells about the company and its robots.'
  WHEN 3 THEN 'see /service/list which has a long description of many services and other words that go on for well over one hundred characters in total here'
  ELSE 'nothing to say' END AS text
FROM fv_resp WHERE status = 'success'
""",
)


@query(
    "subpage_reach",
    ["fv_subpages", "fv_subresp"],
    f"""SELECT page_id, engine, sub_url, evidence, reached, CASE WHEN fail AND regexp_matches(near, '차단|block|403|robot|disallow') THEN 'blocked' WHEN fail AND regexp_matches(near, '404|not found|찾을 수 없') THEN 'missing_page'
   WHEN reached = 'no' THEN 'not_reached' WHEN reached = 'uncertain' THEN 'unclear' END AS cause
 FROM (SELECT *, CASE WHEN evidence IN ('citation_match', 'structured_response') THEN 'yes' WHEN evidence = 'content_summary' THEN 'uncertain' ELSE 'no' END AS reached FROM (
  SELECT *, CASE WHEN cited THEN 'citation_match' WHEN good THEN 'structured_response' WHEN fail THEN 'structured_fail' WHEN length(near) > 30 AND (regexp_matches(near, '요약:|내용:') OR length(near) > 100) THEN 'content_summary' ELSE 'not_mentioned' END AS evidence FROM (
   SELECT *, regexp_matches(near, '접근 ?실패') AS fail, regexp_matches(near, '접근 ?성공') OR (contains(near, '제목:') AND NOT contains(near, '접근실패')) AS good FROM (
    SELECT page_id, engine, sub_url, cited, CASE WHEN pos > 0 THEN substr(t, CAST(pos AS BIGINT)) ELSE '' END AS near FROM (
     SELECT *, CASE WHEN strpos(t, lower(sub_url)) > 0 THEN strpos(t, lower(sub_url)) ELSE strpos(t, lower({O.path('sub_url')})) END AS pos FROM (
      SELECT s.page_id, a.engine, s.sub_url, lower(a.text) AS t, len(list_filter(CASE WHEN a.citations_text = '' THEN []::VARCHAR[] ELSE split(a.citations_text, ';') END,
        lambda c: CASE WHEN {O.host('c')} = '' THEN contains(lower(c), lower({O.path('s.sub_url')})) ELSE {O.bare_host('c')} = {O.bare_host('s.sub_url')} AND {O.trimmed_path('c')} = {O.trimmed_path('s.sub_url')} END)) > 0 AS cited
      FROM fv_subpages s JOIN fv_subresp a ON a.page_id = s.page_id) q1) q2) q3) q4) q5) q6""",
)
def subpage_reach(spark, sf_dir):
    answers = view(spark, sf_dir, "fv_subresp").withColumn(
        "citations", F.filter(F.split("citations_text", ";"), lambda c: c != "")
    )
    return D.subpage_reach(view(spark, sf_dir, "fv_subpages"), answers, KEYS)
