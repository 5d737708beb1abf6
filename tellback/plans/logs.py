"""Queries over payloads, delivery logs, leads, quotas, streams, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import text as T
from tellback.operators import leads as L
from tellback.operators import payloads as Y
from tellback.operators import review as V
from tellback.operators import sites as S
from tellback.plans import benchmark as PB
from tellback.plans import osql as O
from tellback.plans import pages as PP
from tellback.plans import sites as PS
from tellback.plans.fixtures import _view, table, view
from tellback.plans.registry import query
from tellback.sources import charset as CH
from tellback.sources import sinks as K
from tellback.sources import tables as ST
from tellback.streaming import jobs as J
from tellback.streaming import quota as Q

B = chr(92)

# --- payloads ------------------------------------------------------------------------
_view(
    "fv_payload",
    [],
    """
SELECT p.page_id, e.engine, CASE e.engine
  WHEN 'chatgpt' THEN CASE WHEN p.page_id % 3 = 0 THEN '{"output_text": " direct ' || n || ' ", "output": []}'
    ELSE '{"output": [{"type": "web_search_call", "action": {"query": "org ' || n || '  tools", "queries": ["org ' || n || '", "https://x.example/y", "search"]}}, {"type": "message", "content": [{"type": "output_text", "text": "Hello ' || n
      || '", "annotations": [{"url": "https://a.example/' || n || '"}, {"url": "https://a.example/' || n || '"}]}, {"type": "refusal", "text": "no"}, {"type": "output_text", "text": "world"}]}], "usage": {"input_tokens": 5, "output_tokens": ' || n || ', "total_tokens": 1' || n || '}}' END
  WHEN 'gemini' THEN CASE WHEN p.page_id % 4 = 0 THEN '{"candidates": [{"content": {"parts": [{"text": "Only ' || n || '"}]}}]}'
    ELSE '{"candidates": [{"content": {"parts": [{"text": "Part ' || n || ' "}, {"x": 1}, {"text": "two"}]}, "groundingMetadata": {"webSearchQueries": ["q ' || n || '", "q ' || n || '", "search"], "groundingChunks": [{"web": {"uri": "https://vertexaisearch.cloud.google.com/r/' || n || '", "title": "www.Org' || n
      || '.example.com"}}, {"web": {"uri": "https://plain.example/' || n || '", "title": "t"}}, {"web": {"uri": "https://vertexaisearch.cloud.google.com/r/x", "title": "no host"}}], "groundingSupports": [{}, {}]}}], "usageMetadata": {"promptTokenCount": 7, "totalTokenCount": 9' || n || '}}' END
  ELSE CASE WHEN p.page_id % 5 = 0 THEN 'not json' WHEN p.page_id % 2 = 0 THEN '{"choices": [{"message": {"content": "Answer ' || n || '", "search_queries": ["pq ' || n || '", "tool"]}}], "citations": ["https://c.example/' || n || '", "https://d.example/"], "search_results": [{}, {}, {}]}'
    ELSE '{"choices": [{"message": {"content": [{"text": "List ' || n || ' "}, {"content": "end"}]}}], "search_queries": [{"query": "nested ' || n || '", "note": "x"}, "web search"], "citations": [], "usage": {"total_tokens": 3}}' END END AS payload
FROM (SELECT page_id, CAST(page_id AS STRING) AS n FROM pages) p CROSS JOIN (VALUES ('chatgpt'),('gemini'),('perplexity')) AS e(engine)
""",
)


def payloads(spark, sf_dir):
    df = Y.with_document(view(spark, sf_dir, "fv_payload"))
    return Y.payload_grounding(Y.payload_search_queries(Y.payload_citations(Y.payload_text(df))))


_J = "CASE WHEN json_valid(payload) THEN payload::JSON END"
_X = lambda p: f"json_extract_string(j, '{p}')"
PAY_CTES = [
    f"pj AS MATERIALIZED (SELECT page_id, engine, payload, {_J} AS j FROM fv_payload)",
    f"""pt AS MATERIALIZED (SELECT *, trim(coalesce(CASE engine
   WHEN 'chatgpt' THEN coalesce(nullif(trim({_X('$.output_text')}), ''), (SELECT string_agg(t, chr(10) ORDER BY o, p) FROM (SELECT o, unnest(range(len(cs))) AS p, json_extract_string(unnest(cs), '$.text') AS t, json_extract_string(unnest(cs), '$.type') AS ty FROM (
      SELECT unnest(range(len(os))) AS o, json_extract(unnest(os), '$.content[*]') AS cs FROM (SELECT json_extract(j, '$.output[*]') AS os) a) b) c WHERE ty = 'output_text'))
   WHEN 'gemini' THEN array_to_string(list_filter(json_extract_string(j, '$.candidates[0].content.parts[*].text'), lambda t: t IS NOT NULL), '')
   ELSE CASE json_type(j, '$.choices[0].message.content') WHEN 'ARRAY' THEN array_to_string(list_transform(json_extract(j, '$.choices[0].message.content[*]'), lambda c: coalesce(json_extract_string(c, '$.text'), json_extract_string(c, '$.content'), '')), '') ELSE {_X('$.choices[0].message.content')} END END, '')) AS text,
   CASE engine WHEN 'chatgpt' THEN json_extract_string(j, '$.output[*].content[*].annotations[*].url')
    WHEN 'gemini' THEN list_transform(json_extract(j, '$.candidates[0].groundingMetadata.groundingChunks[*]'), lambda c: CASE WHEN json_extract_string(c, '$.web.uri') LIKE 'https://vertexaisearch.cloud.google.com/%' AND regexp_matches(lower(json_extract_string(c, '$.web.title')), '^[a-z0-9-]+([.][a-z0-9-]+)+$')
      THEN 'https://' || regexp_replace(lower(json_extract_string(c, '$.web.title')), '^www[.]', '') ELSE json_extract_string(c, '$.web.uri') END) ELSE json_extract_string(j, '$.citations[*]') END AS cites,
   CASE engine WHEN 'chatgpt' THEN list_concat([json_extract_string(j, '$.output[0].action.query')], json_extract_string(j, '$.output[0].action.queries[*]'))
    WHEN 'gemini' THEN json_extract_string(j, '$.candidates[0].groundingMetadata.webSearchQueries[*]') ELSE list_concat(json_extract_string(j, '$.search_queries[0].query[*]'), [json_extract_string(j, '$.search_queries[0].query'), json_extract_string(j, '$.search_queries[1]')], json_extract_string(j, '$.choices[0].message.search_queries[*]')) END AS qs FROM pj)""",
    f"""pq AS MATERIALIZED (SELECT *, {O.uniq("list_filter(cites, lambda c: c IS NOT NULL)")} AS citations, {O.uniq('list_transform(list_filter(qs, lambda q: q IS NOT NULL), lambda q: ' + O.squeeze('q') + ')', "v <> '' AND (engine = 'gemini' OR (length(v) BETWEEN 2 AND 200 AND v NOT LIKE 'http%' AND NOT list_contains([" + ', '.join(O.lit(x) for x in dims.QUERY_NOISE) + "], lower(v))))")} AS queries FROM pt)""",
]


@query("payload_text", ["fv_payload"], "SELECT page_id, engine, text FROM pt", PAY_CTES[:2])
def payload_text(spark, sf_dir):
    return Y.payload_text(Y.with_document(view(spark, sf_dir, "fv_payload"))).select(
        "page_id", "engine", F.coalesce("text", F.lit("")).alias("text")
    )


@query(
    "payload_citations",
    ["fv_payload"],
    f"SELECT page_id, engine, coalesce({O.joined('citations')}, '') AS citations FROM pq",
    PAY_CTES,
)
def payload_citations(spark, sf_dir):
    return Y.payload_citations(Y.with_document(view(spark, sf_dir, "fv_payload"))).select(
        "page_id", "engine", F.coalesce("citations", F.array().cast("array<string>")).alias("citations")
    )


@query(
    "payload_search_queries",
    ["fv_payload"],
    f"SELECT page_id, engine, coalesce({O.joined('queries')}, '') AS search_queries FROM pq",
    PAY_CTES,
)
def payload_search_queries(spark, sf_dir):
    return Y.payload_search_queries(Y.with_document(view(spark, sf_dir, "fv_payload"))).select(
        "page_id", "engine", F.coalesce("search_queries", F.array().cast("array<string>")).alias("search_queries")
    )


@query(
    "payload_grounding",
    ["fv_payload"],
    """SELECT page_id, engine, tool_calls, search_results, supports, tokens_in, tokens_out, tokens_total, coalesce(len(citations), 0) > 0 OR coalesce(len(queries), 0) > 0 OR coalesce(tool_calls, 0) > 0 OR coalesce(search_results, 0) > 0 OR coalesce(supports, 0) > 0 AS grounded FROM (
  SELECT *, CASE WHEN engine = 'chatgpt' THEN CAST(len(list_filter(json_extract_string(j, '$.output[*].type'), lambda t: contains(lower(t), 'search'))) AS BIGINT) END AS tool_calls,
   CASE engine WHEN 'perplexity' THEN nullif(CAST(json_array_length(j, '$.search_results') AS BIGINT), 0) WHEN 'gemini' THEN nullif(CAST(json_array_length(j, '$.candidates[0].groundingMetadata.groundingChunks') AS BIGINT), 0) END AS search_results,
   CASE WHEN engine = 'gemini' THEN nullif(CAST(json_array_length(j, '$.candidates[0].groundingMetadata.groundingSupports') AS BIGINT), 0) END AS supports,
   CAST(coalesce(json_extract(j, '$.usage.input_tokens'), json_extract(j, '$.usageMetadata.promptTokenCount')) AS BIGINT) AS tokens_in, CAST(coalesce(json_extract(j, '$.usage.output_tokens'), json_extract(j, '$.usageMetadata.candidatesTokenCount')) AS BIGINT) AS tokens_out,
   CAST(coalesce(json_extract(j, '$.usage.total_tokens'), json_extract(j, '$.usageMetadata.totalTokenCount')) AS BIGINT) AS tokens_total FROM pq) t""",
    PAY_CTES,
)
def payload_grounding(spark, sf_dir):
    return payloads(spark, sf_dir).select(
        "page_id", "engine", "tool_calls", "search_results", "supports", "tokens_in", "tokens_out", "tokens_total",
        F.coalesce("grounded", F.lit(False)).alias("grounded"),
    )


@query(
    "payload_key_diagnostics",
    ["fv_payload"],
    """SELECT page_id, engine, replace(replace(t.fullkey, '$', 'root'), '"', '') AS path, CASE t.type WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind
 FROM pj, json_tree(pj.j) t WHERE pj.j IS NOT NULL AND t.key IS NOT NULL AND regexp_matches(lower(t.key), 'query|search|tool|action') AND NOT regexp_matches(t.key, '^[0-9]+$')""",
    PAY_CTES[:1],
)
def payload_key_diagnostics(spark, sf_dir):
    return Y.payload_key_diagnostics(view(spark, sf_dir, "fv_payload"), "page_id")


# --- delivery logs --------------------------------------------------------------------
_view(
    "fv_log_answers",
    [],
    """
SELECT p.url, r.run || '-' || CAST(p.page_id AS STRING) || '.json' AS file_name, e.engine,
  CASE WHEN (p.page_id + e.engine_no + r.run_no) % 10 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE (p.page_id + e.engine_no) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'path' WHEN 2 THEN 'host_only' ELSE 'none' END AS citation_level,
  CASE (p.page_id + e.engine_no * 3 + r.run_no) % 4 WHEN 0 THEN '' WHEN 1 THEN 'entity_name' ELSE 'entity_name;founded;headquarters' END AS delivered_text,
  CASE (p.page_id * 3 + e.engine_no + r.run_no) % 5 WHEN 0 THEN '' WHEN 1 THEN 'description|jsonld_only|low' WHEN 2 THEN 'description|dual_source_missed|low;entity_type|unknown|low' WHEN 3 THEN 'revenue|robots_blocked|high' ELSE 'revenue|jsonld_only|low;description|jsonld_only|low' END AS missed_text,
  CASE WHEN (p.page_id + e.engine_no) % 3 = 0 THEN 'uncertain;no' ELSE 'yes' END AS reached_text
FROM pages p CROSS JOIN (VALUES ('chatgpt',1),('gemini',2),('perplexity',3)) AS e(engine, engine_no) CROSS JOIN (VALUES ('2026-01-01',1),('2026-01-02',2)) AS r(run, run_no)
WHERE (r.run_no = 1 OR p.page_id % 3 = 0) AND (p.page_id + e.engine_no) % 11 <> 0
""",
)


def logs(spark, sf_dir):
    """Log records with an engines map, as a reader of log files gives them."""
    part = lambda m, i: F.element_at(F.split(m, "\\|"), i)
    nonempty = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
    rows = view(spark, sf_dir, "fv_log_answers").select(
        "url", "file_name", "engine", "status", "citation_level",
        nonempty("delivered_text").alias("delivered"),
        F.transform(
            nonempty("missed_text"),
            lambda m: F.struct(part(m, 1).alias("field"), part(m, 2).alias("signal"), part(m, 3).alias("confidence")),
        ).alias("missed"),
        F.transform(
            F.split("reached_text", ";"), lambda s, i: F.struct(i.cast("string").alias("url"), s.alias("reached"))
        ).alias("subpages"),
    )
    value = F.struct("status", "citation_level", "delivered", "missed", "subpages")
    # three engines per log
    return rows.groupBy("url", "file_name").agg(F.map_from_entries(F.collect_list(F.struct("engine", value))).alias("engines"))


def newest(spark, sf_dir):
    return V.explode_engines(V.latest_log(logs(spark, sf_dir)))


LOG_CTES = [
    "la AS MATERIALIZED (SELECT * FROM fv_log_answers QUALIFY file_name = max(file_name) OVER (PARTITION BY url))",
    """lm AS MATERIALIZED (SELECT *, CASE WHEN delivered_text = '' THEN []::VARCHAR[] ELSE split(delivered_text, ';') END AS d, CASE WHEN missed_text = '' THEN []::VARCHAR[] ELSE split(missed_text, ';') END AS m FROM la)""",
]


@query("latest_log_per_url", ["fv_log_answers"], "SELECT DISTINCT url, file_name FROM la", LOG_CTES[:1])
def latest_log_per_url(spark, sf_dir):
    return V.latest_log(logs(spark, sf_dir)).select("url", "file_name")


ENGINE_STATS_SQL = """SELECT engine, count(*) AS urls, CAST(count_if(status = 'success') AS BIGINT) AS urls_ok, CAST(sum(CASE WHEN status = 'success' THEN len(d) ELSE 0 END) AS BIGINT) AS fields_delivered, CAST(sum(CASE WHEN status = 'success' THEN len(d) + len(m) ELSE 0 END) AS BIGINT) AS fields_total,
  round(sum(CASE WHEN status = 'success' THEN len(d) ELSE 0 END) * 100.0::DOUBLE / sum(CASE WHEN status = 'success' THEN len(d) + len(m) ELSE 0 END), 1) AS delivery_pct FROM lm GROUP BY engine"""


@query("delivery_engine_stats", ["fv_log_answers"], ENGINE_STATS_SQL, LOG_CTES)
def delivery_engine_stats(spark, sf_dir):
    return V.engine_stats(newest(spark, sf_dir))


_LOW = lambda s: f"len(list_filter(m, lambda x: x LIKE '%|{s}|low'))"
_OTHER = "len(list_filter(m, lambda x: x LIKE '%|low' AND x NOT LIKE '%|jsonld_only|%' AND x NOT LIKE '%|dual_source_missed|%'))"
_UNC = "len(list_filter(split(reached_text, ';'), lambda x: x = 'uncertain'))"
QUEUE_CTES = LOG_CTES + [
    f"""rq AS MATERIALIZED (SELECT url, engine, 'delivered_no_citation' AS type, CASE WHEN (len(d) = 1 AND d[1] = 'entity_name' AND len(m) = 0) OR engine = 'gemini' THEN 'info' ELSE 'warn' END AS severity, len(d) AS items FROM lm WHERE status = 'success' AND len(d) > 0 AND citation_level = 'none'
   UNION ALL SELECT url, engine, 'citation_host_only', 'info', 1 FROM lm WHERE status = 'success' AND citation_level = 'host_only' UNION ALL SELECT url, engine, 'jsonld_only_miss', 'info', {_LOW('jsonld_only')} FROM lm WHERE status = 'success' AND {_LOW('jsonld_only')} > 0
   UNION ALL SELECT url, engine, 'dual_source_miss', 'review', {_LOW('dual_source_missed')} FROM lm WHERE status = 'success' AND {_LOW('dual_source_missed')} > 0 UNION ALL SELECT url, engine, 'missed_low_confidence', 'review', {_OTHER} FROM lm WHERE status = 'success' AND {_OTHER} > 0
   UNION ALL SELECT url, engine, 'subpage_uncertain', 'review', {_UNC} FROM lm WHERE status = 'success' AND {_UNC} > 0
   UNION ALL SELECT url, engine, 'total_miss', CASE WHEN len(list_filter(m, lambda x: x LIKE '%|jsonld_only|%')) = len(m) THEN 'info' ELSE 'warn' END, len(m) FROM lm WHERE status = 'success' AND len(d) = 0 AND len(m) > 0)"""
]


@query("review_queue", ["fv_log_answers"], "SELECT url, engine, type, severity, items FROM rq", QUEUE_CTES)
def review_queue(spark, sf_dir):
    return V.review_queue(newest(spark, sf_dir))


@query(
    "review_severity",
    ["fv_log_answers"],
    "SELECT severity, type, count(*) AS items FROM rq GROUP BY ALL",
    QUEUE_CTES,
)
def review_severity(spark, sf_dir):
    return V.review_queue(newest(spark, sf_dir)).groupBy("severity", "type").agg(F.count(F.lit(1)).alias("items"))


def _cell(e: str) -> str:
    return f"coalesce(max(CASE WHEN engine = '{e}' THEN CASE WHEN status = 'success' THEN len(d) || '/' || (len(d) + len(m)) || ' ' || citation_level ELSE 'ERR' END END), 'ERR') AS {e}"


@query(
    "delivery_comparison",
    ["fv_log_answers"],
    f"SELECT url, CASE WHEN regexp_matches(regexp_replace({O.path('url')}, '(.)/$', '\\1'), '^/en/[1-4][0-9][0-9]$') THEN 'own' WHEN regexp_matches(regexp_replace({O.path('url')}, '(.)/$', '\\1'), '^/de/[1-9][0-9]?$') THEN 'experiment' ELSE 'external' END AS kind, {_cell('chatgpt')}, {_cell('gemini')}, {_cell('perplexity')} FROM lm GROUP BY url",
    LOG_CTES,
)
def delivery_comparison(spark, sf_dir):
    return V.delivery_comparison(newest(spark, sf_dir), ["chatgpt", "gemini", "perplexity"], [f"/en/{n}" for n in range(100, 500)], [f"/de/{n}" for n in range(1, 100)])


REPORT_CTES = LOG_CTES + PS.LINT_CTES + [
    """lints AS MATERIALIZED (SELECT url, max(fail_count) AS fail_count, max(warn_count) AS warn_count, max(declared_facts) AS declared_facts FROM (
     SELECT l.url, count(*) FILTER (c.status = 'fail') AS fail_count, count(*) FILTER (c.status = 'warn') AS warn_count, any_value(l.fact_labels) AS declared_facts
     FROM li l JOIN lint c USING (page_id) GROUP BY l.page_id, l.url) t GROUP BY url)""",
    """rp AS MATERIALIZED (SELECT a.*, CAST(coalesce(l.fail_count, 0) AS BIGINT) AS f, CAST(coalesce(l.warn_count, 0) AS BIGINT) AS w, CAST(coalesce(l.declared_facts, 0) AS BIGINT) AS declared_facts FROM (SELECT url, count(*) AS engines_checked, CAST(count_if(citation_level = 'exact') AS BIGINT) AS cited_exact, CAST(count_if(citation_level = 'path') AS BIGINT) AS cited_path, CAST(count_if(citation_level = 'host_only') AS BIGINT) AS cited_host_only, CAST(count_if(citation_level = 'none') AS BIGINT) AS cited_none,
     coalesce(string_agg(CASE WHEN len(d) + len(m) > 0 AND len(d)::DOUBLE / (len(d) + len(m)) < 0.8 THEN engine END, ' | ' ORDER BY engine), '') AS weak_engines FROM lm GROUP BY url) a LEFT JOIN lints l USING (url))""",
    """rpt AS MATERIALIZED (SELECT url, engines_checked, cited_exact, cited_path, cited_host_only, cited_none, weak_engines, declared_facts, CASE WHEN f > 0 THEN f || ' blockers' WHEN w > 0 THEN w || ' warnings' ELSE 'ready' END AS structure,
    CASE WHEN len(na) > 0 THEN na ELSE ['keep_stable'] END AS na FROM (SELECT *, list_filter([CASE WHEN declared_facts = 0 THEN 'declare_facts' END, CASE WHEN f > 0 OR w > 0 THEN 'fix_structure' END, CASE WHEN weak_engines <> '' THEN 'improve_consistency' END, CASE WHEN cited_exact = 0 THEN 'strengthen_citation' END], lambda x: x IS NOT NULL) AS na FROM rp) t)""",
]


def report(spark, sf_dir):
    """Newest logs with the lint of the pages they are about."""
    inputs, bots = PS.lint_parts(spark, sf_dir)
    # only what the lint looks at: what is stored has to be computed
    inputs = K.store(inputs.select("page_id", "host", "url", *S.LINT_COLUMNS), "lint-inputs")
    urls = inputs.select("page_id", "url", F.col("fact_labels").alias("declared_facts"))
    lint = S.lint_summary(S.page_lint(inputs, bots)).join(urls, "page_id")
    lint = lint.groupBy("url").agg(*[F.max(c).alias(c) for c in ("fail_count", "warn_count", "declared_facts")])  # pages of one URL
    return V.official_source_report(newest(spark, sf_dir), lint, lint.select("url", "declared_facts"))


@query(
    "official_source_report",
    ["fv_log_answers", "fv_rich", "fv_robots"],
    f"SELECT url, engines_checked, cited_exact, cited_path, cited_host_only, cited_none, weak_engines, declared_facts, structure, {O.joined('na')} AS next_actions FROM rpt",
    REPORT_CTES,
)
def official_source_report(spark, sf_dir):
    return report(spark, sf_dir)


@query(
    "preflight_summary",
    [],
    "SELECT CASE WHEN page_id % 7 = 0 THEN 'crawl_error' WHEN page_id % 3 > 0 THEN 'gt_positive' ELSE 'gt_absent' END AS status, count(*) AS urls, CAST(count_if(page_id % 2 = 0) AS BIGINT) AS with_jsonld, CAST(sum(page_id % 3) AS BIGINT) AS fields FROM pages GROUP BY 1",
)
def preflight_summary(spark, sf_dir):
    p = F.col("page_id")
    df = table(spark, sf_dir, "pages").select(
        F.when(p % 7 == 0, "timeout").alias("error"),
        (p % 3).alias("field_count"),
        F.when(p % 2 == 0, F.array(F.lit("Organization"))).otherwise(F.array().cast("array<string>")).alias("jsonld_types"),
    )
    return V.preflight_summary(df)


# --- leads and redaction ---------------------------------------------------------------
_view(
    "fv_leads",
    [],
    """
SELECT c_custkey AS lead_id, CASE c_custkey % 6 WHEN 0 THEN '' ELSE '  ' || c_name || '   Kim ' END AS contact_name, CASE c_custkey % 5 WHEN 0 THEN 'bad mail' WHEN 1 THEN NULL ELSE ' User' || CAST(c_custkey AS STRING) || '@Example.COM' END AS email,
  CASE c_custkey % 3 WHEN 0 THEN c_name ELSE NULL END AS company_name, CASE c_custkey % 3 WHEN 1 THEN 'Alt ' || c_name ELSE '' END AS company, CASE c_custkey % 7 WHEN 0 THEN 'Nick' ELSE '' END AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'https://www.Site' || CAST(c_custkey AS STRING) || '.example.com/path' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'WWW.plain.example.org/x' END AS domain,
  CASE c_custkey % 5 WHEN 0 THEN 'http://Web.example.com' WHEN 1 THEN '' WHEN 2 THEN 'www.shop.example.net/a?b=1' ELSE NULL END AS url, CASE c_custkey % 8 WHEN 3 THEN 'https://target.example.com/t' ELSE NULL END AS website_url, CAST(NULL AS STRING) AS target_url,
  CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'Cafe and yoga' WHEN 2 THEN 'developer API' WHEN 3 THEN 'law consulting' WHEN 4 THEN 'online shop mall' WHEN 5 THEN '교육 강의' WHEN 6 THEN 'B2B platform cafe' ELSE 'bricks' END AS main_service,
  c_mktsegment AS industry, CASE c_custkey % 3 WHEN 0 THEN 'cloud' WHEN 1 THEN 'self' ELSE 'weird' END AS hosting FROM customer
""",
)
_RULES = " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{n}'" for n, p in L.TEMPLATE_RULES)
_CL = lambda x, n: f"substr({O.squeeze(x)}, 1, {n})"
LEAD_CTES = [
    f"""ld0 AS MATERIALIZED (SELECT lead_id, {_CL('contact_name', 80)} AS contact_name, lower({_CL('email', 160)}) AS email, {_CL("coalesce(nullif(company_name, ''), nullif(company, ''), nullif(name, ''), '')", 120)} AS company, {_CL("coalesce(nullif(url, ''), nullif(website_url, ''), '')", 400)} AS u0,
   {_CL('main_service', 220)} AS main_service, CASE WHEN hosting IN ('cloud', 'self') THEN hosting ELSE 'other' END AS hosting, coalesce(domain, '') AS dom, industry FROM fv_leads)""",
    f"""ld1 AS MATERIALIZED (SELECT *, CASE WHEN u0 = '' THEN '' WHEN {O.has('u0', '(?i)^https?://')} THEN {O.normal('u0')} ELSE {O.normal("('https://' || u0)")} END AS clean_url FROM ld0)""",
    f"""ld2 AS MATERIALIZED (SELECT *, lower({O.sub(O.sub(O.sub(_CL("coalesce(nullif(dom, ''), " + O.bare_host('clean_url') + ")", 255), '(?i)^https?://'), '(?i)^www[.]'), '/.*$')}) AS clean_domain, lower(industry || ' ' || main_service || ' ') AS h FROM ld1)""",
    f"""ld AS MATERIALIZED (SELECT *, CASE {_RULES} ELSE 'general-business' END AS template, list_filter([CASE WHEN contact_name = '' THEN 'contact_name' END, CASE WHEN NOT regexp_matches(email, '^[^\\s@]+@[^\\s@]+[.][^\\s@]+$') THEN 'email' END, CASE WHEN company = '' THEN 'company' END,
   CASE WHEN clean_domain = '' AND clean_url = '' THEN 'domain' END, CASE WHEN main_service = '' THEN 'main_service' END], lambda x: x IS NOT NULL) AS errors FROM ld2)""",
]


@query(
    "lead_cleanse",
    ["fv_leads"],
    f"SELECT lead_id, contact_name, email, company, clean_url, clean_domain, hosting, {O.joined('errors')} AS errors FROM ld",
    LEAD_CTES,
)
def lead_cleanse(spark, sf_dir):
    return L.lead_cleanse(view(spark, sf_dir, "fv_leads"), ["cloud", "self"]).select(
        "lead_id", "contact_name", "email", "company", "clean_url", "clean_domain", "hosting", "errors"
    )


@query("industry_template", ["fv_leads"], "SELECT lead_id, template FROM ld", LEAD_CTES)
def industry_template(spark, sf_dir):
    return L.lead_cleanse(view(spark, sf_dir, "fv_leads"), ["cloud", "self"]).select("lead_id", "template")


_view(
    "fv_records",
    [],
    """
SELECT event_id, 'https://log.example.com/' || repeat('p', CAST(event_id % 90 AS INT)) || '?q=secret' AS url, 'user' || CAST(user_id AS STRING) || '@mail.example' AS email,
  '{"apiKey":"abc' || CAST(event_id AS STRING) || '","email":"u' || CAST(user_id AS STRING) || '@mail.example","note":"' || repeat('n', CAST(event_id % 300 AS INT)) || '","inner":{"sessionToken":"t","n":' || CAST(event_id AS STRING) || '}}' AS record FROM events
""",
)


@query(
    "redact_logs",
    ["fv_records"],
    f"""SELECT event_id, {O.host('url')} || CASE WHEN length({O.path('url')}) > 60 THEN substr({O.path('url')}, 1, 60) || '...' ELSE {O.path('url')} END AS url, substr(email, 1, 1) || '***' || substr(email, strpos(email, '@')) AS email, '[REDACTED]' AS api_key,
  substr(json_extract_string(record, '$.email'), 1, 1) || '***@mail.example' AS inner_email, CASE WHEN length(json_extract_string(record, '$.note')) > 200 THEN 203 ELSE length(json_extract_string(record, '$.note')) END AS note_chars, '[REDACTED]' AS token, event_id AS n FROM fv_records""",
)
def redact_logs(spark, sf_dir):
    df = view(spark, sf_dir, "fv_records").withColumn("r", L.redact_json("record"))
    get = lambda p: F.get_json_object("r", p)
    return df.select(
        "event_id", L.redact_url(F.col("url")).alias("url"), L.redact_email(F.col("email")).alias("email"),
        get("$.apiKey").alias("api_key"), get("$.email").alias("inner_email"), F.length(get("$.note")).alias("note_chars"),
        get("$.inner.sessionToken").alias("token"), get("$.inner.n").cast("bigint").alias("n"),
    )


# --- quotas and reuse --------------------------------------------------------------------
DAY = 86_400_000


def requests(spark, sf_dir, per_type: bool = False):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type") if per_type else F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        key.alias("key"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms")
    )


def window_ctes(key: str, length: int) -> list[str]:
    return [
        f"ev AS MATERIALIZED (SELECT {key} AS key, event_id, epoch_us(ts) // 1000 AS ms FROM events)",
        f"anc AS (SELECT key, min(ms) AS a FROM ev GROUP BY key UNION ALL SELECT s.key, s.nx FROM (SELECT anc.key, (SELECT min(e.ms) FROM ev e WHERE e.key = anc.key AND e.ms >= anc.a + {length}) AS nx FROM anc) s WHERE s.nx IS NOT NULL)",
        f"win AS MATERIALIZED (SELECT e.key, e.event_id, e.ms, a.a, row_number() OVER (PARTITION BY e.key, a.a ORDER BY e.ms, e.event_id) AS nth FROM ev e JOIN anc a ON a.key = e.key AND e.ms >= a.a AND e.ms < a.a + {length})",
    ]


QUOTA_SQL = f"SELECT key, event_id, nth AS request_no, nth <= 2 AS allowed, greatest(2 - nth, 0) AS remaining, CAST(ceil((a + {DAY} - ms) / 1000.0::DOUBLE) AS BIGINT) AS reset_seconds FROM win"


@query("quota_windows", [], QUOTA_SQL, window_ctes("CAST(user_id AS VARCHAR)", DAY))
def quota_windows(spark, sf_dir):
    return Q.quota_windows(requests(spark, sf_dir), DAY, 2, "event_id")


@query(
    "freshness_reuse",
    [],
    "SELECT key, event_id, nth > 1 AS hit FROM win",
    window_ctes("CAST(user_id AS VARCHAR) || ':' || event_type", 3 * DAY),
)
def freshness_reuse(spark, sf_dir):
    return Q.freshness_reuse(requests(spark, sf_dir, per_type=True), 3 * DAY, "event_id")


@query("quota_windows_stream", [], QUOTA_SQL, window_ctes("CAST(user_id AS VARCHAR)", DAY))
def quota_windows_stream(spark, sf_dir):
    """The same decisions by the stateful stream, run over the events file until it is used up."""
    schema = table(spark, sf_dir, "events").schema
    stream = J.file_stream(spark, f"{sf_dir}/events*.parquet", schema, "parquet")
    asked = stream.select(
        F.col("user_id").cast("string").alias("key"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms")
    )
    out = K.shared_folder(spark, "quota")
    J.keep_table(Q.quota_stream(asked, DAY, 2, "event_id"), f"{out}/table", f"{out}/checkpoint", "append").awaitTermination()
    return spark.read.parquet(f"{out}/table").drop("version")


@query(
    "freshness_reuse_stream",
    [],
    "SELECT key, event_id, nth > 1 AS hit FROM win",
    window_ctes("CAST(user_id AS VARCHAR) || ':' || event_type", 3 * DAY),
)
def freshness_reuse_stream(spark, sf_dir):
    """The same reuse by the stream with keyed state: requests arrive in three files in time order, and the stream starts anew after each."""
    asked = requests(spark, sf_dir, per_type=True)
    # about there: exact percentiles would gather all distinct times in one task
    cuts = asked.agg(F.percentile_approx("ms", F.array(F.lit(0.4), F.lit(0.7)), 1_000).alias("at")).first()["at"] or [0, 0]
    out = K.shared_folder(spark, "reuse")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = asked if low is None else asked.where(F.col("ms") > low)
        (part if high is None else part.where(F.col("ms") <= high)).write.mode("append").parquet(f"{out}/requests")
        stream = J.file_stream(spark, f"{out}/requests", asked.schema, "parquet", files_per_batch=1_000)
        J.keep_table(Q.freshness_stream(stream, 3 * DAY, "event_id"), f"{out}/table", f"{out}/checkpoint", idle_batches=False).awaitTermination()
    return spark.read.parquet(f"{out}/table").drop("version")


def arrived(spark, sf_dir):
    """Latest log per URL, kept by a stream over a folder of log files that arrive in several batches."""
    out = K.shared_folder(spark, "latest")
    every = logs(spark, sf_dir).select("url", "file_name", "engines")
    early = F.pmod(F.xxhash64("url", "file_name"), F.lit(3)) > 0
    for part in (every.where(early), every.where(~early)):  # what comes after a compaction is read on top of it
        J.compact(spark, f"{out}/table", "url")
        part.repartition(4).write.mode("append").json(f"{out}/logs")
        stream = J.file_stream(spark, f"{out}/logs", f"{ST.LOG_SCHEMA}, file_name string", files_per_batch=2)
        J.keep_latest(J.latest_log_stream(stream), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return J.latest_rows(spark, f"{out}/table", "url")


@query("log_stream_latest", ["fv_log_answers"], "SELECT url, file_name, engine, status, citation_level FROM la", LOG_CTES[:1])
def log_stream_latest(spark, sf_dir):
    return V.explode_engines(arrived(spark, sf_dir)).select("url", "file_name", "engine", "status", "citation_level")


@query("log_stream_stats", ["fv_log_answers"], ENGINE_STATS_SQL, LOG_CTES)
def log_stream_stats(spark, sf_dir):
    return V.engine_stats(V.explode_engines(arrived(spark, sf_dir)))


@query(
    "incremental_ingest",
    [],
    "SELECT page_id, CASE WHEN url LIKE '%#%' THEN 'has_fragment' WHEN length(html) < 1500 THEN 'too_short' ELSE 'ok' END AS state FROM pages",
)
def incremental_ingest(spark, sf_dir):
    """Good pages and rejected ones, from two runs over the same folder: the second run adds nothing."""
    schema = table(spark, sf_dir, "pages").schema
    out = K.shared_folder(spark, "ingest")
    reason = F.when(F.contains("url", F.lit("#")), "has_fragment").when(F.length("html") < 1500, "too_short")
    for _ in range(2):
        stream = J.file_stream(spark, f"{sf_dir}/pages*.parquet", schema, "parquet")
        J.incremental_ingest(stream, f"{out}/good", f"{out}/bad", f"{out}/checkpoint", reason).awaitTermination()
    good = spark.read.parquet(f"{out}/good").select("page_id", F.lit("ok").alias("state"))
    return good.unionByName(spark.read.parquet(f"{out}/bad").select("page_id", F.col("reject_reason").alias("state")))


# --- sources and sinks ------------------------------------------------------------------------
@query("scan_json_artifact", [], "SELECT page_id, url FROM pages")
def scan_json_artifact(spark, sf_dir):
    out = K.shared_folder(spark, "artifact")
    table(spark, sf_dir, "pages").select("page_id", "url").write.json(f"{out}/rows")
    found = ST.json_artifact(spark, f"{out}/rows", "page_id long, url string")
    return found.unionByName(ST.json_artifact(spark, f"{out}/absent", "page_id long, url string"))


@query(
    "scan_delivery_logs",
    ["fv_log_answers"],
    "SELECT url, engine, status, citation_level, count(*) AS logs FROM fv_log_answers GROUP BY ALL",
)
def scan_delivery_logs(spark, sf_dir):
    out = K.shared_folder(spark, "logs")
    logs(spark, sf_dir).select("url", "engines").write.json(out)
    read = V.explode_engines(ST.delivery_logs(spark, out))
    return read.groupBy("url", "engine", "status", "citation_level").agg(F.count(F.lit(1)).alias("logs"))


@query("scan_url_list", [], "SELECT url, count(*) AS lines FROM pages GROUP BY url")
def scan_url_list(spark, sf_dir):
    out = K.shared_folder(spark, "urls")
    lines = F.array(F.concat(F.lit("  "), "url", F.lit(" ")), F.lit("# note"), F.lit("   "))
    table(spark, sf_dir, "pages").select(F.explode(lines).alias("value")).write.text(out)
    return ST.url_list(spark, out).groupBy("url").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "sink_tables",
    ["fv_results"],
    "SELECT 'page_rates' AS name, count(*) AS written FROM rates UNION ALL SELECT 'engine_summary', count(DISTINCT engine) FROM fv_results",
    [PB.LATEST, PB.RATES],
)
def sink_tables(spark, sf_dir):
    from tellback.operators import benchmark as A

    named = {"page_rates": PB.page_rates_of(spark, sf_dir), "engine_summary": A.engine_summary(PB.results(spark, sf_dir))}
    paths = K.write_tables(named, K.shared_folder(spark, "tables"))
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("written")).select(F.lit(n).alias("name"), "written") for n, p in paths.items()]
    return counts[0].unionByName(counts[1])


@query(
    "sink_batch_snapshots",
    [],
    "SELECT batch, n AS written, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS snapshot_rows, last_id FROM (SELECT CAST(ceil(rn / 10.0::DOUBLE) AS BIGINT) AS batch, count(*) AS n, max(page_id) AS last_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS rn FROM pages) t GROUP BY 1) u",
)
def sink_batch_snapshots(spark, sf_dir):
    path = K.write_batch_snapshots(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", 10, K.shared_folder(spark, "batches"))
    # rows are numbered through all batches, so the last number of a batch is the size of its snapshot
    return spark.read.parquet(path).groupBy("batch").agg(
        F.count(F.lit(1)).alias("written"), F.max("page_id").alias("last_id"), F.max("row_no").alias("snapshot_rows")
    )


@query(
    "sink_site_logs",
    ["fv_rich"],
    "SELECT host, count(*) AS records, min(page_id) AS first_page FROM fv_rich GROUP BY host",
)
def sink_site_logs(spark, sf_dir):
    out = K.shared_folder(spark, "sites")
    K.write_site_logs(view(spark, sf_dir, "fv_rich").select("host", "page_id", "url"), out)
    read = spark.read.schema("page_id long, url string, host string").json(out)
    return read.groupBy("host").agg(F.count(F.lit(1)).alias("records"), F.min("page_id").alias("first_page"))


@query(
    "sink_text_report",
    ["fv_log_answers", "fv_rich", "fv_robots"],
    "SELECT line, count(*) AS lines FROM (SELECT unnest(['Official source report', 'Target: ' || url, 'Declared facts: ' || declared_facts, 'Structure: ' || structure, 'Exact citations: ' || cited_exact || '/' || engines_checked, 'Next actions: ' || array_to_string(na, ', ')]) AS line FROM rpt) t GROUP BY line",
    REPORT_CTES,
)
def sink_text_report(spark, sf_dir):
    out = K.shared_folder(spark, "report")
    K.write_text_report(V.text_report(report(spark, sf_dir)), out, ["url", "line_no"])
    return spark.read.text(out).select(F.col("value").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "decode_charset",
    [],
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'utf-16' ELSE 'utf-8' END AS charset, md5(html) AS text_md5 FROM pages",
)
def decode_charset(spark, sf_dir):
    p = F.col("page_id")
    df = table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(p % 3 == 0, "text/html; charset=\"UTF-16\"").when(p % 3 == 1, "text/html").otherwise("text/html;Charset=utf-8").alias("content_type"),
        F.when(p % 3 == 0, F.encode("html", "UTF-16")).otherwise(F.encode("html", "UTF-8")).alias("body"),
    )
    df = df.withColumn("charset", CH.detect_charset(F.col("content_type"), F.col("body")))
    return df.select("page_id", "charset", F.md5(F.encode(CH.decode_bytes("body", "charset"), "UTF-8")).alias("text_md5"))
