"""Queries over sites: robots, sitemaps, bundles, JSON-LD signals, lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import jsonld as J
from tellback.functions import text as T
from tellback.operators import pages as P
from tellback.operators import sites as S
from tellback.plans import osql as O
from tellback.plans import pages as PP
from tellback.plans.fixtures import view
from tellback.plans.registry import query
from tellback.sources import sinks as K
from tellback.sources import sitemaps as SM

# --- robots -------------------------------------------------------------------
_LINES = f"""SELECT host, g, pos, lower(trim(split_part(line, ':', 1))) AS field, {O.strip(O.sub('line', '^[^:]*:'))} AS value
  FROM (SELECT host, g, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (
    SELECT host, g, list_filter(list_transform(string_split(grp, chr(10)), lambda s: {O.strip('s')}), lambda s: contains(s, ':') AND s NOT LIKE '#%') AS ls
    FROM (SELECT host, unnest(gs) AS grp, generate_subscripts(gs, 1) AS g FROM (SELECT host, string_split_regex(body, '\\n\\s*\\n') AS gs FROM fv_robots) a) b) c) d"""
ROBOT_CTES = [
    f"rl AS MATERIALIZED ({_LINES})",
    """rules AS MATERIALIZED (SELECT host, value AS agent, 'user-agent' AS directive, '' AS path FROM rl WHERE field = 'user-agent'
   UNION ALL SELECT a.host, a.value, d.field, d.value FROM rl a JOIN rl d ON a.host = d.host AND a.g = d.g AND a.pos < d.pos
   WHERE a.field = 'user-agent' AND d.field IN ('allow', 'disallow') AND d.value <> '')""",
]
_BOTS = ", ".join(f"('{b}')" for b in dims.AI_BOTS)
ACCESS_CTES = ROBOT_CTES + [
    """agent_state AS MATERIALIZED (SELECT host, agent, CASE WHEN bool_or(directive = 'disallow' AND path IN ('/', '/*')) AND NOT bool_or(directive = 'allow' AND path IN ('/', '/*')) THEN 'disallow' ELSE 'allow' END AS state FROM rules GROUP BY host, agent)""",
    f"""access AS MATERIALIZED (SELECT h.host, b.bot, coalesce(o.state, w.state, 'unknown') AS access FROM fv_hosts h CROSS JOIN (VALUES {_BOTS}) AS b(bot)
   LEFT JOIN agent_state o ON o.host = h.host AND o.agent = b.bot LEFT JOIN agent_state w ON w.host = h.host AND w.agent = '*')""",
    """botsum AS MATERIALIZED (SELECT host, CAST(count_if(access = 'allow') AS BIGINT) AS bots_allowed, CAST(count_if(access = 'disallow') AS BIGINT) AS bots_denied, CAST(count_if(access = 'unknown') AS BIGINT) AS bots_unknown FROM access GROUP BY host)""",
]


@query("robots_rules", ["fv_robots"], "SELECT host, agent, directive, path FROM rules", ROBOT_CTES)
def robots_rules(spark, sf_dir):
    return S.robots_rules(view(spark, sf_dir, "fv_robots"))


def access(spark, sf_dir):
    hosts = view(spark, sf_dir, "fv_hosts").select("host")
    return S.bot_access(hosts, S.robots_rules(view(spark, sf_dir, "fv_robots")))


@query("bot_access", ["fv_hosts", "fv_robots"], "SELECT host, bot, access FROM access", ACCESS_CTES)
def bot_access(spark, sf_dir):
    return access(spark, sf_dir)


@query(
    "llms_txt",
    ["fv_llms"],
    f"SELECT host, length({O.strip('body')}) >= 20 AS llms_exists, length(body) AS llms_chars FROM fv_llms",
)
def llms_txt(spark, sf_dir):
    return S.llms_txt(view(spark, sf_dir, "fv_llms"))


# --- sitemaps -------------------------------------------------------------------
MAP_CTES = [
    """declared AS MATERIALIZED (SELECT host, u AS sitemap_url, pos FROM (SELECT host, pos, CASE WHEN value LIKE '/%' THEN 'https://' || host || value ELSE value END AS u FROM rl WHERE field = 'sitemap' AND value <> '') t)""",
    """picked AS MATERIALIZED (SELECT f.host, arg_min(f.sitemap_url, (c.d, c.pos)) AS sitemap_url FROM fv_maps f JOIN (
   SELECT host, sitemap_url, 0 AS d, pos FROM declared UNION ALL SELECT DISTINCT host, 'https://' || host || '/sitemap.xml', 1, 0 FROM fv_maps) c ON c.host = f.host AND c.sitemap_url = f.sitemap_url GROUP BY f.host)""",
    "map_lines AS MATERIALIZED (SELECT * FROM fv_sitemap_lines)",
    """mapstats AS MATERIALIZED (SELECT host, sitemap_url, url_count, sitemap_count, loc_count, url_count + sitemap_count + loc_count > 0 AS sitemap_exists,
   CASE WHEN sitemap_count > 0 THEN 'index' WHEN url_count > 0 THEN 'urlset' ELSE 'unknown' END AS sitemap_format FROM (
   SELECT p.host, p.sitemap_url, count(*) FILTER (l.line LIKE '<url>%') AS url_count, count(*) FILTER (l.line LIKE '<sitemap>%') AS sitemap_count, count(*) FILTER (l.line LIKE '%<loc>%') AS loc_count
   FROM picked p JOIN map_lines l ON l.sitemap_url = p.sitemap_url GROUP BY p.host, p.sitemap_url) t)""",
]
_ENTRY = f"{O.strip(O.decode_basic('regexp_extract(l.line, ' + chr(39) + '<loc>(.*)</loc>' + chr(39) + ', 1)'))}"
LOC_CTES = [
    f"leads AS (SELECT host, sitemap_url FROM picked UNION SELECT r.host, {_ENTRY} FROM leads r JOIN map_lines l ON l.sitemap_url = r.sitemap_url AND l.line LIKE '<sitemap>%')",
    f"locs AS MATERIALIZED (SELECT r.host, {_ENTRY} AS loc FROM leads r JOIN map_lines l ON l.sitemap_url = r.sitemap_url AND l.line LIKE '<url>%')",
]


def sitemaps(spark, sf_dir):
    """Sites with their sitemaps, the entries of the files, and what is picked. Two of four partial maps are gzipped."""
    out = K.shared_folder(spark, "sitemaps")
    lines = K.store(view(spark, sf_dir, "fv_sitemap_lines"), "lines")
    SM.write_sitemaps(lines.filter("part < 2"), out)
    SM.write_sitemaps(lines.filter("part >= 2"), out, zipped=True)
    files = view(spark, sf_dir, "fv_maps").select("host", "sitemap_url")
    entries = K.store(SM.sitemap_entries(spark, out), "entries")
    return files, entries, S.pick_sitemap(files, S.robots_sitemaps(view(spark, sf_dir, "fv_robots")))


@query(
    "sitemap_stats",
    ["fv_robots", "fv_sitemap_lines"],
    "SELECT host, sitemap_url, sitemap_exists, sitemap_format, url_count, sitemap_count, loc_count FROM mapstats",
    ROBOT_CTES + MAP_CTES,
)
def sitemap_stats(spark, sf_dir):
    _, entries, picked = sitemaps(spark, sf_dir)
    return S.sitemap_stats(picked, entries).select(
        "host", "sitemap_url", "sitemap_exists", "sitemap_format", "url_count", "sitemap_count", "loc_count"
    )


_CMP_PATH = lambda x: f"(CASE WHEN {O.trimmed_path(x)} = '' THEN '/' ELSE {O.trimmed_path(x)} END)"


@query(
    "sitemap_membership",
    ["fv_robots", "fv_sitemap_lines", "fv_rich"],
    f"""SELECT p.page_id, bool_or(coalesce({O.comparable_url('l.loc')} = {O.comparable_url('p.url')}, false)) AS lists_url,
   bool_or(coalesce({_CMP_PATH('l.loc')} = {_CMP_PATH('p.url')}, false)) AS lists_path
 FROM fv_rich p LEFT JOIN locs l ON l.host = p.host GROUP BY p.page_id""",
    ROBOT_CTES + MAP_CTES + LOC_CTES,
)
def sitemap_membership(spark, sf_dir):
    pages = view(spark, sf_dir, "fv_rich").select("page_id", "url", "host")
    _, entries, picked = sitemaps(spark, sf_dir)
    return S.sitemap_membership(pages, S.sitemap_locs(entries, picked)).select("page_id", "lists_url", "lists_path")


@query(
    "sitemap_locs",
    ["fv_robots", "fv_sitemap_lines"],
    "SELECT host, loc, count(*) AS times FROM locs GROUP BY host, loc",
    ROBOT_CTES + MAP_CTES + LOC_CTES,
)
def sitemap_locs(spark, sf_dir):
    """All pages that a site's sitemap lists, over indexes that lead to indexes and back."""
    _, entries, picked = sitemaps(spark, sf_dir)
    return S.sitemap_locs(entries, picked).groupBy("host", "loc").agg(F.count("*").alias("times"))


@query(
    "discovery_summary",
    ["fv_hosts", "fv_robots", "fv_sitemap_lines", "fv_llms"],
    f"""SELECT b.host, bots_allowed, bots_denied, bots_unknown, coalesce(length({O.strip('l.body')}) >= 20, false) AS llms_exists, coalesce(length(l.body), 0) AS llms_chars,
  coalesce(m.sitemap_exists, false) AS sitemap_exists, coalesce(m.sitemap_format, 'unknown') AS sitemap_format, coalesce(m.url_count, 0) AS sitemap_urls
 FROM botsum b LEFT JOIN fv_llms l ON l.host = b.host LEFT JOIN mapstats m ON m.host = b.host""",
    ACCESS_CTES + MAP_CTES,
)
def discovery_summary(spark, sf_dir):
    files, entries, _ = sitemaps(spark, sf_dir)
    hosts, robots, llms = (view(spark, sf_dir, f"fv_{name}") for name in ("hosts", "robots", "llms"))
    return S.discovery_summary(hosts, robots, llms, files, entries=entries)


# --- JSON-LD ---------------------------------------------------------------------
LD_CTES = [
    "ldb AS MATERIALIZED (SELECT page_id, bno, b::JSON AS j FROM (SELECT page_id, unnest(jsonld_blocks) AS b, generate_subscripts(jsonld_blocks, 1) AS bno FROM sig) t WHERE json_valid(b))",
    """ldd AS MATERIALIZED (SELECT page_id, bno, 0 AS pos, j AS doc FROM ldb UNION ALL
   SELECT page_id, bno, pos, doc FROM (SELECT page_id, bno, unnest(g) AS doc, generate_subscripts(g, 1) AS pos FROM (SELECT page_id, bno, json_extract(j, '$."@graph"[*]') AS g FROM ldb) a) b)""",
    """ldt AS MATERIALIZED (SELECT page_id, bno, pos, doc, CASE json_type(doc, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(doc, '$."@type"[*]')
   WHEN 'VARCHAR' THEN [json_extract_string(doc, '$."@type"')] ELSE []::VARCHAR[] END AS types FROM ldd)""",
]
_N = lambda p: f"CASE json_type(doc, '$.{p}') WHEN 'ARRAY' THEN json_array_length(doc, '$.{p}') WHEN 'NULL' THEN 0 ELSE CASE WHEN json_exists(doc, '$.{p}') THEN 1 ELSE 0 END END"
_FACTS = " + ".join(
    f"(CASE WHEN coalesce(json_extract_string(doc, '$.{k}'), '') NOT IN ('', 'null') THEN 1 ELSE 0 END)" for k in dims.JSONLD_FACT_KEYS
)
LD_SIGNALS = f"""lds AS MATERIALIZED (SELECT s.page_id, coalesce(a.faq_count, 0) AS faq_count, coalesce(a.has_part_count, 0) AS has_part_count, coalesce(a.significant_link_count, 0) AS significant_link_count,
   coalesce(a.same_as_count, 0) AS same_as_count, coalesce(a.fact_field_count, 0) AS fact_field_count, coalesce(t.types, '') AS types FROM sig s
  LEFT JOIN (SELECT page_id, CAST(sum(len(list_filter(types, lambda t: t = 'FAQPage'))) AS BIGINT) AS faq_count, CAST(sum({_N('hasPart')}) AS BIGINT) AS has_part_count,
     CAST(sum({_N('significantLink')}) AS BIGINT) AS significant_link_count, CAST(sum({_N('sameAs')}) AS BIGINT) AS same_as_count, CAST(sum({_FACTS}) AS BIGINT) AS fact_field_count FROM ldt GROUP BY page_id) a USING (page_id)
  LEFT JOIN (SELECT page_id, string_agg(t, ' | ' ORDER BY t) AS types FROM (SELECT DISTINCT page_id, unnest(types) AS t FROM ldt) q GROUP BY page_id) t USING (page_id))"""


@query(
    "jsonld_documents",
    ["fv_rich"],
    """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY bno, pos) AS BIGINT) AS doc_no, array_to_string(types, ' | ') AS types, coalesce(json_extract_string(doc, '$.name'), '') AS name FROM ldt WHERE pos > 0""",
    PP.SIG[:3] + LD_CTES,
)
def jsonld_documents(spark, sf_dir):
    docs = PP.signals(spark, sf_dir).select(
        "page_id", F.posexplode(J.graph_or_self(F.col("jsonld_blocks"))).alias("pos", "doc")
    )
    return docs.select(
        "page_id",
        (F.col("pos") + 1).cast("bigint").alias("doc_no"),
        J.types(F.col("doc")).alias("types"),
        F.coalesce(J.text(F.col("doc"), "$.name"), F.lit("")).alias("name"),
    )


@query(
    "jsonld_signals",
    ["fv_rich"],
    "SELECT page_id, types, faq_count, has_part_count, significant_link_count, same_as_count, fact_field_count FROM lds",
    PP.SIG[:3] + LD_CTES + [LD_SIGNALS],
)
def jsonld_signals(spark, sf_dir):
    return S.with_jsonld(PP.signals(spark, sf_dir)).select("page_id", "ld.*")


# --- facts labels, FAQ, registry --------------------------------------------------
def _label_sql(content: str) -> str:
    bullet = O.get("l", "^[-*]\\s*([^:]{1,30}?)\\s*:\\s*[^\\s].+$")
    plain = O.get("l", "^([^:#]{1,30}?)\\s*:\\s*[^\\s].+$")
    lab = O.squeeze(f"CASE WHEN regexp_matches(l, '^[-*]') AND {bullet} <> '' THEN {bullet} ELSE {plain} END")
    return O.uniq(
        f"list_transform(list_transform(string_split_regex({content}, '\\n+'), lambda s: {O.strip('s')}), lambda l: {lab})"
    )


@query("facts_labels", ["fv_facts"], f"SELECT page_id, {O.joined(_label_sql('content'))} AS labels FROM fv_facts")
def facts_labels(spark, sf_dir):
    return view(spark, sf_dir, "fv_facts").select("page_id", S.facts_labels(F.col("content")).alias("labels"))


_Q = r"(?im)(?:^|\n)\s*(?:q[.:]|q\s|- q[:.]|질문[:.]|문:)\s+"
_A = r"(?im)(?:^|\n)\s*(?:a[.:]|a\s|- a[:.]|답변[:.]|답:)\s+"


@query(
    "faq_structure",
    ["fv_rich", "fv_facts"],
    f"""SELECT s.page_id, len(list_filter(list_concat(h1_texts, h2_texts), lambda h: regexp_matches(h, '(?i)faq|자주 묻는 질문'))) > 0 AS faq_heading,
 {O.has('f.content', _Q)} AND {O.has('f.content', _A)} AS faq_lines, l.faq_count > 0 AS faq_jsonld FROM sig s JOIN fv_facts f USING (page_id) JOIN lds l USING (page_id)""",
    PP.SIG[:3] + LD_CTES + [LD_SIGNALS],
)
def faq_structure(spark, sf_dir):
    lines = view(spark, sf_dir, "fv_facts").select("page_id", "content")
    df = S.with_jsonld(PP.signals(spark, sf_dir)).drop("content").join(lines, "page_id")
    return S.faq_structure(df).select("page_id", "faq_heading", "faq_lines", "faq_jsonld")


_HELPFUL = f"len(list_filter(links, lambda u: lower({O.path('u')}) <> '/' AND len(string_split({O.path('u')}, '/')) <= 4))"
_CUE = "(?i)(주요 페이지|핵심 페이지|related pages|important pages|subpages?)"


@query(
    "subpage_registry",
    ["fv_rich"],
    f"SELECT page_id, {_HELPFUL} AS helpful_links, {O.has('content', _CUE)} AS subpage_heading, has_part_count, significant_link_count FROM sig JOIN lds USING (page_id)",
    PP.SIG[:3] + LD_CTES + [LD_SIGNALS],
)
def subpage_registry(spark, sf_dir):
    return S.subpage_registry(S.with_jsonld(PP.signals(spark, sf_dir))).select(
        "page_id", "helpful_links", "subpage_heading", "ld.has_part_count", "ld.significant_link_count"
    )


# --- lint ----------------------------------------------------------------------
LINT_CTES = (
    PP.SIG[:3]
    + [PP.INDEX_CTE, PP.defines_cte("sig", "def")]
    + LD_CTES
    + [LD_SIGNALS]
    + ACCESS_CTES
    + [
        f"""li AS MATERIALIZED (SELECT d.page_id, d.url, d.host, d.title, d.description, d.content, d.page_source, d.defines_entity, {_HELPFUL} AS helpful_links, len({_label_sql('d.content')}) AS fact_labels,
   len(list_filter(list_concat(d.h1_texts, d.h2_texts), lambda h: regexp_matches(h, '(?i)faq|자주 묻는 질문'))) > 0 OR ({O.has('d.content', _Q)} AND {O.has('d.content', _A)}) OR l.faq_count > 0 AS faq_any,
   l.fact_field_count, l.has_part_count, l.significant_link_count, i.allows_indexing, coalesce(b.bots_denied, 0) AS bots_denied,
   regexp_matches(d.url, '(?i)/ai-profile(/|$)?') OR regexp_matches(d.title || ' ' || d.description, '(?i)ai profile') AS profile
  FROM def d JOIN idx i USING (page_id) JOIN lds l USING (page_id) LEFT JOIN botsum b ON b.host = d.host)""",
        """lint AS MATERIALIZED (SELECT page_id, 'entity-definition' AS check_id, CASE WHEN defines_entity THEN 'pass' ELSE 'fail' END AS status, NOT defines_entity AS blocking FROM li
  UNION ALL SELECT page_id, 'facts-source-structure', CASE WHEN fact_labels >= 4 OR fact_field_count >= 6 THEN 'pass' WHEN fact_labels >= 2 OR fact_field_count >= 3 THEN 'warn' ELSE 'fail' END, fact_labels < 2 AND fact_field_count < 3 FROM li
  UNION ALL SELECT page_id, 'static-rendering', 'pass', false FROM li
  UNION ALL SELECT page_id, 'subpage-registry', CASE WHEN helpful_links >= 2 AND (has_part_count > 0 OR significant_link_count > 0) THEN 'pass' WHEN profile THEN 'fail' ELSE 'warn' END, profile AND helpful_links < 2 FROM li
  UNION ALL SELECT page_id, 'indexability', CASE WHEN NOT allows_indexing THEN 'fail' WHEN bots_denied > 0 THEN 'warn' ELSE 'pass' END, NOT allows_indexing FROM li
  UNION ALL SELECT page_id, 'faq-structure', 'pass', false FROM li WHERE faq_any)""",
    ]
)


def lint_parts(spark, sf_dir):
    return S.lint_inputs(PP.signals(spark, sf_dir)), S.bot_summary(access(spark, sf_dir))


@query("page_lint", ["fv_rich", "fv_robots"], "SELECT page_id, check_id, status, blocking FROM lint", LINT_CTES)
def page_lint(spark, sf_dir):
    return S.page_lint(*lint_parts(spark, sf_dir)).select("page_id", "check_id", "status", "blocking")


@query(
    "lint_summary",
    ["fv_rich", "fv_robots"],
    "SELECT page_id, count(*) AS total_checks, CAST(count_if(status = 'pass') AS BIGINT) AS pass_count, CAST(count_if(status = 'warn') AS BIGINT) AS warn_count, "
    "CAST(count_if(status = 'fail') AS BIGINT) AS fail_count, CAST(count_if(blocking) AS BIGINT) AS blocking_count, count_if(status = 'fail') = 0 AS ready FROM lint GROUP BY page_id",
    LINT_CTES,
)
def lint_summary(spark, sf_dir):
    return S.lint_summary(S.page_lint(*lint_parts(spark, sf_dir)))


@query(
    "crawl_evidence",
    ["fv_rich", "fv_robots"],
    f"SELECT page_id, bots_denied > 0 AS robots_blocked, page_source = 'rendered' AS js_rendered, page_source NOT IN ('direct', 'rendered') AS no_static_html, {O.words('content')} < 100 AS low_words, fact_labels >= 2 AS has_facts_block, NOT defines_entity AS no_entity_sentence FROM li",
    LINT_CTES,
)
def crawl_evidence(spark, sf_dir):
    return S.crawl_evidence(*lint_parts(spark, sf_dir))


# --- bundles ----------------------------------------------------------------------
@query(
    "site_rollup",
    ["fv_rich"],
    """SELECT host, count(*) AS pages, round(avg(CASE WHEN usable THEN 1.0::DOUBLE ELSE 0 END), 4) AS usable_share, round(avg(words), 2) AS mean_words, round(avg(list_items), 2) AS mean_list_items,
 CAST(sum(images_without_alt) AS BIGINT) AS images_without_alt, bool_or(has_jsonld) AS has_jsonld, max(score) AS best_score FROM usig GROUP BY host""",
    PP.SIG,
)
def site_rollup(spark, sf_dir):
    return S.site_rollup(PP.usable_signals(spark, sf_dir))


_PS = PP._score_sql(f"lower({O.path('url')})")
BUNDLE_CTES = PP.SIG + [
    f"""bundle AS MATERIALIZED (SELECT u.*, 'main' AS role, 0 AS role_pos FROM usig u WHERE page_id = (SELECT min(page_id) FROM usig v WHERE v.host = u.host)
  UNION ALL SELECT u.*, 'extra', rp FROM (SELECT page_id AS pid, row_number() OVER (PARTITION BY host ORDER BY {_PS} DESC, page_id) AS rp FROM usig u
     WHERE usable AND page_id <> (SELECT min(page_id) FROM usig v WHERE v.host = u.host)) k JOIN usig u ON u.page_id = k.pid)""",
    f"""merged AS MATERIALIZED (SELECT host, count(*) AS page_count, arg_min(title, role_pos) AS title, CAST(sum(list_items) AS BIGINT) AS list_items, CAST(sum(tables) AS BIGINT) AS tables, CAST(sum(images) AS BIGINT) AS images,
   CAST(sum(images_without_alt) AS BIGINT) AS images_without_alt, bool_or(has_jsonld) AS has_jsonld, bool_or(has_og) AS has_og,
   flatten(list(h1_texts ORDER BY role_pos)) AS h1_all, flatten(list(h2_texts ORDER BY role_pos)) AS h2_all,
   string_agg(CASE WHEN role = 'main' THEN content ELSE chr(10) || chr(10) || '---' || chr(10) || '[추가 페이지: ' || {O.path('url')} || ']' || chr(10) || content END, '' ORDER BY role_pos) AS content FROM bundle GROUP BY host)""",
    f"""mheads AS MATERIALIZED (SELECT *, {O.words('content')} AS words, {O.uniq('h1_all')} AS h1_u, {O.uniq('h2_all')} AS h2_u FROM merged)""",
    """fresh AS MATERIALIZED (SELECT host, heading, CAST(row_number() OVER (PARTITION BY host ORDER BY role_pos, pos, heading) AS BIGINT) AS rank FROM (
   SELECT host, heading, arg_min(role_pos, (role_pos, pos)) AS role_pos, arg_min(pos, (role_pos, pos)) AS pos FROM (SELECT host, role, role_pos, unnest(hs) AS heading, generate_subscripts(hs, 1) AS pos FROM (SELECT host, role, role_pos, list_concat(h1_texts, h2_texts) AS hs FROM bundle) a) b
    WHERE role = 'extra' GROUP BY host, heading) c WHERE NOT EXISTS (SELECT 1 FROM bundle m WHERE m.role = 'main' AND m.host = c.host AND list_contains(list_concat(m.h1_texts, m.h2_texts), c.heading)))""",
]


def bundle(spark, sf_dir):
    return S.site_pages(PP.usable_signals(spark, sf_dir))


@query(
    "candidate_pages_topk",
    ["fv_rich"],
    "SELECT host, page_id, role, CAST(role_pos AS BIGINT) AS role_pos FROM bundle",
    BUNDLE_CTES[:-3],
)
def candidate_pages_topk(spark, sf_dir):
    return S.bundle_roles(PP.usable_signals(spark, sf_dir))


@query(
    "site_signal_merge",
    ["fv_rich"],
    f"""SELECT host, page_count, title, list_items, tables, images, images_without_alt, has_jsonld, has_og, len(h1_u) AS h1_count, len(h2_u) AS h2_count, {O.joined('h1_u')} AS h1_texts, {O.joined('h2_u')} AS h2_texts, words, length(content) AS chars FROM mheads""",
    BUNDLE_CTES[:-1],
)
def site_signal_merge(spark, sf_dir):
    return S.site_signal_merge(bundle(spark, sf_dir), lists=True).select(
        "host", "page_count", "title", "list_items", "tables", "images", "images_without_alt", "has_jsonld", "has_og",
        "h1_count", "h2_count", "h1_texts", "h2_texts", "words", "chars",
    )


@query(
    "site_headings",
    ["fv_rich"],
    """SELECT host, 'h1' AS kind, generate_subscripts(h1_u, 1) AS n, unnest(h1_u) AS heading FROM mheads
  UNION ALL SELECT host, 'h2', generate_subscripts(h2_u, 1), unnest(h2_u) FROM mheads""",
    BUNDLE_CTES[:-1],
)
def site_headings(spark, sf_dir):
    return S.site_headings(bundle(spark, sf_dir))


@query("new_headings", ["fv_rich"], "SELECT host, rank, heading FROM fresh", BUNDLE_CTES)
def new_headings(spark, sf_dir):
    return S.new_headings(bundle(spark, sf_dir))


@query(
    "site_gap",
    ["fv_rich"],
    f"""SELECT m.host, m.page_count - 1 AS extra_pages, greatest(m.words - {O.words('b.content')}, 0) AS added_words, m.page_count > 1 AND greatest(m.words - {O.words('b.content')}, 0) >= 50 AS meaningful,
  NOT b.has_jsonld AND m.has_jsonld AS added_jsonld, NOT b.has_og AND m.has_og AS added_og, coalesce(f.n, 0) AS new_heading_count
 FROM mheads m JOIN bundle b ON b.host = m.host AND b.role = 'main' LEFT JOIN (SELECT host, count(*) AS n FROM fresh GROUP BY host) f ON f.host = m.host""",
    BUNDLE_CTES,
)
def site_gap(spark, sf_dir):
    return S.site_gap(bundle(spark, sf_dir))


_SEP = "chr(1)"
_CUT = f"string_split(regexp_replace(regexp_replace(content, '\\n+', ' ', 'g'), '([.!?。]|다[.]|요[.])\\s+', '\\1' || {_SEP}, 'g'), {_SEP})"


@query(
    "promoted_snippets",
    ["fv_rich"],
    f"""SELECT host, CAST(rank AS BIGINT) AS rank, source_path, sentence FROM (SELECT host, sentence, {O.path('url')} AS source_path, row_number() OVER (PARTITION BY host ORDER BY role_pos, pos) AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM (SELECT host, page_id, url, role_pos, pos, {O.squeeze('raw')} AS sentence FROM (
     SELECT host, page_id, url, role_pos, unnest(cs) AS raw, generate_subscripts(cs, 1) AS pos FROM (SELECT *, {_CUT} AS cs FROM bundle WHERE role = 'extra') a) b) c
    WHERE length(sentence) >= 40 AND sentence NOT LIKE '#%' AND NOT regexp_matches(sentence, '(?i)^[qa][.:]') AND regexp_matches(sentence, '[가-힣A-Za-z]')
      AND regexp_matches(lower(sentence), '{'|'.join(S.SNIPPET_SIGNALS)}')
      AND NOT EXISTS (SELECT 1 FROM bundle m WHERE m.role = 'main' AND m.host = c.host AND contains(lower(m.content), lower(c.sentence)))) d) e""",
    BUNDLE_CTES[:-3],
)
def promoted_snippets(spark, sf_dir):
    return S.promoted_snippets(bundle(spark, sf_dir))


@query(
    "best_rendering",
    ["fv_rich", "fv_rendered"],
    """SELECT coalesce(d.page_id, r.page_id) AS page_id, CASE WHEN d.strong THEN 'direct' WHEN d.score IS NULL THEN 'rendered' WHEN r.score IS NULL THEN 'direct' WHEN d.score >= r.score THEN 'direct' ELSE 'rendered' END AS picked,
  d.score AS direct_score, r.score AS rendered_score FROM (SELECT * FROM usig WHERE page_id % 13 <> 5) d FULL OUTER JOIN (SELECT * FROM umd WHERE page_id % 11 <> 5) r ON r.page_id = d.page_id""",
    PP.SIG + [PP.MD_CTE, PP.usable_cte("md", "umd")],
)
def best_rendering(spark, sf_dir):
    # Some pages were only fetched, some only rendered, so that the outer join has work on both sides.
    direct = PP.usable_signals(spark, sf_dir).filter("page_id % 13 <> 5")
    rendered = P.page_usability(P.markdown_signals(view(spark, sf_dir, "fv_rendered"))).filter("page_id % 11 <> 5")
    return S.best_rendering(direct, rendered)
