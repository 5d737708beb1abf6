"""Queries over entities, answers, citations and task grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellback import dims
from tellback.operators import citations as C
from tellback.operators import recognition as R
from tellback.plans import osql as O
from tellback.plans import texts as PT
from tellback.plans.fixtures import _view, table, view
from tellback.plans.registry import query

B = chr(92)
KEYS = ["entity_id", "engine"]

_view(
    "fv_entities",
    [],
    """
SELECT page_id AS entity_id, 'Org' || n || ' Labs' AS company_name, CASE WHEN page_id % 12 = 7 THEN '' ELSE 'www.Org' || n || '.example.com' END AS domain,
  'Org' || n || ' Labs | Robot Tools' AS title, kinds AS description, 'Org' || n || ' Robotics;O' || n AS aliases_text,
  'Org' || n || ' Home' AS snap_title, 'We build ' || kinds || ' since ' || CAST(1950 + page_id % 70 AS STRING) || '. Write to info@org' || n || '.example.com today.' AS snap_description,
  'Welcome to Org' || n || ' Robotics;Tools' AS h1_text, 'Our industrial products;Team' AS h2_text,
  'Org' || n || ' serves small factories all over Europe.' || chr(10) || 'Short line.' || chr(10) || 'Second shop at shop.org' || n || '.example.net for parts and tools.' AS content_preview
FROM (SELECT page_id, CAST(page_id AS STRING) AS n, CASE page_id % 6 WHEN 0 THEN 'cloud software platform for workflow automation' WHEN 1 THEN 'yoga studio and cafe, a local shop' WHEN 2 THEN 'youtube creator newsletter and podcast'
   WHEN 3 THEN 'developer api and sdk library' WHEN 4 THEN 'plain bricks for walls. More later' ELSE '로봇 소프트웨어 솔루션 서비스' END AS kinds FROM pages) t
""",
)
_view(
    "fv_answers",
    ["fv_entities"],
    """
SELECT x.entity_id, g.engine, g.engine_no, CASE WHEN (x.entity_id + g.engine_no) % 2 = 0 THEN 'live_search' ELSE 'strict_recall' END AS mode,
  CASE (x.entity_id + g.engine_no * 2) % 3 WHEN 0 THEN 'awareness' WHEN 1 THEN 'comparison' ELSE 'purchase' END AS intent,
  CASE WHEN (x.entity_id * 3 + g.engine_no) % 17 = 0 THEN 'skipped' WHEN (x.entity_id * 3 + g.engine_no) % 19 = 0 THEN 'unsupported' ELSE 'success' END AS status,
  CASE (x.entity_id * 5 + g.engine_no) % 9
   WHEN 0 THEN x.company_name || ' runs org' || CAST(x.entity_id AS STRING) || '.example.com and offers ' || x.description || ' as a service. Founded in ' || CAST(1950 + x.entity_id % 70 AS STRING) || '. Contact info@org' || CAST(x.entity_id AS STRING) || '.example.com for pricing.'
   WHEN 1 THEN 'It is an oxide material used in research and coating work. The industry and compound data at materials-lab.org describe pore structure and layer profile in depth. See www.other.net too.'
   WHEN 2 THEN 'Org' || CAST(x.entity_id AS STRING) || ' Robotics is a service platform for brand citation monitoring. All pricing, customer onboarding, demo and records are handled at partnerhub.io and nowhere else, it seems to say.'
   WHEN 3 THEN 'See org' || CAST(x.entity_id AS STRING) || '.example.com: an admissions office of a campus that keeps student records, handles every application and reviews papers for the administration each and every year.'
   WHEN 4 THEN 'I cannot find information about ' || x.company_name || '. It may not exist.'
   WHEN 5 THEN 'Compared with rival.example.org, the company Org' || CAST(x.entity_id AS STRING) || ' Robotics is an alternative. A comparison of products and research shows competitors at rival.example.org doing the same for customers in every industry.'
   WHEN 6 THEN 'Org' || CAST(x.entity_id AS STRING) || ' Robotics is probably a company.'
   WHEN 7 THEN 'Welcome to Org' || CAST(x.entity_id AS STRING) || ' robotics! Our industrial products are known. ' || repeat('Many words of praise follow here. ', 12) || 'Visit shop.org' || CAST(x.entity_id AS STRING) || '.example.net or phone.'
   ELSE 'Nothing much.' END AS text,
  CASE (x.entity_id + g.engine_no * 5) % 7 WHEN 0 THEN '' WHEN 1 THEN 'https://org' || CAST(x.entity_id AS STRING) || '.example.com/a;https://www.g2.com/p;https://techcrunch.com/x;https://docs.vendor.io/y'
   WHEN 2 THEN 'https://www.instagram.com/o;https://www.tiktok.com/@o;https://medium.com/@o/x;https://medium.com/@o/x' WHEN 3 THEN 'https://en.wikipedia.org/wiki/O;https://namu.wiki/w/O;https://news.site.kr/1;https://eu.news.site.com/2'
   WHEN 4 THEN 'https://blog.some.net/1;https://old.reddit.com/r;https://unknown.example.net;bad url' WHEN 5 THEN 'https://shop.org' || CAST(x.entity_id AS STRING) || '.example.com/q' ELSE 'https://www.reuters.com/a;https://www.capterra.com/b;https://github.com/c' END AS citations_text,
  CASE (x.entity_id + g.engine_no) % 4 WHEN 0 THEN '' WHEN 1 THEN 'what is org' || CAST(x.entity_id % 20 AS STRING) ELSE 'org tools;robot tools; org tools' END AS queries_text,
  CASE WHEN x.entity_id % 5 = 0 THEN 0 ELSE 3 END AS planned_queries, (x.entity_id + g.engine_no) % 3 = 0 AS grounded_flag
FROM fv_entities x CROSS JOIN (VALUES ('chatgpt',1),('perplexity',2),('gemini',3)) AS g(engine, engine_no)
""",
)


def entities(spark, sf_dir):
    df = view(spark, sf_dir, "fv_entities")
    return df.withColumns(
        {
            "aliases": F.split("aliases_text", ";"),
            "h1_texts": F.split("h1_text", ";"),
            "h2_texts": F.split("h2_text", ";"),
            "jsonld_blocks": F.array().cast("array<string>"),
        }
    )


def hinted(spark, sf_dir):
    return C.source_archetype(R.verification_hints(R.entity_hints(entities(spark, sf_dir))))


def cited(spark, sf_dir):
    df = view(spark, sf_dir, "fv_answers")
    split = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
    df = df.withColumns(
        {
            "citations": split("citations_text"),
            "search_queries": split("queries_text"),
            "tool_calls": F.when(F.col("grounded_flag"), 1),
            "search_results": F.lit(None).cast("bigint"),
        }
    )
    return df


def measured(spark, sf_dir):
    """Answers with citation metrics and source profile, joined to their entity."""
    return _measure(cited(spark, sf_dir).join(hinted(spark, sf_dir), "entity_id"))


def _measure(df):
    df = C.source_profile(C.citation_metrics(C.citation_details(df)))
    return df.withColumn(
        "grounded", (F.col("citations_total") > 0) | (F.size("search_queries") > 0) | F.col("tool_calls").isNotNull()
    )


def judged(spark, sf_dir):
    """Answers joined to their hinted entity once, then measured and judged in the same pass."""
    return R.judge(C.query_coverage(measured(spark, sf_dir)))


# --- entity hints ------------------------------------------------------------------
_STOP = "[" + ", ".join(O.lit(w) for w in dims.STOP_WORDS) + "]"
_GENERIC = "[" + ", ".join(O.lit(w) for w in dims.GENERIC_TERMS) + "]"
_SPLIT = "'[\\s,.:;()\\-—/|]+'"


def _service(raw: str) -> str:
    return f"({O.uniq(f'string_split_regex(lower({raw}), {_SPLIT})', f'length(v) >= 4 AND NOT list_contains({_STOP}, v) AND regexp_matches(v, {O.lit('[a-z가-힣]')})')})"


_DISTINCT_TEXTS = "list_concat([title, description, snap_title, snap_description], h1s, h2s, [content_preview])"
_PHRASES = (
    "("
    + O.uniq(
        "list_filter(list_transform(flatten(list_transform(list_concat([snap_description], h1s, h2s, [content_preview]), lambda v: string_split(regexp_replace(v, '([.!?。])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)))), lambda p: "
        + O.squeeze("p")
        + "), lambda p: length(p) >= 16 AND regexp_matches(p, '(?i)[a-z가-힣0-9]'))"
    )
    + ")"
)
_HOST_IN = lambda col: PT.HOSTS_SQL.replace("text", col)
_EMAIL = lambda col: f"list_distinct(list_transform({O.every(col, '(?i)' + B + 'b[A-Z0-9._%+-]+@[A-Z0-9.-]+' + B + '.[A-Z]{2,}' + B + 'b')}, lambda e: lower(e)))"
_ARCH = ", ".join(
    f"{{'h': len(list_filter([{', '.join(O.lit(w) for w in ws)}], lambda w: contains(lower(archetype_text), w))), 'o': {-i}, 'n': '{name}'}}"
    for i, (name, ws) in enumerate(dims.ARCHETYPE_WORDS.items())
)
HINT_CTES = [
    """en0 AS MATERIALIZED (SELECT *, regexp_replace(domain, '^www[.]', '') AS root, split_part(regexp_replace(domain, '^www[.]', ''), '.', 1) AS root_label, split(aliases_text, ';') AS aliases, split(h1_text, ';') AS h1s, split(h2_text, ';') AS h2s,
   company_name || ' ' || title || ' ' || description || ' ' || replace(aliases_text, ';', ' ') AS raw FROM fv_entities)""",
    f"""en1 AS MATERIALIZED (SELECT *, lower(root) AS official_domain, {_service('raw')} AS service_hints,
   flatten(list_transform(list_concat([company_name, title], aliases, [root, root_label]), lambda v: list_transform(string_split_regex(lower(v), '[|()\\-—,:/]+'), lambda p: {O.strip('p')}))) AS parts,
   {_service("raw || ' ' || snap_title || ' ' || snap_description || ' ' || replace(h1_text, ';', ' ') || ' ' || replace(h2_text, ';', ' ')")} AS wide0,
   company_name || ' ' || title || ' ' || snap_title || ' ' || description || ' ' || snap_description || ' ' || replace(h1_text, ';', ' ') || ' ' || replace(h2_text, ';', ' ') || ' ' || replace(aliases_text, ';', ' ') AS wide_raw,
   array_to_string({O.uniq(_DISTINCT_TEXTS)}, ' ') AS said, {_PHRASES} AS known_phrases FROM en0)""",
    f"""en2 AS MATERIALIZED (SELECT *, {O.uniq('parts', "v <> '' AND (length(v) >= 6 OR v = lower(root_label))")} AS strong_hints, {_service('wide_raw')} AS wide FROM en1)""",
    f"""en3 AS MATERIALIZED (SELECT *, list_transform(list_concat([company_name, title], aliases, [official_domain, lower(root_label)], strong_hints), lambda v: lower({O.strip('v')})) AS anch, list_filter(list_transform(list_concat([company_name, domain], aliases), lambda v: lower(v)), lambda v: length(v) >= 6) AS exact_signals,
   raw || ' ' || array_to_string(service_hints, ' ') AS archetype_text FROM en2)""",
    f"""en4 AS MATERIALIZED (SELECT *, {O.uniq('anch', 'length(v) >= 2')} AS anchor_terms FROM en3)""",
    f"""en AS MATERIALIZED (SELECT *, (list_filter(service_hints, lambda h: NOT list_contains(anchor_terms, h) AND NOT list_contains({_GENERIC}, h))) AS definition_hints,
   CASE WHEN len(service_hints) > 0 THEN array_to_string(service_hints[1:3], ', ') ELSE title END AS category_hint,
   {O.years('said')} AS known_years, {_EMAIL('said')} AS known_emails, list_concat([official_domain], {_HOST_IN('said')}) AS known_hosts, ({O.uniq('list_concat(service_hints, wide)')}) AS known_services,
   list_max([{_ARCH}]) AS arch FROM en4)""",
    "ent AS MATERIALIZED (SELECT *, CASE WHEN arch.h > 0 THEN arch.n ELSE 'general_business' END AS archetype FROM en)",
]


@query(
    "entity_hints",
    ["fv_entities"],
    f"SELECT entity_id, {O.joined('strong_hints')} AS strong_hints, {O.joined('service_hints')} AS service_hints, {O.joined('anchor_terms')} AS anchor_terms, {O.joined('definition_hints')} AS definition_hints, category_hint FROM ent",
    HINT_CTES,
)
def entity_hints(spark, sf_dir):
    return R.entity_hints(entities(spark, sf_dir)).select(
        "entity_id", "strong_hints", "service_hints", "anchor_terms", "definition_hints", "category_hint"
    )


@query("source_archetype", ["fv_entities"], "SELECT entity_id, archetype, arch.h AS archetype_hits FROM ent", HINT_CTES)
def source_archetype(spark, sf_dir):
    return hinted(spark, sf_dir).select("entity_id", "archetype", "archetype_hits")


# --- citations ----------------------------------------------------------------------
_DOM = ", ".join(f"('{d}', '{t}')" for t, ds in dims.SOURCE_DOMAINS.items() for d in ds)
_AUTH = ", ".join(f"('{t}', '{a}', {s}::DOUBLE)" for t, (a, s) in dims.AUTHORITY.items())
_FIT = ", ".join(f"('{a}', '{t}', {w}::DOUBLE)" for a, ws in dims.FIT_WEIGHTS.items() for t, w in ws.items())
_PREC = "list_position(['official', 'docs', 'wiki', 'news', 'directory', 'community', 'social', 'blog', 'unknown'], {t})"
CITE_CTES = HINT_CTES + [
    f"""ci0 AS MATERIALIZED (SELECT a.entity_id, a.engine, c.pos, c.url, {O.bare_host('c.url')} AS host, e.official_domain, e.archetype FROM fv_answers a JOIN ent e USING (entity_id),
   LATERAL (SELECT url, min(pos) AS pos FROM (SELECT unnest(split(a.citations_text, ';')) AS url, generate_subscripts(split(a.citations_text, ';'), 1) AS pos) q WHERE url <> '' GROUP BY url) c)""",
    f"dom(d, t) AS (VALUES {_DOM})",
    f"auth(t, tier, score) AS (VALUES {_AUTH})",
    f"fit(a, t, w) AS (VALUES {_FIT})",
    f"""ci1 AS MATERIALIZED (SELECT c.*, coalesce((SELECT arg_min(t, {_PREC.format(t='t')}) FROM (
    SELECT dom.t FROM dom WHERE c.host = dom.d OR c.host LIKE '%.' || dom.d UNION ALL SELECT 'official' WHERE c.host <> '' AND c.official_domain <> '' AND (c.host = c.official_domain OR c.host LIKE '%.' || c.official_domain)
    UNION ALL SELECT 'docs' WHERE regexp_matches(c.host, '^(docs|developer|developers|support|help|kb|knowledgebase)[.]') UNION ALL SELECT 'news' WHERE regexp_matches(c.host, '^(news|press)[.]|[.]news[.]') UNION ALL SELECT 'blog' WHERE c.host LIKE 'blog.%') k), 'unknown') AS type FROM ci0 c)""",
    """ci AS MATERIALIZED (SELECT c.*, CASE WHEN c.type = 'wiki' AND regexp_matches(c.host, '(^|[.])(fandom[.]com|namu[.]wiki)$') THEN 'medium' ELSE a.tier END AS tier, CASE WHEN c.type = 'wiki' AND regexp_matches(c.host, '(^|[.])(fandom[.]com|namu[.]wiki)$') THEN 0.62::DOUBLE ELSE a.score END AS score,
   coalesce(f.w, g.w) AS fit FROM ci1 c JOIN auth a ON a.t = c.type LEFT JOIN fit f ON f.a = c.archetype AND f.t = c.type JOIN fit g ON g.a = c.archetype AND g.t = 'default')""",
    """pr0 AS MATERIALIZED (SELECT a.*, coalesce(m.n, 0) AS citations_total, coalesce(m.o, 0) AS citations_official, m.* EXCLUDE (entity_id, engine) FROM fv_answers a LEFT JOIN (
    SELECT entity_id, engine, count(*) AS n, CAST(count_if(type = 'official') AS BIGINT) AS o, CAST(count_if(tier = 'high') AS BIGINT) AS th, CAST(count_if(tier = 'medium') AS BIGINT) AS tm, CAST(count_if(tier = 'low') AS BIGINT) AS tl,
     round(round(sum(score) / count(*), 9), 4) AS authority_average, round(round(sum(fit) / count(*), 9), 4) AS fit_average, round(round(sum(fit * score) / count(*), 9), 4) AS quality_average, CAST(count_if(fit >= 0.7) AS BIGINT) AS ex, CAST(count_if(fit < 0.45) AS BIGINT) AS offp FROM ci GROUP BY ALL) m USING (entity_id, engine))""",
    """pr AS MATERIALIZED (SELECT p.* , e.archetype, coalesce(d.type, 'none') AS dominant_type, CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN th >= tm AND th >= tl AND th > 0 THEN 'high' WHEN tm >= tl AND tm > 0 THEN 'medium' WHEN tl > 0 THEN 'low' ELSE 'none' END AS dominant_tier,
   CASE WHEN coalesce(n, 0) = 0 THEN 'none' WHEN o = 0 AND e.archetype IN ('software_service', 'developer_tool', 'general_business') AND fit_average >= 0.55 THEN 'official_gap' WHEN fit_average >= 0.72 AND ex::DOUBLE / n >= 0.5 THEN 'strong' WHEN offp::DOUBLE / n >= 0.5 OR fit_average < 0.45 THEN 'off_pattern' ELSE 'mixed' END AS fit_status,
   CASE WHEN citations_total = 0 THEN 'none' WHEN citations_official = citations_total THEN 'official_only' WHEN citations_official = 0 THEN 'third_party_only' ELSE 'mixed' END AS source_mix
  FROM pr0 p JOIN ent e USING (entity_id) LEFT JOIN (SELECT entity_id, engine, type FROM (SELECT entity_id, engine, type, row_number() OVER (PARTITION BY entity_id, engine ORDER BY count(*) DESC, min(pos)) AS rn FROM ci GROUP BY entity_id, engine, type) q WHERE rn = 1) d USING (entity_id, engine))""",
]


@query(
    "citation_source_join",
    ["fv_entities", "fv_answers"],
    "SELECT entity_id, engine, url, host, type, tier, score FROM ci",
    CITE_CTES[:-2],
)
def citation_source_join(spark, sf_dir):
    own = R.entity_hints(entities(spark, sf_dir)).select("entity_id", "official_domain")
    df = C.citation_details(cited(spark, sf_dir).join(own, "entity_id"))
    return df.select("entity_id", "engine", F.explode("details").alias("d")).select(
        "entity_id", "engine", "d.url", "d.s.host", "d.s.type", "d.s.tier", "d.s.score"
    )


@query(
    "archetype_weight_join",
    ["fv_entities", "fv_answers"],
    "SELECT entity_id, engine, url, archetype, type, fit FROM ci",
    CITE_CTES[:-2],
)
def archetype_weight_join(spark, sf_dir):
    own = hinted(spark, sf_dir).select("entity_id", "official_domain", "archetype")
    df = C.citation_details(cited(spark, sf_dir).join(own, "entity_id"))
    out = df.select("entity_id", "engine", "archetype", F.explode("details").alias("d"))
    return out.select(
        "entity_id", "engine", "d.url", "archetype", "d.s.type",
        C.fit_weight(F.col("archetype"), F.col("d.s.type")).alias("fit"),
    )


@query(
    "citation_metrics",
    ["fv_entities", "fv_answers"],
    "SELECT entity_id, engine, citations_total, citations_official, CASE WHEN citations_total > 0 THEN round(citations_official::DOUBLE / citations_total, 4) END AS official_ratio FROM pr",
    CITE_CTES,
)
def citation_metrics(spark, sf_dir):
    return measured(spark, sf_dir).select("entity_id", "engine", "citations_total", "citations_official", "official_ratio")


@query(
    "source_mix",
    ["fv_entities", "fv_answers"],
    "SELECT entity_id, engine, source_mix, CASE WHEN citations_total = 0 THEN 'none' WHEN citations_official >= citations_total - citations_official THEN 'official' ELSE 'third_party' END AS mix_dominant FROM pr",
    CITE_CTES,
)
def source_mix(spark, sf_dir):
    return measured(spark, sf_dir).select("entity_id", "engine", "source_mix", "mix_dominant")


@query(
    "source_profile",
    ["fv_entities", "fv_answers"],
    "SELECT entity_id, engine, archetype, dominant_type, dominant_tier, coalesce(th, 0) AS tier_high, coalesce(tm, 0) AS tier_medium, coalesce(tl, 0) AS tier_low, authority_average, fit_average, quality_average, coalesce(ex, 0) AS expected_sources, coalesce(offp, 0) AS off_pattern, fit_status FROM pr",
    CITE_CTES,
)
def source_profile(spark, sf_dir):
    return measured(spark, sf_dir).select(
        "entity_id", "engine", "archetype", "dominant_type", "dominant_tier", "tier_high", "tier_medium", "tier_low",
        "authority_average", "fit_average", "quality_average", "expected_sources", "off_pattern", "fit_status",
    )


_OBS = f"len({O.uniq('list_transform(split(queries_text, ' + O.lit(';') + '), lambda q: ' + O.strip('q') + ')')})"
COVER = f"""cov AS MATERIALIZED (SELECT *, observed AS observed_queries, CASE WHEN planned_queries > 0 THEN CASE WHEN observed > 0 THEN round(least(observed::DOUBLE / planned_queries, 1.0), 4) ELSE 0.0::DOUBLE END END AS coverage_ratio,
  CASE WHEN planned_queries = 0 THEN 'none' WHEN observed > 0 AND round(least(observed::DOUBLE / planned_queries, 1.0), 4) >= 0.6 THEN 'strong' WHEN observed > 0 THEN 'partial' WHEN grounded THEN 'opaque' ELSE 'none' END AS coverage_status
 FROM (SELECT *, {_OBS} AS observed, citations_total > 0 OR queries_text <> '' OR grounded_flag AS grounded FROM pr) t)"""


@query(
    "query_coverage",
    ["fv_entities", "fv_answers"],
    "SELECT entity_id, engine, observed_queries, coverage_ratio, coverage_status FROM cov",
    CITE_CTES + [COVER],
)
def query_coverage(spark, sf_dir):
    return C.query_coverage(measured(spark, sf_dir)).select(
        "entity_id", "engine", "observed_queries", "coverage_ratio", "coverage_status"
    )


# --- recognition -----------------------------------------------------------------------
_ANY = lambda t, l: f"(len(list_filter({l}, lambda h: contains({t}, h))) > 0)"
_LIST = lambda xs: "[" + ", ".join(O.lit(x) for x in xs) + "]"
_SENTS = f"(list_filter(list_transform(string_split(regexp_replace(text, '([.!?。]|다[.]|요[.])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {O.strip('s')}), lambda s: s <> ''))"
_CUE = dims.COMPARISON_CUE.replace("(?![A-Za-z0-9_])", B + "b")
RECOG_CTES = CITE_CTES + [
    COVER,
    f"""rc AS MATERIALIZED (SELECT a.*, e.official_domain, e.root_label, e.company_name, e.title, e.aliases, e.strong_hints, e.service_hints, e.anchor_terms, e.definition_hints, e.exact_signals, e.known_years, e.known_emails, e.known_hosts, e.known_phrases, e.known_services, lower(a.text) AS t,
   {_HOST_IN('a.text')} AS hosts, {_SENTS.replace('(text,', '(a.text,')} AS sents FROM cov a JOIN ent e USING (entity_id))""",
    f"""rd AS MATERIALIZED (SELECT *, {_ANY('t', 'strong_hints')} AS strong_match, {_ANY('t', 'exact_signals')} AS exact_match, {_ANY('t', 'service_hints')} AS service_match, {_ANY('t', _LIST(dims.UNKNOWN_SIGNALS))} AS uncertain,
   length(t) >= 120 AND {_ANY('t', _LIST(dims.CLAIM_WORDS))} AS specific_claims, {_ANY('t', _LIST(dims.HEDGED_SIGNALS))} AS hedge0,
   list_filter(hosts, lambda h: NOT (official_domain <> '' AND (h = official_domain OR h LIKE '%.' || official_domain))) AS foreign_hosts,
   len(list_filter(hosts, lambda h: official_domain <> '' AND (h = official_domain OR h LIKE '%.' || official_domain))) > 0 AS said_own,
   list_filter(definition_hints, lambda h: contains(t, h)) AS matched_hints, list_filter(list_concat(anchor_terms, [official_domain]), lambda a: a <> '' AND (contains(a, '.') OR length(a) >= 6)) AS terms,
   intent = 'comparison' AND regexp_matches(t, '{_CUE}') AS compares FROM rc)""",
    """re AS MATERIALIZED (SELECT *, NOT uncertain AND hedge0 AS hedged, said_own OR citations_official > 0 AS domain_signal,
   CASE WHEN len(definition_hints) = 0 THEN NULL WHEN len(matched_hints) = 0 THEN false WHEN len(definition_hints) <= 2 OR len(matched_hints) >= 2 OR len(matched_hints)::DOUBLE / len(definition_hints) >= 0.5 THEN true END AS service_defined,
   len(list_filter(sents, lambda s: len(list_filter(terms, lambda h: contains(lower(s), h))) > 0)) AS anchored_sentences, len(list_filter(sents, lambda s: len(list_filter(foreign_hosts, lambda h: contains(lower(s), h))) > 0)) AS foreign_sentences,
   len(list_filter(terms, lambda h: contains(t, h))) > 0 AS term_hit FROM rd)""",
    "rf AS MATERIALIZED (SELECT *, domain_signal OR exact_match OR term_hit OR anchored_sentences > 0 AS anchored, compares AND (domain_signal OR exact_match OR term_hit OR anchored_sentences > 0) AS comparison_safe FROM re)",
    """rg AS MATERIALIZED (SELECT *, CASE WHEN len(foreign_hosts) > 0 AND NOT anchored AND NOT exact_match AND specific_claims AND (NOT comparison_safe OR (foreign_sentences > 0 AND anchored_sentences = 0)) THEN 'wrong_entity'
    WHEN len(foreign_hosts) > 0 AND anchored AND NOT domain_signal AND specific_claims AND NOT comparison_safe THEN 'domain_mismatch' WHEN coalesce(NOT service_defined, false) AND specific_claims AND NOT uncertain AND NOT compares THEN 'service_mismatch'
    WHEN comparison_safe OR anchored OR coalesce(service_defined, false) THEN 'aligned' ELSE 'weak' END AS verdict FROM rf)""",
    """rh AS MATERIALIZED (SELECT *, CASE WHEN uncertain THEN 'unknown' WHEN verdict IN ('wrong_entity', 'domain_mismatch', 'service_mismatch') THEN 'misidentified' WHEN verdict = 'aligned' AND (comparison_safe OR anchored OR exact_match OR strong_match) THEN 'recognized'
    WHEN (exact_match OR strong_match OR domain_signal) AND (service_match OR coalesce(service_defined, false)) THEN 'recognized' WHEN specific_claims AND NOT exact_match THEN 'misidentified' ELSE 'unknown' END AS match_status FROM rg)""",
    f"""ri AS MATERIALIZED (SELECT *, list_intersect({O.years('text')}, known_years) AS m_years, list_intersect({_EMAIL('text')}, known_emails) AS m_mails, list_intersect(hosts, known_hosts) AS m_hosts, (list_filter(known_phrases, lambda h: contains(t, lower(h)))) AS m_phr, (list_filter(known_services, lambda h: contains(t, lower(h)))) AS m_srv,
   regexp_matches(text, '(?i)(설립|창립|founded)') AS founding, regexp_matches(text, '(?i)(문의|연락|contact|email|e-mail)') AS contact FROM rh)""",
    """rj AS MATERIALIZED (SELECT *, CAST(CASE WHEN match_status = 'misidentified' THEN 0 WHEN match_status = 'unknown' THEN CASE WHEN verdict = 'weak' THEN 10 ELSE 5 END ELSE greatest(20, least(95,
    (CASE WHEN verdict = 'aligned' THEN 25 ELSE 0 END) + (CASE WHEN coalesce(service_defined, false) THEN 20 ELSE 0 END) + (CASE WHEN domain_signal THEN 15 ELSE 0 END) + (CASE WHEN citations_official > 0 THEN 5 ELSE 0 END) + (CASE WHEN anchored THEN 5 ELSE 0 END)
    + (CASE WHEN mode = 'live_search' AND citations_total > 0 THEN 5 ELSE 0 END) + (CASE WHEN len(m_years) > 0 THEN 10 ELSE 0 END) + (CASE WHEN len(m_mails) > 0 THEN 8 ELSE 0 END) + (CASE WHEN len(m_hosts) > 0 THEN 6 ELSE 0 END)
    + (CASE WHEN len(m_phr) >= 2 THEN 10 WHEN len(m_phr) = 1 THEN 5 ELSE 0 END) + (CASE WHEN len(m_srv) >= 2 THEN 8 WHEN len(m_srv) = 1 THEN 4 ELSE 0 END) + (CASE WHEN length(t) > 1000 THEN 5 WHEN length(t) > 300 THEN 3 ELSE 0 END)
    + (CASE WHEN founding AND len(m_years) > 0 THEN 2 WHEN founding THEN -3 ELSE 0 END) + (CASE WHEN contact AND len(m_mails) = 0 AND len(m_hosts) = 0 THEN -3 ELSE 0 END))) END AS BIGINT) AS accuracy FROM ri)""",
]


@query(
    "hint_containment",
    ["fv_entities", "fv_answers"],
    f"SELECT entity_id, engine, {PT._sorted('m_years')} AS years, {PT._sorted('m_mails')} AS emails, {PT._sorted('m_hosts')} AS hosts, {O.joined('m_phr')} AS phrases, {O.joined('m_srv')} AS services FROM ri",
    RECOG_CTES[:-1],
)
def hint_containment(spark, sf_dir):
    df = cited(spark, sf_dir).join(hinted(spark, sf_dir), "entity_id")
    return R.hint_matches(df).select(
        "entity_id", "engine", F.array_sort("matched_years").alias("years"), F.array_sort("matched_emails").alias("emails"),
        F.array_sort("matched_hosts").alias("hosts"), F.col("matched_phrases").alias("phrases"), F.col("matched_services").alias("services"),
    )


@query(
    "recognition_context",
    ["fv_entities", "fv_answers"],
    "SELECT entity_id, engine, strong_match, exact_match, service_match, uncertain, hedged, specific_claims FROM re",
    RECOG_CTES[: len(CITE_CTES) + 4],
)
def recognition_context(spark, sf_dir):
    df = cited(spark, sf_dir).join(R.entity_hints(entities(spark, sf_dir)), "entity_id")
    return R.recognition_context(df).select(
        "entity_id", "engine", "strong_match", "exact_match", "service_match", "uncertain", "hedged", "specific_claims"
    )


@query(
    "held_hints",
    ["fv_entities", "fv_answers"],
    f"SELECT entity_id, engine, {O.joined('m_phr')} AS phrases, {O.joined('m_srv')} AS services, strong_match, exact_match, service_match FROM ri",
    RECOG_CTES[:-1],
)
def held_hints(spark, sf_dir):
    """The hints of ``hint_containment`` and ``recognition_context`` by one automaton per entity."""
    sites = hinted(spark, sf_dir)
    df = R.held_hints(view(spark, sf_dir, "fv_answers"), sites).join(sites, "entity_id")
    df = R.recognition_context(R.hint_matches(df))
    return df.select("entity_id", "engine", F.col("matched_phrases").alias("phrases"), F.col("matched_services").alias("services"), "strong_match", "exact_match", "service_match")


@query(
    "fact_check",
    ["fv_entities", "fv_answers"],
    f"SELECT entity_id, engine, {PT._sorted('foreign_hosts')} AS foreign_hosts, domain_signal, service_defined, anchored, comparison_safe, anchored_sentences, foreign_sentences, verdict FROM rg",
    RECOG_CTES[: len(CITE_CTES) + 6],
)
def fact_check(spark, sf_dir):
    return judged(spark, sf_dir).select(
        "entity_id", "engine", F.array_sort("foreign_hosts").alias("foreign_hosts"), "domain_signal", "service_defined",
        "anchored", "comparison_safe", "anchored_sentences", "foreign_sentences", "verdict",
    )


@query(
    "recognition_status",
    ["fv_entities", "fv_answers"],
    "SELECT entity_id, engine, match_status FROM rh",
    RECOG_CTES[: len(CITE_CTES) + 7],
)
def recognition_status(spark, sf_dir):
    return judged(spark, sf_dir).select("entity_id", "engine", "match_status")


@query("accuracy_score", ["fv_entities", "fv_answers"], "SELECT entity_id, engine, accuracy FROM rj", RECOG_CTES)
def accuracy_score(spark, sf_dir):
    return judged(spark, sf_dir).select("entity_id", "engine", "accuracy")


_MNAMES = "list_filter(list_transform(list_concat([e.company_name, e.title], e.aliases, [e.root_label]), lambda v: lower(v)), lambda v: length(v) >= 2)"


@query(
    "mention_position",
    ["fv_entities", "fv_answers"],
    f"""SELECT entity_id, engine, mention_ratio, CASE WHEN mention_ratio IS NULL THEN 'none' WHEN mention_ratio <= 0.2 THEN 'top' WHEN mention_ratio <= 0.6 THEN 'middle' ELSE 'bottom' END AS mention_bucket FROM (
  SELECT a.entity_id, a.engine, floor((list_min(list_filter(list_transform({_MNAMES}, lambda n: strpos(lower(a.text), n)), lambda p: p > 0)) - 1)::DOUBLE / length(a.text) * 100 + 0.5) / 100 AS mention_ratio FROM fv_answers a JOIN ent e USING (entity_id)) t""",
    HINT_CTES,
)
def mention_position(spark, sf_dir):
    df = cited(spark, sf_dir).join(R.entity_hints(entities(spark, sf_dir)), "entity_id")
    return R.mention_position(df).select("entity_id", "engine", "mention_ratio", "mention_bucket")


_view(
    "fv_overrides",
    ["fv_answers"],
    """
SELECT entity_id, engine, CASE entity_id % 6 WHEN 0 THEN '{"matchStatus":"recognized","confidence":0.9,"reason":"ok"}' WHEN 1 THEN '{"matchStatus":"misidentified","misidentifiedSubtype":"service_mismatch","confidence":0.6}'
  WHEN 2 THEN '{"matchStatus":"unknown","confidence":0.3}' WHEN 3 THEN 'broken' WHEN 4 THEN '{"matchStatus":"maybe","confidence":1}' ELSE '{"matchStatus":"misidentified","confidence":0.99}' END AS verdict_json
FROM fv_answers WHERE (entity_id + engine_no) % 8 <> 0
""",
)


@query(
    "classifier_override",
    ["fv_entities", "fv_answers", "fv_overrides"],
    """SELECT entity_id, engine, override, CASE WHEN override = 'applied' THEN ai_status ELSE match_status END AS match_status,
  CASE WHEN override = 'applied' THEN CASE ai_status WHEN 'recognized' THEN 'aligned' WHEN 'unknown' THEN 'weak' ELSE CASE WHEN sub = 'none' THEN 'wrong_entity' ELSE sub END END ELSE verdict END AS verdict,
  CASE WHEN override = 'applied' THEN CASE ai_status WHEN 'misidentified' THEN 0 WHEN 'unknown' THEN least(accuracy, 10) ELSE greatest(accuracy, 20) END ELSE accuracy END AS accuracy
 FROM (SELECT *, CASE WHEN NOT (match_status = 'unknown' OR verdict = 'weak' OR (match_status = 'recognized' AND hedged)) THEN 'not_asked' WHEN ai_status IS NULL OR ai_status NOT IN ('recognized', 'unknown', 'misidentified') OR conf IS NULL THEN 'no_verdict' WHEN conf < 0.55 THEN 'low_confidence' ELSE 'applied' END AS override FROM (
  SELECT r.*, json_extract_string(j, '$.matchStatus') AS ai_status, coalesce(json_extract_string(j, '$.misidentifiedSubtype'), 'none') AS sub, CAST(json_extract(j, '$.confidence') AS DOUBLE) AS conf FROM rj r LEFT JOIN (SELECT entity_id, engine, CASE WHEN json_valid(verdict_json) THEN verdict_json::JSON END AS j FROM fv_overrides) o USING (entity_id, engine)) a) b""",
    RECOG_CTES,
)
def classifier_override(spark, sf_dir):
    return R.classifier_override(judged(spark, sf_dir), view(spark, sf_dir, "fv_overrides"), KEYS)


def _dom(tag: str, order: list[str]) -> str:
    items = ", ".join(f"{{'n': {tag}_{v}, 'o': {-i}, 'v': '{v}'}}" for i, v in enumerate(order))
    return f"CASE WHEN (list_max([{items}])).n > 0 THEN (list_max([{items}])).v ELSE 'none' END"


def _cnt(col: str, values: list[str], tag: str) -> str:
    return ", ".join(f"CAST(count_if({col} = '{v}') AS BIGINT) AS {tag}_{v}" for v in values)


SUMMARY_CTES = RECOG_CTES + [
    "sm AS MATERIALIZED (SELECT * FROM rj WHERE status NOT IN ('unsupported', 'skipped'))",
    f"""s1 AS MATERIALIZED (SELECT mode, coalesce(intent, '*') AS intent, count(*) AS supported, CAST(count_if(grounded) AS BIGINT) AS grounded, round(count_if(grounded)::DOUBLE / count(*), 4) AS grounded_coverage, CAST(count_if(citations_official > 0) AS BIGINT) AS with_official, round(count_if(citations_official > 0)::DOUBLE / count(*), 4) AS official_coverage,
   CAST(sum(citations_total) AS BIGINT) AS total_citations, CAST(sum(citations_official) AS BIGINT) AS official_citations, round(sum(citations_official)::DOUBLE / sum(citations_total), 4) AS official_citation_ratio, CAST(count_if(coverage_status IN ('strong', 'partial')) AS BIGINT) AS fan_out_observed, CAST(count_if(coverage_status = 'opaque') AS BIGINT) AS fan_out_opaque,
   round(avg(CASE WHEN coverage_ratio > 0 THEN coverage_ratio END), 4) AS fan_out_average, {_cnt('source_mix', ['official_only', 'mixed', 'third_party_only', 'none'], 'mix')}, {_cnt('fit_status', ['strong', 'official_gap', 'off_pattern', 'mixed', 'none'], 'fit')}, {_cnt('verdict', ['aligned', 'weak', 'domain_mismatch', 'service_mismatch', 'wrong_entity'], 'fact')},
   round(avg(authority_average), 4) AS authority_average, round(avg(fit_average), 4) AS fit_average, CAST(sum(coalesce(th, 0)) AS BIGINT) AS tier_high, CAST(sum(coalesce(tm, 0)) AS BIGINT) AS tier_medium, CAST(sum(coalesce(tl, 0)) AS BIGINT) AS tier_low,
   round(count_if(queries_text <> '')::DOUBLE / count(*), 4) AS query_metadata_coverage, round(count_if(verdict = 'aligned')::DOUBLE / count(*), 4) AS fact_alignment_coverage FROM sm GROUP BY GROUPING SETS ((mode), (mode, intent)))""",
    "s2 AS MATERIALIZED (SELECT mode, coalesce(intent, '*') AS intent, count(DISTINCT q) AS n FROM (SELECT mode, intent, unnest(list_filter(split(queries_text, ';'), lambda q: q <> '')) AS q FROM sm) t GROUP BY GROUPING SETS ((mode), (mode, intent)))",
]


@query(
    "answer_summary",
    ["fv_entities", "fv_answers"],
    f"SELECT s1.*, {_dom('mix', ['official_only', 'mixed', 'third_party_only'])} AS mix_dominant, {_dom('fit', ['strong', 'official_gap', 'off_pattern', 'mixed'])} AS fit_dominant, {_dom('tier', ['high', 'medium', 'low'])} AS tier_dominant, coalesce(s2.n, 0) AS search_query_count FROM s1 LEFT JOIN s2 USING (mode, intent)",
    SUMMARY_CTES,
)
def answer_summary(spark, sf_dir):
    return R.answer_summary(judged(spark, sf_dir))


# --- task grid -------------------------------------------------------------------------
_GRID = ", ".join(
    f"('{m}', '{i}', '{e}', '{'unsupported' if (e, m) in dims.UNSUPPORTED else 'skipped' if e == 'chatgpt' and m == 'strict_recall' else 'candidate'}', {dims.MODE_PRIORITY[(m, i)] + dims.ENGINE_PRIORITY[e]}, {mi * 9 + ii * 3 + ei})"
    for mi, m in enumerate(dims.MODES)
    for ii, i in enumerate(dims.INTENTS)
    for ei, e in enumerate(dims.ENGINE_ORDER)
)
_CACHED = "x.entity_id % 4 = 0 AND g.mode = 'live_search' AND g.intent = 'awareness'"
GRID_CTES = [
    f"grid AS MATERIALIZED (SELECT x.entity_id, g.mode, g.intent, g.engine, CASE WHEN g.kind = 'candidate' AND {_CACHED} THEN 'cached' ELSE g.kind END AS kind, g.priority, g.cell FROM fv_entities x CROSS JOIN (VALUES {_GRID}) AS g(mode, intent, engine, kind, priority, cell))",
    "tasks AS MATERIALIZED (SELECT *, CASE WHEN kind <> 'candidate' THEN kind WHEN row_number() OVER (PARTITION BY entity_id, kind ORDER BY priority DESC, cell) <= 7 THEN 'executed' ELSE 'skipped' END AS status FROM grid)",
]


@query(
    "task_grid",
    ["fv_entities"],
    f"SELECT x.entity_id, g.mode, g.intent, g.engine, g.kind, CAST(g.priority AS BIGINT) AS priority, CAST(g.cell AS BIGINT) AS cell FROM fv_entities x CROSS JOIN (VALUES {_GRID}) AS g(mode, intent, engine, kind, priority, cell)",
)
def task_grid(spark, sf_dir):
    return R.task_grid(view(spark, sf_dir, "fv_entities"))


def tasks(spark, sf_dir):
    known = view(spark, sf_dir, "fv_entities")
    grid = R.task_grid(known)
    cached = grid.filter("entity_id % 4 = 0 and mode = 'live_search' and intent = 'awareness'")
    return R.task_topk(grid, cached)


@query("task_topk", ["fv_entities"], "SELECT entity_id, mode, intent, engine, kind, status FROM tasks", GRID_CTES)
def task_topk(spark, sf_dir):
    return tasks(spark, sf_dir).select("entity_id", "mode", "intent", "engine", "kind", "status")


@query(
    "task_budget",
    ["fv_entities"],
    "SELECT mode, CAST(count_if(kind = 'candidate') AS BIGINT) AS candidates, "
    + ", ".join(f"CAST(count_if(status = '{s}') AS BIGINT) AS {s}" for s in ("executed", "cached", "skipped", "unsupported"))
    + " FROM tasks GROUP BY mode",
    GRID_CTES,
)
def task_budget(spark, sf_dir):
    return R.task_budget(tasks(spark, sf_dir))


def _fill(t: str) -> str:
    out = O.lit(t)
    for mark, col in (("{name}", "nm"), ("{domain}", "official_domain"), ("{category}", "cat"), ("{anchor}", "anc")):
        if mark in t:
            out = f"replace({out}, '{mark}', {col})"
    out = f"CASE WHEN official_domain = '' THEN '' ELSE {out} END" if "{domain}" in t else out
    return O.strip(out)


def _plan_sql(intent: str) -> str:
    rows = [(slot.split("_")[0], t) for slot in dims.INTENT_SLOTS[intent] for t in dims.QUERY_SLOTS[slot]]
    qs = "[" + ", ".join(_fill(t) for _, t in rows) + "]"
    slots = "[" + ", ".join(f"'{s}'" for s, _ in rows) + "]"
    return f"SELECT entity_id, '{intent}' AS intent, unnest({qs}) AS query, unnest({slots}) AS slot, unnest(range(1, {len(rows) + 1})) AS p FROM pl"


@query(
    "query_plan",
    ["fv_entities"],
    "SELECT entity_id, intent, query_no, slot, query FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, intent ORDER BY p) AS query_no FROM (SELECT entity_id, intent, query, arg_min(slot, p) AS slot, min(p) AS p FROM plans WHERE query <> '' GROUP BY ALL) a) b WHERE query_no <= 16",
    HINT_CTES
    + [
        f"pl AS MATERIALIZED (SELECT entity_id, company_name AS nm, official_domain, CASE WHEN len(service_hints) > 0 THEN array_to_string(service_hints[1:3], ' ') ELSE category_hint END AS cat, coalesce(({O.uniq('list_concat([company_name, title, official_domain, lower(root_label)], aliases)')})[2], '') AS anc FROM ent)",
        "plans AS MATERIALIZED (" + " UNION ALL ".join(_plan_sql(i) for i in dims.INTENTS) + ")",
    ],
)
def query_plan(spark, sf_dir):
    return R.query_plan(R.entity_hints(entities(spark, sf_dir)))


@query(
    "prompt_batch",
    [],
    f"""SELECT doc_id, length(b) AS input_chars, length(b) > 2000 AS truncated, ['short', 'long', 'list'][CAST(abs(h) % 3 AS BIGINT) + 1] AS template, md5(CASE WHEN length(b) > 2000 THEN substr(b, 1, 2000) || chr(10) || chr(10) || '[TRUNCATED]' ELSE b END) AS input_md5 FROM (
  SELECT doc_id, {O.strip('text')} AS b, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h FROM documents) t""",
)
def prompt_batch(spark, sf_dir):
    df = R.prompt_batch(table(spark, sf_dir, "documents"), "doc_id", ["short", "long", "list"], most=2000)
    return df.select("doc_id", "input_chars", "truncated", "template", F.md5(F.encode("input", "UTF-8")).alias("input_md5"))
