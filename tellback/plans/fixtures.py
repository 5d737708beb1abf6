"""Views derived from the driver tables, in SQL that reads the same in Spark and DuckDB.

The driver pages carry little markup and no declared facts, so each view adds
some to every page by a fixed rule. Each view grows with the table it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tellback.sources.tables import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

TEXT_TABLES = {"pages", "documents", "conversations"}

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql)


_view(
    "fv_rich",
    [],
    """
SELECT page_id, url, host, lang, org_name, founded, hq, decl,
  replace(replace(replace(html, '</head>', head || '</head>'), '</nav>', nav || '</nav>'),
          '<article>', '<article>' || art) AS html,
  CASE page_id % 9 WHEN 0 THEN 'noindex' WHEN 1 THEN 'all; max-snippet:50' ELSE '' END AS x_robots
FROM (
  SELECT page_id, url, host, lang, org_name, founded, hq, decl, html,
    CASE WHEN page_id % 5 = 0 THEN '<meta name="robots" content="noindex, nofollow">'
         WHEN page_id % 5 = 1 THEN '<meta content="index,follow" name="robots">' ELSE '' END
    || CASE WHEN page_id % 11 = 0 THEN '<meta name="googlebot" content="none">' ELSE '' END
    || CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content="' || org_name || ' builds &quot;robots&quot; &amp; tools.">' ELSE '' END
    || CASE WHEN page_id % 4 = 0 THEN '<meta property="og:title" content="' || org_name || '"><meta property="og:description" content="About ' || org_name || '">' ELSE '' END
    || CASE WHEN page_id % 6 = 5 THEN '' ELSE '<link rel="canonical" href="'
         || CASE WHEN page_id % 7 = 0 THEN 'https://other.example.com/' WHEN page_id % 7 = 1 THEN '/canon/p' ELSE url END || '">' END
    || CASE WHEN page_id % 3 > 0 THEN '<script type="application/ld+json">' || jsonld || '</script>' ELSE '' END
    || CASE WHEN page_id % 13 = 0 THEN '<script type="application/ld+json">{"@type": "Organization", broken</script>' ELSE '' END AS head,
    '<a href="/about-us">About us</a><a class="x" href="service/overview">Our service</a>'
    || '<a href="//' || host || '/company/?utm_source=nav&id=3">Company</a><a href="mailto:hi@mail.example">Mail</a>'
    || '<a href="https://partner.example.org/x">Partner</a><a href="/wiki/Topic_' || n || '"><b>Topic</b> ' || n || '</a>'
    || '<a href="/products/item' || n || '">Item</a><a href="/contact-us#form">Contact</a><a href="?page=9">Next</a>' AS nav,
    CASE WHEN page_id % 3 <> 1 THEN '<table class="infobox vcard"><tr><th scope="row">Founded</th><td>12 May ' || founded
         || '<sup>[1]</sup></td></tr><tr><th>Headquarters</th><td>' || hq || ', Earth</td></tr><tr><th>Products:</th><td>Alpha ' || n
         || ', Beta and Gamma</td></tr><tr><th>Industry</th><td>Robotics &amp; tools</td></tr><tr><td>no key</td></tr></table>' ELSE '' END
    || CASE WHEN page_id % 10 = 0 THEN '<p>' || org_name || '은 대한민국의 로봇 기업이다. 본사는 ' || hq || '에 있다.</p>'
            WHEN page_id % 2 = 0 THEN '<p>' || org_name || ' is a robotics company based in ' || hq || ', Earth. It sells things.</p>'
            ELSE '<p>Short.</p><p>Nothing here defines the entity but the text is long enough &hellip; &#8364;5 &#x41;.</p>' END
    || CASE WHEN page_id % 4 < 2 THEN '<h2>Overview [edit]</h2><h3>Team &amp; staff</h3>' ELSE '' END
    || CASE WHEN page_id % 8 = 0 THEN '<h2>FAQ</h2><h2>History</h2><h2>Overview [edit]</h2>' ELSE '' END
    || '<img src="/a.png" alt="Logo &amp; mark"><img src="/b.png">'
    || CASE WHEN page_id % 6 = 0 THEN '<ol><li id="cite_note-1"><span class="reference-text">Ref</span></li><li id="cite_note-2">Two</li></ol>' ELSE '' END AS art
  FROM (
    SELECT page_id, url, html, split_part(split_part(url, '#', 1), '/', 3) AS host, CAST(page_id AS STRING) AS n,
      CASE WHEN page_id % 10 = 0 THEN 'ko' ELSE 'en' END AS lang,
      'Org' || CAST(page_id AS STRING) || ' Labs' AS org_name,
      CAST(1950 + page_id % 70 AS STRING) AS founded,
      CASE page_id % 4 WHEN 0 THEN 'Seoul' WHEN 1 THEN 'Berlin' WHEN 2 THEN 'Lyon' ELSE 'Madrid' END AS hq,
      CASE WHEN page_id % 3 = 0 THEN 'facts' WHEN page_id % 3 = 1 THEN 'jsonld' ELSE 'both' END AS decl,
      '{"@context":"https://schema.org","@graph":[{"@type":["Organization","Brand"],"name":"Org' || CAST(page_id AS STRING)
        || ' Labs","alternateName":["Org' || CAST(page_id AS STRING) || ' Laboratories","O' || CAST(page_id AS STRING) || '"],"foundingDate":"'
        || CAST(1950 + page_id % 70 AS STRING) || '","founder":' || CASE WHEN page_id % 2 = 0 THEN '{"@type":"Person","name":"Kim ' || CAST(page_id AS STRING) || '"}'
           ELSE '"Lee ' || CAST(page_id AS STRING) || '"' END
        || ',"address":{"addressLocality":"' || CASE page_id % 4 WHEN 0 THEN 'Seoul' WHEN 1 THEN 'Berlin' WHEN 2 THEN 'Lyon' ELSE 'Madrid' END
        || '"},"knowsAbout":["Alpha ' || CAST(page_id AS STRING) || '",{"name":"Beta"}],"sameAs":["https://a.example/1","https://b.example/2"]}'
        || CASE WHEN page_id % 4 = 1 THEN ',{"@type":"WebPage","name":"Page | Site","hasPart":[{"url":"/a"},{"url":"/b"}],"significantLink":"/c","description":"Web page"}' ELSE '' END
        || CASE WHEN page_id % 5 = 2 THEN ',{"@type":"FAQPage","mainEntity":[{"name":"What is it?","acceptedAnswer":{"text":"A robot maker."}},{"name":"Empty?","acceptedAnswer":{"text":""}}]}' ELSE '' END
        || ']}' AS jsonld
    FROM pages
  ) a
) b
""",
)

_view(
    "fv_rendered",
    [],
    """
SELECT page_id, url, split_part(split_part(url, '#', 1), '/', 3) AS host,
  CASE WHEN page_id % 7 = 3 THEN '' ELSE 'Rendered ' || CAST(page_id AS STRING) END AS title,
  '' AS description,
  '# Head ' || CAST(page_id AS STRING) || chr(10) || chr(10) || '## Part one' || chr(10) || '- item a' || chr(10) || '* item b' || chr(10)
    || '### Sub' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10)
    || '![logo](https://x.example/l.png) and ![](https://x.example/m.png)' || chr(10)
    || CASE WHEN page_id % 4 = 0 THEN 'Uses schema.org markup. og:title present.' ELSE 'Plain words only here.' END || chr(10)
    || CASE WHEN page_id % 2 = 0 THEN replace(replace(split_part(html, '<article>', 2), '<p>', ' '), '</p>', ' ') ELSE '' END
    || CASE WHEN page_id % 10 = 7 THEN ' 404 not found' ELSE '' END AS content
FROM pages
""",
)

_view(
    "fv_facts",
    [],
    """
SELECT page_id, url,
  'Intro line without a colon' || chr(10)
  || CASE WHEN page_id % 4 = 0 THEN 'Type: stray' || chr(10) || 'plain line' || chr(10) ELSE '' END
  || '- Name: Org' || CAST(page_id AS STRING) || ' Labs' || chr(10)
  || 'Colour: blue' || chr(10)
  || CASE WHEN page_id % 3 = 0 THEN '' ELSE '설립일: ' || CAST(1950 + page_id % 70 AS STRING) || chr(10) END
  || CASE WHEN page_id % 5 = 0 THEN 'just a line' || chr(10) ELSE '' END
  || 'Headquarters / Site: ' || CASE page_id % 4 WHEN 0 THEN 'Seoul' WHEN 1 THEN 'Berlin' WHEN 2 THEN 'Lyon' ELSE 'Madrid' END || chr(10)
  || CASE WHEN page_id % 2 = 0 THEN 'Location: Second ' || CAST(page_id AS STRING) || chr(10) ELSE '' END
  || '* Key products: Alpha ' || CAST(page_id AS STRING) || ', Beta and Gamma' || chr(10)
  || CASE WHEN page_id % 7 = 0 THEN 'Founded: ' || repeat('x', 41) || chr(10) ELSE '' END
  || 'The end of it' || chr(10) || 'Employees: 5' || chr(10)
  || CASE WHEN page_id % 6 = 0 THEN 'Q. What is it?' || chr(10) || 'A. A robot maker number ' || CAST(page_id AS STRING) || '.' || chr(10)
       || 'Q: Orphan question' || chr(10) || 'no answer' || chr(10) ELSE '' END
  || CASE WHEN page_id % 8 = 0 THEN 'Q. First again' || chr(10) || 'Q. Second' || chr(10) || 'A: Answer two' || chr(10) ELSE '' END AS content
FROM pages
""",
)

_view(
    "fv_inline",
    [],
    """
SELECT page_id,
  CASE WHEN page_id % 3 = 0 THEN 'Some words first. ' ELSE '' END
  || CASE WHEN page_id % 4 < 2 THEN 'Key facts ' ELSE '' END
  || 'Name: Org' || CAST(page_id AS STRING) || ' Labs Founded: ' || CAST(1950 + page_id % 70 AS STRING)
  || ' Headquarters: ' || CASE page_id % 4 WHEN 0 THEN 'Seoul' WHEN 1 THEN 'Berlin' WHEN 2 THEN 'Lyon' ELSE 'Madrid' END
  || CASE WHEN page_id % 5 = 0 THEN ' Name: Later Name' ELSE '' END
  || ' Products: alpha' || CAST(page_id AS STRING) || ', beta'
  || CASE WHEN page_id % 6 = 0 THEN '. ' || repeat('tail words go on and on ', 60) || ' Official facts CEO: Kim Industry: Robots' ELSE '' END AS content
FROM pages
""",
)

_view(
    "fv_hosts",
    [],
    """
SELECT host, min(page_id) AS host_no FROM (SELECT page_id, split_part(split_part(url, '#', 1), '/', 3) AS host FROM pages) h GROUP BY host
""",
)

_view(
    "fv_robots",
    ["fv_hosts"],
    """
SELECT host, host_no, '# robots' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: ' || CASE WHEN host_no % 2 = 0 THEN '/' ELSE '/private' END
  || chr(10) || '# note' || chr(10) || CASE WHEN host_no % 5 = 0 THEN 'Allow: /' || chr(10) ELSE '' END
  || CASE WHEN host_no % 3 = 0 THEN '' ELSE chr(10) END
  || 'User-agent: GPTBot' || chr(10) || 'User-agent:ClaudeBot' || chr(10) || CASE WHEN host_no % 4 = 1 THEN 'Disallow: /*' ELSE 'Allow: /' END || chr(10)
  || 'Disallow:' || chr(10) || 'no colon line' || chr(10) || chr(10) || 'Disallow: /orphan' || chr(10)
  || CASE WHEN host_no % 3 = 1 THEN 'Sitemap: /maps/site.xml' || chr(10) || 'sitemap: https://cdn.example.com/s.xml' || chr(10) ELSE '' END AS body
FROM fv_hosts WHERE host_no % 7 <> 6
""",
)

_view(
    "fv_llms",
    ["fv_hosts"],
    """
SELECT host, CASE host_no % 3 WHEN 0 THEN '# ' || host || ' guide for readers' WHEN 1 THEN '  short  ' ELSE '' END AS body FROM fv_hosts WHERE host_no % 4 <> 3
""",
)

_view(
    "fv_maps",
    ["fv_hosts"],
    """
SELECT h.host, 'https://' || h.host || s.tail AS sitemap_url, CASE WHEN h.host_no % 5 = 4 AND s.pos = 1 THEN 'none' WHEN h.host_no % 3 = 2 THEN 'index' ELSE 'urls' END AS form, -1 AS part
FROM fv_hosts h CROSS JOIN (VALUES ('/maps/site.xml', 1), ('/sitemap.xml', 2)) AS s(tail, pos)
UNION ALL SELECT h.host, 'https://' || h.host || s.tail, s.form, s.part
FROM fv_hosts h CROSS JOIN (VALUES ('/inner.xml', 'inner', -1), ('/map-0.xml', 'part', 0), ('/map-1.xml', 'part', 1), ('/map-2.xml', 'part', 2), ('/map-3.xml', 'part', 3)) AS s(tail, form, part)
WHERE h.host_no % 3 = 2
""",
)

_view(
    "fv_sitemap_lines",
    ["fv_maps"],
    """
SELECT sitemap_url, part, CASE form WHEN 'none' THEN '<html>no map</html>' WHEN 'index' THEN '<sitemapindex>' WHEN 'inner' THEN '<sitemapindex>' ELSE '<?xml version="1.0"?><urlset>' END AS line FROM fv_maps
UNION ALL SELECT m.sitemap_url, m.part, '<sitemap><loc> https://' || m.host || e.tail || ' </loc></sitemap>'
FROM fv_maps m CROSS JOIN (VALUES ('index', '/a.xml'), ('index', '/inner.xml'), ('index', '/map-0.xml'), ('index', '/map-2.xml'), ('inner', '/map-1.xml'), ('inner', '/map-3.xml'), ('inner', '/sitemap.xml')) AS e(holder, tail)
WHERE m.form = e.holder
UNION ALL SELECT m.sitemap_url, m.part, '<url><loc>' || p.loc || '</loc></url>'
FROM fv_maps m JOIN (
   SELECT page_id, host, CASE page_id % 3 WHEN 0 THEN replace(url, '&', '&amp;') WHEN 1 THEN split_part(url, '?', 1) || '/' ELSE 'https://else.example.com/z' END AS loc
   FROM (SELECT page_id, url, split_part(split_part(url, '#', 1), '/', 3) AS host FROM pages) q) p ON p.host = m.host AND (m.form = 'urls' OR m.form = 'part' AND m.part = p.page_id % 4)
""",
)

_view(
    "fv_truth",
    ["fv_rich"],
    """
SELECT r.page_id, f.field,
  CASE f.field WHEN 'entity_name' THEN r.org_name WHEN 'founded' THEN r.founded WHEN 'headquarters' THEN r.hq || ' City'
    WHEN 'key_products' THEN 'Alpha Suite;Beta ' || CAST(r.page_id AS STRING)
    WHEN 'entity_type' THEN 'industrial robotics maker'
    WHEN 'employee_count' THEN CAST(100 + r.page_id % 50 AS STRING) || ' people'
    WHEN 'ceo_or_leader' THEN 'Kim ' || CAST(r.page_id AS STRING)
    ELSE r.org_name || ' builds industrial robots for small factories' END AS value_text,
  CASE WHEN f.field_no % 3 = 0 THEN 'jsonld' ELSE CASE WHEN r.decl = 'jsonld' THEN 'jsonld' ELSE 'official_facts_block' END END AS source,
  CASE WHEN r.decl = 'both' THEN 'official_facts_block;jsonld' WHEN f.field_no % 3 = 0 THEN 'jsonld'
    WHEN r.decl = 'jsonld' THEN 'jsonld' ELSE 'official_facts_block' END AS sources_text,
  f.field_no
FROM fv_rich r CROSS JOIN (VALUES ('entity_name',1),('founded',2),('headquarters',3),('key_products',4),('entity_type',5),
  ('employee_count',6),('ceo_or_leader',7),('description',8)) AS f(field, field_no)
WHERE (r.page_id + f.field_no) % 5 <> 0
""",
)

_view(
    "fv_resp",
    ["fv_rich"],
    """
SELECT r.page_id, r.url, r.host, e.engine, e.engine_no,
  CASE WHEN (r.page_id * 7 + e.engine_no) % 11 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE (r.page_id * 7 + e.engine_no) % 8
    WHEN 0 THEN r.org_name || ' was founded in ' || r.founded || '. Headquarters: ' || r.hq || ' City. It makes Alpha Suite for factories.'
    WHEN 1 THEN r.org_name || ' is a company.'
    WHEN 2 THEN 'entity name: not found' || chr(10) || 'Headquarters: ' || r.hq || ' City' || chr(10) || r.org_name
    WHEN 3 THEN 'It was set up in ' || r.founded || '년에 서울에서 시작.' || chr(10) || 'Industrial robotics maker'
    WHEN 4 THEN 'The headquarters' || chr(10) || 'not found in the page' || chr(10) || r.org_name || ' has ' || CAST(100 + r.page_id % 50 AS STRING) || ' people'
    WHEN 5 THEN 'Known as Org' || CAST(r.page_id AS STRING) || ' Laboratories, led by Kim ' || CAST(r.page_id AS STRING) || '.'
    WHEN 6 THEN r.org_name || ' builds robots for factories, industrial and small. Beta ' || CAST(r.page_id AS STRING)
    ELSE '- **founded**: n/a' || chr(10) || '- **description**: ' || r.org_name || ' builds industrial robots' || chr(10) || 'headquarters' || chr(10) || 'ceo: not found' END AS text,
  CASE (r.page_id + e.engine_no) % 5
    WHEN 0 THEN split_part(r.url, '#', 1) || ';https://en.wikipedia.org/wiki/X'
    WHEN 1 THEN 'https://www.' || r.host || '/about;https://docs.vendor.example/x'
    WHEN 2 THEN 'https://en.wikipedia.org/wiki/X'
    WHEN 3 THEN 'https://' || r.host || '/en;not a url;' || split_part(r.url, '?', 1) || '/more'
    ELSE '' END AS citations_text
FROM fv_rich r CROSS JOIN (VALUES ('chatgpt',1),('gemini',2),('perplexity',3)) AS e(engine, engine_no)
""",
)


def closure(names: list[str]) -> list[str]:
    """Views in the order a WITH clause needs them."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for need in VIEWS[name][0]:
            visit(need)
        done.append(name)

    for name in names:
        visit(name)
    return done


def with_views(names: list[str], *more: str) -> str:
    """WITH clause holding the named views and further 'name AS (...)' parts."""
    parts = [f"{name} AS ({VIEWS[name][1].strip()})" for name in closure(names)]
    return "WITH RECURSIVE " + ",\n".join(parts + list(more)) + "\n" if parts or more else ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    # set by local sessions (tellback.session), where the test tables are single row groups
    tasks = spark.conf.get("spark.tellback.textTasks", None)
    return spread(df, tasks and int(tasks)) if name in TEXT_TABLES else df


_CONSTANT_ROWS = re.compile(r"CROSS JOIN \(VALUES (.*?)\) AS (\w+)\(([^)]*)\)", re.S)


def _inline_rows(sql: str) -> str:
    """Constant VALUES rows as an in-place expansion: no join, no broadcast in the Spark plan."""

    def swap(match: re.Match) -> str:
        rows, alias, names = match.groups()
        structs = re.sub(r"\(", "struct(", rows)
        return f"LATERAL VIEW inline(array({structs})) {alias} AS {names}"

    return _CONSTANT_ROWS.sub(swap, sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the parquet tables it reads."""
    parts = [f"{n} AS ({_inline_rows(VIEWS[n][1].strip())})" for n in closure([name])]
    text = "\n".join(parts)
    for t in TABLES:
        if f"FROM {t}" in text or f"JOIN {t}" in text:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql("WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}")
