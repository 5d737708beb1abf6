"""Queries over declared facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import text as T
from tellback.operators import facts as X
from tellback.operators import pages as P
from tellback.plans import osql as O
from tellback.plans import pages as PP
from tellback.plans import sites as PS
from tellback.plans.fixtures import _view, table, view
from tellback.plans.registry import query

B = chr(92)
ALIAS_CTE = "alias(a, f) AS (VALUES " + ", ".join(f"({O.lit(a)}, '{f}')" for a, f in dims.alias_rows()) + ")"
LIMIT_CTE = "lim(f, n) AS (VALUES " + ", ".join(f"('{f}', {n})" for f, n in dims.MAX_VALUE_LENGTH.items()) + ")"


def resolve_cte(source: str, name: str, keep: str, label: str = "label") -> list[str]:
    """Rows of ``source`` with the field of their label (exact alias, else first segment)."""
    return [
        f"{name}_s AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, {O.squeeze('lower(' + label + ')')} AS nl FROM {source})",
        f"""{name} AS MATERIALIZED (SELECT {keep}, coalesce(d.f, (SELECT arg_min(al.f, g.p) FROM (SELECT unnest(sg) AS seg, generate_subscripts(sg, 1) AS p FROM (
     SELECT list_transform(string_split_regex(s.nl, '\\s*[/|·]\\s*'), lambda q: trim(q)) AS sg) z) g JOIN alias al ON al.a = g.seg)) AS field
   FROM {name}_s s LEFT JOIN alias d ON d.a = s.nl)""",
    ]


def values_sql(field: str, value: str, limit: str) -> str:
    v = O.squeeze(O.sub(value, "^[-*•·\\s]+"))
    items = f"list_filter(list_transform(string_split_regex({v}, ',|·|/| 및 | and '), lambda i: {O.strip('i')}), lambda i: i <> '')"
    return (
        f"(CASE WHEN {v} = '' OR {field} IS NULL THEN NULL WHEN {field} IN ('key_products', 'competitors') THEN "
        f"CASE WHEN len({items}) >= 1 THEN {items} END ELSE [{v}] END)"
    )


_LINE = "^[-*]?\\s*([^:：]{1,60})\\s*[:：]\\s*(.+)$"
LINE_CTES = [
    ALIAS_CTE,
    LIMIT_CTE,
    """fl_l AS MATERIALIZED (SELECT page_id, l, p FROM (SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM (
   SELECT page_id, list_filter(list_transform(string_split_regex(content, '\\n+'), lambda s: %s), lambda s: s <> '') AS ls FROM fv_facts) a) b)"""
    % O.strip("s"),
    f"""fl_c AS MATERIALIZED (SELECT page_id, p, l, {O.has('l', _LINE)} AS colon, {O.get('l', _LINE, 1)} AS label, {O.get('l', _LINE, 2)} AS value,
   sum(CASE WHEN {O.has('l', _LINE)} THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY p) AS run FROM fl_l)""",
    *resolve_cte("(SELECT * FROM fl_c WHERE colon) x", "fl_r", "s.page_id, s.p, s.run, s.label, s.value"),
    f"fl_v AS MATERIALIZED (SELECT r.*, {values_sql('r.field', 'r.value', 'lim.n')} AS vals FROM fl_r r LEFT JOIN lim ON lim.f = r.field)",
    """fl AS MATERIALIZED (SELECT page_id, field, arg_max(vals, p) AS vals FROM (SELECT *, count(*) OVER (PARTITION BY page_id, run) AS n FROM fl_v WHERE field IS NOT NULL AND vals IS NOT NULL) t
   WHERE n >= 2 GROUP BY page_id, field)""",
]


def explode_lines(spark, sf_dir):
    lines = F.filter(F.transform(F.split("content", "\n+"), T.strip), lambda s: s.rlike(X.LABEL_LINE))
    df = view(spark, sf_dir, "fv_facts").select("page_id", F.posexplode(lines).alias("pos", "line"))
    return df.select(
        "page_id",
        "pos",
        F.regexp_extract("line", X.LABEL_LINE, 1).alias("label"),
        F.regexp_extract("line", X.LABEL_LINE, 2).alias("value"),
    ).withColumn("field", X.field_of_label(F.col("label")))


@query(
    "alias_lookup",
    ["fv_facts"],
    "SELECT label, coalesce(field, 'none') AS field, count(*) AS lines FROM fl_r GROUP BY ALL",
    LINE_CTES[:-2],
)
def alias_lookup(spark, sf_dir):
    return (
        explode_lines(spark, sf_dir)
        .groupBy("label", F.coalesce("field", F.lit("none")).alias("field"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "fact_value_normalize",
    ["fv_facts"],
    f"SELECT page_id, label, coalesce({O.joined('vals')}, 'rejected') AS vals FROM fl_v",
    LINE_CTES[:-1],
)
def fact_value_normalize(spark, sf_dir):
    df = explode_lines(spark, sf_dir)
    return df.select(
        "page_id",
        "label",
        F.coalesce(F.array_join(X.normal_values(F.col("field"), F.col("value")), " | "), F.lit("rejected")).alias("vals"),
    )


@query(
    "facts_block_lines", ["fv_facts"], f"SELECT page_id, field, {O.joined('vals')} AS vals FROM fl", LINE_CTES
)
def facts_block_lines(spark, sf_dir):
    df = view(spark, sf_dir, "fv_facts")
    return X.explode_entries(df, X.block_from_lines(F.col("content"))).withColumnRenamed("values", "vals")


_ALT = X._label_alternation()


def inline_ctes(source: str, n: str) -> list[str]:
    anchors = "|".join(dims.FACT_ANCHORS)
    return [
        f"{n}_t AS MATERIALIZED (SELECT page_id, {O.squeeze('content')} AS text FROM {source})",
        f"""{n}_w AS MATERIALIZED (SELECT page_id, w, wno FROM (SELECT page_id, text AS w, 1000000 AS wno FROM {n}_t UNION ALL
   SELECT page_id, array_to_string(ps[k + 1:], ''), k FROM (SELECT page_id, ps, unnest(range(1, len(ps))) AS k FROM (
     SELECT page_id, string_split({O.sub('text', '(?i)(' + anchors + ')', chr(3) + B + '1')}, {O.lit(chr(3))}) AS ps FROM {n}_t) a) b) c)""",
        f"""{n}_p AS MATERIALIZED (SELECT page_id, wno, p, split_part(piece, {O.lit(chr(2))}, 1) AS label, split_part(piece, {O.lit(chr(2))}, 2) AS value FROM (
   SELECT page_id, wno, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM (SELECT page_id, wno, string_split({O.sub('w', '(?i)(' + _ALT + ')' + B + 's*[:：]' + B + 's*', chr(1) + B + '1' + chr(2))}, {O.lit(chr(1))}) AS ps FROM {n}_w) a) b
   WHERE contains(piece, {O.lit(chr(2))}))""",
        *resolve_cte(f"{n}_p", f"{n}_r", "s.page_id, s.wno, s.p, s.value"),
        f"""{n}_v AS MATERIALIZED (SELECT page_id, wno, field, arg_min(vals, p) AS vals FROM (SELECT r.*, {values_sql('r.field', 'r.value', 'lim.n')} AS vals FROM {n}_r r LEFT JOIN lim ON lim.f = r.field) t
   WHERE field IS NOT NULL AND vals IS NOT NULL GROUP BY page_id, wno, field)""",
        f"""{n} AS MATERIALIZED (SELECT v.page_id, v.field, v.vals FROM {n}_v v JOIN (SELECT page_id, min(wno) AS wno FROM (SELECT page_id, wno, count(*) AS c FROM {n}_v GROUP BY ALL HAVING count(*) >= 2) q GROUP BY page_id) b USING (page_id, wno))""",
    ]


@query(
    "facts_block_inline",
    ["fv_inline"],
    f"SELECT page_id, field, {O.joined('vals')} AS vals FROM inl",
    [ALIAS_CTE, LIMIT_CTE, *inline_ctes("fv_inline", "inl")],
)
def facts_block_inline(spark, sf_dir):
    df = view(spark, sf_dir, "fv_inline")
    return X.explode_entries(df, X.block_inline(F.col("content"))).withColumnRenamed("values", "vals")


BLOCK_CTES = LINE_CTES + inline_ctes("fv_facts", "inl") + [
    """blk AS MATERIALIZED (SELECT page_id, field, vals FROM fl UNION ALL SELECT i.page_id, i.field, i.vals FROM inl i WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.page_id = i.page_id AND fl.field = i.field))"""
]


@query("facts_block", ["fv_facts"], f"SELECT page_id, field, {O.joined('vals')} AS vals FROM blk", BLOCK_CTES)
def facts_block(spark, sf_dir):
    df = view(spark, sf_dir, "fv_facts")
    return X.explode_entries(df, X.facts_block(F.col("content"))).withColumnRenamed("values", "vals")


# --- ground truth --------------------------------------------------------------------
def declared_pages(spark, sf_dir):
    """Pages with a facts block as content and the JSON-LD of the rich page."""
    facts = view(spark, sf_dir, "fv_facts").select("page_id", "content")
    html = view(spark, sf_dir, "fv_rich").select("page_id", P.jsonld_blocks(F.col("html")).alias("jsonld_blocks"))
    return facts.join(html, "page_id")


_T = lambda p: f"nullif(trim(coalesce(json_extract_string(doc, '{p}'), '')), '')"
LDONE = """ldone AS MATERIALIZED (SELECT page_id, bno * 1000 + pos AS dpos, doc, types FROM ldt t WHERE pos > 0 OR json_type(doc, '$."@graph"') IS NULL)"""
_ELIG = "list_has_any(types, [" + ", ".join(f"'{t}'" for t in dims.ENTITY_JSONLD_TYPES) + "])"
GT_CTES = (
    PP.SIG[:3]
    + PS.LD_CTES
    + [
        LDONE,
        f"""jl AS MATERIALIZED (SELECT page_id, field, arg_min(vals, dpos) AS vals FROM (
   SELECT page_id, dpos, 'entity_name' AS field, CASE WHEN contains({_T('$.name')}, '|') OR contains({_T('$.name')}, ' - ') OR length({_T('$.name')}) > 60 THEN NULL ELSE {_T('$.name')} END AS v1, NULL AS vl FROM ldone WHERE {_ELIG}
   UNION ALL SELECT page_id, dpos, 'description', {_T('$.description')}, NULL FROM ldone WHERE {_ELIG}
   UNION ALL SELECT page_id, dpos, 'founded', {_T('$.foundingDate')}, NULL FROM ldone WHERE {_ELIG}
   UNION ALL SELECT page_id, dpos, 'ceo_or_leader', CASE json_type(doc, '$.founder') WHEN 'VARCHAR' THEN {_T('$.founder')} ELSE {_T('$.founder.name')} END, NULL FROM ldone WHERE {_ELIG}
   UNION ALL SELECT page_id, dpos, 'entity_type', {_T('$.serviceType')}, NULL FROM ldone WHERE {_ELIG}
   UNION ALL SELECT page_id, dpos, 'headquarters', {_T('$.address.addressLocality')}, NULL FROM ldone WHERE {_ELIG}
   UNION ALL SELECT page_id, dpos, 'key_products', NULL, list_filter(list_transform(json_extract(doc, '$.knowsAbout[*]'), lambda k: trim(coalesce(json_extract_string(k, '$.name'), json_extract_string(k, '$'), ''))), lambda k: k <> '') FROM ldone WHERE {_ELIG}
  ) a, LATERAL (SELECT CASE WHEN v1 IS NOT NULL THEN [v1] WHEN len(vl) > 0 THEN vl END AS vals) b WHERE vals IS NOT NULL GROUP BY page_id, field)""",
    ]
)


@query(
    "ground_truth",
    ["fv_rich", "fv_facts"],
    f"""SELECT coalesce(b.page_id, j.page_id) AS page_id, coalesce(b.field, j.field) AS field, {O.joined('coalesce(b.vals, j.vals)')} AS vals,
  CASE WHEN b.vals IS NOT NULL THEN 'official_facts_block' ELSE 'jsonld' END AS source,
  CASE WHEN b.vals IS NOT NULL AND j.vals IS NOT NULL THEN 'official_facts_block | jsonld' WHEN b.vals IS NOT NULL THEN 'official_facts_block' ELSE 'jsonld' END AS sources
 FROM blk b FULL OUTER JOIN jl j ON j.page_id = b.page_id AND j.field = b.field""",
    BLOCK_CTES + GT_CTES,
)
def ground_truth(spark, sf_dir):
    return X.ground_truth(declared_pages(spark, sf_dir)).withColumnRenamed("values", "vals")


@query(
    "alternate_names",
    ["fv_rich"],
    f"""SELECT s.page_id, coalesce(a.names, '') AS alternate_names FROM sig s LEFT JOIN (SELECT page_id, string_agg(n, ' | ' ORDER BY dpos, p) AS names FROM (
   SELECT page_id, dpos, unnest(ns) AS n, generate_subscripts(ns, 1) AS p FROM (SELECT page_id, dpos, json_extract_string(doc, '$.alternateName[*]') AS ns FROM ldone WHERE {_ELIG}) x) y GROUP BY page_id) a USING (page_id)""",
    PP.SIG[:3] + PS.LD_CTES + [LDONE],
)
def alternate_names(spark, sf_dir):
    html = view(spark, sf_dir, "fv_rich").select("page_id", P.jsonld_blocks(F.col("html")).alias("jsonld_blocks"))
    return X.alternate_names(html)


_BOXV = lambda f: "coalesce(" + ", ".join(f"max(CASE WHEN key = {O.lit(k)} THEN value END)" for k in dims.INFOBOX_KEYS[f]) + ")"
_KINDS_EN, _KINDS_KO = "company|corporation|brand|business", "기업|회사|브랜드|제조사|서비스"
WIKI_CTES = [
    PP.BOX_CTE,
    "boxl AS MATERIALIZED (SELECT page_id, key, arg_max(value, pos) AS value FROM box GROUP BY page_id, key)",
    "boxv AS MATERIALIZED (SELECT page_id, "
    + ", ".join(f"{_BOXV(f)} AS {f}" for f in dims.INFOBOX_KEYS)
    + " FROM boxl GROUP BY page_id)",
    f"""wp AS MATERIALIZED (SELECT page_id, org_name, lang, {PP._FIRST_PARA} AS para FROM fv_rich)""",
    f"""wd AS MATERIALIZED (SELECT *, CASE WHEN lang = 'en' THEN {O.has('para', '(?i)' + B + 'bis' + B + 's+(?:an?|the)' + B + 's+.+(?:' + _KINDS_EN + ')' + B + 'b')} ELSE {O.has('para', '(?:은|는)' + B + 's+.+(?:' + _KINDS_KO + ')')} END AS defined,
   CASE WHEN lang = 'en' THEN {O.get('para', '(?i)' + B + 'bis' + B + 's+(?:an?|the)' + B + 's+(.{1,60}?)(?:' + _KINDS_EN + ')' + B + 'b')} ELSE {O.get('para', '(?:은|는)' + B + 's+(.{1,60}?)(?:' + _KINDS_KO + ')')} END AS said FROM wp)""",
    f"""wt AS MATERIALIZED (SELECT page_id, 'entity_name' AS field, [org_name] AS vals, 'title' AS source FROM wd
  UNION ALL SELECT w.page_id, 'entity_type', [coalesce(b.entity_type, CASE WHEN w.defined THEN nullif(trim(w.said), '') END)], CASE WHEN b.entity_type IS NOT NULL THEN 'infobox' ELSE 'first_paragraph_definition' END FROM wd w LEFT JOIN boxv b USING (page_id)
   WHERE coalesce(b.entity_type, CASE WHEN w.defined THEN nullif(trim(w.said), '') END) IS NOT NULL
  UNION ALL SELECT page_id, 'description', [para], 'first_paragraph_definition' FROM wd WHERE defined AND para <> ''
  UNION ALL SELECT page_id, 'founded', [{O.get('founded', B + 'b((?:18|19|20)[0-9][0-9])' + B + 'b')}], 'infobox' FROM boxv WHERE {O.get('founded', B + 'b((?:18|19|20)[0-9][0-9])' + B + 'b')} <> ''
  UNION ALL SELECT page_id, 'headquarters', [headquarters], 'infobox' FROM boxv WHERE headquarters IS NOT NULL
  UNION ALL SELECT page_id, 'key_products', (list_filter(list_transform(string_split_regex(key_products, ',|·|/|\\n|;| 및 | and '), lambda i: trim(i)), lambda i: i <> '')), 'infobox' FROM boxv WHERE key_products IS NOT NULL)""",
]


def wiki_pages(spark, sf_dir):
    return view(spark, sf_dir, "fv_rich").withColumn("first_paragraph", P.first_paragraph(F.col("html")))


@query(
    "ground_truth_infobox",
    ["fv_rich"],
    f"SELECT page_id, field, {O.joined('vals')} AS vals, source FROM wt",
    WIKI_CTES,
)
def ground_truth_infobox(spark, sf_dir):
    return X.ground_truth_infobox(wiki_pages(spark, sf_dir)).withColumnRenamed("values", "vals")


_OFF = [(a.lower(), f) for f, aliases in dims.OFFICIAL_LABELS.items() for a in aliases]
_OLINE = "^[-*]?\\s*([^:]{1,30})\\s*:\\s*(.+)$"
_OITEMS = f"list_filter(list_transform(string_split_regex(value, ',|·|/| 및 | and '), lambda i: {O.strip('i')}), lambda i: i <> '')"


@query(
    "ground_truth_official",
    ["fv_rich", "fv_facts"],
    f"""SELECT coalesce(o.page_id, j.page_id) AS page_id, coalesce(o.field, j.field) AS field, {O.joined('coalesce(o.vals, [j.v])')} AS vals, CASE WHEN o.vals IS NOT NULL THEN 'official_facts_block' ELSE 'jsonld' END AS source
 FROM (SELECT page_id, field, arg_max(vals, p) AS vals FROM ol GROUP BY page_id, field) o
 FULL OUTER JOIN (SELECT page_id, field, arg_min(v, dpos) AS v FROM (
   SELECT page_id, dpos, 'entity_name' AS field, {_T('$.name')} AS v FROM ldone UNION ALL SELECT page_id, dpos, 'description', {_T('$.description')} FROM ldone
   UNION ALL SELECT page_id, dpos, 'founded', {_T('$.foundingDate')} FROM ldone UNION ALL SELECT page_id, dpos, 'ceo_or_leader', {_T('$.founder.name')} FROM ldone
   UNION ALL SELECT page_id, dpos, 'headquarters', {_T('$.address.addressLocality')} FROM ldone) u WHERE v IS NOT NULL GROUP BY page_id, field) j ON j.page_id = o.page_id AND j.field = o.field""",
    PP.SIG[:3]
    + PS.LD_CTES
    + [
        LDONE,
        "oal(a, f) AS (VALUES " + ", ".join(f"({O.lit(a)}, '{f}')" for a, f in _OFF) + ")",
        f"""ol AS MATERIALIZED (SELECT l.page_id, l.p, oal.f AS field, CASE WHEN oal.f = 'key_products' THEN {_OITEMS} ELSE [value] END AS vals FROM (
   SELECT page_id, p, lower({O.strip(O.get('l', _OLINE, 1))}) AS lab, {O.strip(O.get('l', _OLINE, 2))} AS value FROM (SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM (
    SELECT page_id, list_transform(string_split_regex(content, '\\n+'), lambda s: {O.strip('s')}) AS ls FROM fv_facts) a) b) l JOIN oal ON oal.a = l.lab WHERE value <> '')""",
    ],
)
def ground_truth_official(spark, sf_dir):
    return X.ground_truth_official(declared_pages(spark, sf_dir)).withColumnRenamed("values", "vals")


_QL = r"(?i)^\s*(?:q[.:]|q\s|- q[:.]|질문[:.]|문:)\s*(.+)"
_AL = r"(?i)^\s*(?:a[.:]|a\s|- a[:.]|답변[:.]|답:)\s*(.+)"


@query(
    "faq_pairs",
    ["fv_rich", "fv_facts"],
    f"""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY src, a1, a2) AS BIGINT) AS pair_no, CASE src WHEN 0 THEN 'jsonld' ELSE 'content' END AS source, question, answer FROM (
  SELECT page_id, 0 AS src, dpos AS a1, p AS a2, json_extract_string(m, '$.name') AS question, json_extract_string(m, '$.acceptedAnswer.text') AS answer FROM (
    SELECT page_id, dpos, unnest(ms) AS m, generate_subscripts(ms, 1) AS p FROM (SELECT page_id, dpos, json_extract(doc, '$.mainEntity[*]') AS ms FROM ldone WHERE list_contains(types, 'FAQPage')) a) b
  UNION ALL SELECT page_id, 1, p, 0, {O.strip(O.get('l', _QL))}, {O.strip(O.get('nx', _AL))} FROM (SELECT page_id, p, l, coalesce(lead(l) OVER (PARTITION BY page_id ORDER BY p), '') AS nx FROM (
    SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM (SELECT page_id, string_split_regex(content, '\\n+') AS ls FROM fv_facts) c) d) e) f WHERE question <> '' AND answer <> ''""",
    PP.SIG[:3] + PS.LD_CTES + [LDONE],
)
def faq_pairs(spark, sf_dir):
    return X.faq_pairs(declared_pages(spark, sf_dir))
