"""Queries over texts, hashes, options, request headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellback.functions import text as T
from tellback.functions import urls as U
from tellback.operators import texts as X
from tellback.plans import osql as O
from tellback.plans.fixtures import _view, table, view
from tellback.plans.registry import query

B = chr(92)


@query(
    "text_strip_html",
    ["fv_rich"],
    f"SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, {O.plain_html('html')} AS t FROM fv_rich) x",
)
def text_strip_html(spark, sf_dir):
    df = view(spark, sf_dir, "fv_rich").select("page_id", T.plain_html(F.col("html")).alias("t"))
    return df.select("page_id", F.length("t").alias("chars"), F.md5(F.encode("t", "UTF-8")).alias("text_md5"))


@query(
    "text_comparable",
    [],
    f"SELECT doc_id, md5(c) AS comparable_md5, len({O.tokens('c')}) AS token_count FROM (SELECT doc_id, {O.comparable('text')} AS c FROM documents) x",
)
def text_comparable(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", T.comparable(F.col("text")).alias("c"))
    return df.select(
        "doc_id", F.md5(F.encode("c", "UTF-8")).alias("comparable_md5"), F.size(T.tokens(F.col("c"))).alias("token_count")
    )


_view(
    "fv_mentions",
    [],
    """
SELECT doc_id, text || ' Founded 19' || CAST(10 + doc_id % 90 AS STRING) || ', again 2024년 and 12345. Mail Info' || CAST(doc_id AS STRING) || '@Mail.Example.com or see https://www.Shop' || CAST(doc_id % 7 AS STRING)
  || '.example.org/x?y=1 and docs.example.net. v1.2.3 is out' AS text FROM documents
""",
)
_HOSTY = "[a-z][a-z0-9-]*[.][a-z]{2,24}$|[0-9-][a-z0-9-]*[a-z][a-z0-9-]*[.][a-z]{2,24}$"
HOSTS_SQL = O.uniq(
    "list_concat(list_transform("
    + O.every("text", "(?i)https?://[^\\s)\"'<>\\]]+")
    + f", lambda u: {O.bare_host('u')}), list_transform("
    + O.every("text", "(?i)\\b(?:www\\.)?[a-z0-9-]+(?:\\.[a-z0-9-]+)+\\b")
    + f", lambda w: CASE WHEN regexp_matches({O.sub('lower(w)', '^www[.]')}, '{_HOSTY}') THEN {O.sub('lower(w)', '^www[.]')} ELSE '' END))"
)


def _sorted(x: str) -> str:
    return O.joined(f"list_sort({x})")


@query(
    "text_entities",
    ["fv_mentions"],
    f"""SELECT doc_id, {_sorted(O.years('text'))} AS years, {_sorted('list_distinct(list_transform(' + O.every('text', '(?i)' + B + 'b[A-Z0-9._%+-]+@[A-Z0-9.-]+' + B + '.[A-Z]{2,}' + B + 'b') + ', lambda e: lower(e)))')} AS emails,
  {_sorted(HOSTS_SQL)} AS hosts FROM fv_mentions""",
)
def text_entities(spark, sf_dir):
    df = X.text_entities(view(spark, sf_dir, "fv_mentions"), "doc_id")
    return df.select("doc_id", *[F.array_sort(c).alias(c) for c in ("years", "emails", "hosts")])


_SENT = "string_split(regexp_replace({t}, '([.!?。]|다[.]|요[.])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1))"
_S = f"list_filter(list_transform({_SENT.format(t='text')}, lambda s: {O.strip('s')}), lambda s: s <> '')"


@query(
    "text_sentences",
    [],
    f"SELECT doc_id, len({_S}) AS sentences, len(list_filter({_S}, lambda s: contains(lower(s), 'the') OR contains(lower(s), 'la'))) AS hits FROM documents",
)
def text_sentences(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text"), True).alias("s"))
    terms = F.array(F.lit(" the "), F.lit("LA"), F.lit("x"))
    return df.select("doc_id", F.size("s").alias("sentences"), X.sentences_with(F.col("s"), terms).alias("hits"))


_PARTS = f"list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: {O.strip('p')}), lambda p: p <> '')"


@query(
    "text_counts",
    [],
    f"SELECT doc_id, {O.words('text')} AS words, len({O.every('text', '(?i)<p' + B + 'b')}) AS p_tags, CASE WHEN len({_PARTS}) > 0 THEN CAST(round(list_sum(list_transform({_PARTS}, lambda p: length(p)))::DOUBLE / len({_PARTS}), 0) AS BIGINT) ELSE 0 END AS mean_paragraph FROM documents",
)
def text_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.word_count(t).alias("words"), T.tag_count(t, "p").alias("p_tags"),
        X.mean_paragraph_length(t).alias("mean_paragraph"),
    )


@query(
    "phrase_hints",
    [],
    "SELECT doc_id, "
    + O.joined(
        "("
        + O.uniq(
            "list_filter(list_transform(string_split(regexp_replace(text, '([.!?。])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda p: "
            + O.squeeze("p")
            + "), lambda p: length(p) >= 16 AND regexp_matches(p, '(?i)[a-z가-힣0-9]'))"
        )
        + ")"
    )
    + " AS hints FROM documents",
)
def phrase_hints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.phrase_hints(F.array("text")).alias("hints"))


@query(
    "token_overlap",
    [],
    f"""SELECT a.conv_id, a.turn, {O.token_share('a.tok', 'b.tok')} AS share FROM (SELECT conv_id, turn, {O.tokens(O.comparable('text'))} AS tok FROM conversations) a
  JOIN (SELECT conv_id, turn, {O.tokens(O.comparable('text'))} AS tok FROM conversations) b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def token_overlap(spark, sf_dir):
    # each turn against the next one of its conversation
    df = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), T.tokens(T.comparable(F.col("text"))).alias("tok")
    )
    after = df.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tok").alias("next"))
    return df.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", T.token_share(F.col("tok"), F.col("next")).alias("share")
    )


@query(
    "distinct_strings",
    [],
    "SELECT doc_id, " + O.joined(O.uniq(f"list_transform(string_split(text, '|'), lambda s: {O.strip('s')})")) + " AS parts FROM documents",
)
def distinct_strings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.distinct_strings(F.split("text", "\\|")).alias("parts")
    )


@query(
    "url_parts",
    [],
    f"""SELECT page_id, {O.bare_host('url')} AS hostname, {O.path('url')} AS path, {O.bare_host('url')} = 'example.org' OR {O.bare_host('url')} LIKE '%.example.org' AS official, 'https://' || {O.bare_host('url')} AS citation_url, {O.comparable_url('url')} AS comparable_url FROM pages""",
)
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.bare_host(u).alias("hostname"), U.path(u).alias("path"),
        U.same_or_subdomain(U.bare_host(u), F.lit("example.org")).alias("official"),
        F.concat(F.lit("https://"), U.bare_host(u)).alias("citation_url"), U.comparable_url(u).alias("comparable_url"),
    )


_H31 = """CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) AS BIGINT)"""


@query(
    "hash_keys",
    [],
    f"""SELECT page_id, stable_rank, cache_key, {_H31} AS hash31 FROM (SELECT page_id, substr(sha1('en:' || url), 1, 12) AS stable_rank, 'v7::chatgpt::' || url || '::q' AS cache_key,
   list_reduce(list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS h FROM pages) t""",
)
def hash_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", F.substring(F.sha1(F.concat(F.lit("en:"), F.col("url"))), 1, 12).alias("stable_rank"),
        F.concat_ws("::", F.lit("v7"), F.lit("chatgpt"), "url", F.lit("q")).alias("cache_key"),
        T.hash31(F.col("url")).alias("hash31"),
    )


_view(
    "fv_options",
    [],
    """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'off' WHEN 2 THEN '12.7' WHEN 3 THEN '-3' WHEN 4 THEN '' WHEN 5 THEN 'abc' WHEN 6 THEN CAST(event_id AS STRING) WHEN 7 THEN '0' ELSE '2.5' END AS raw FROM events
""",
)


@query(
    "option_parsing",
    ["fv_options"],
    """SELECT event_id, CASE WHEN lower(trim(raw)) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(trim(raw)) IN ('0', 'false', 'no', 'off') THEN false ELSE true END AS flag,
  CAST(CASE WHEN TRY_CAST(raw AS DOUBLE) > 0 THEN floor(TRY_CAST(raw AS DOUBLE)) ELSE 7 END AS BIGINT) AS positive_int, CAST(floor(TRY_CAST(nullif(trim(raw), '') AS DOUBLE) + 0.5) AS BIGINT) AS nullable_number,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, floor(TRY_CAST(nullif(trim(raw), '') AS DOUBLE) + 0.5))) AS clamped FROM fv_options WHERE event_id >= 0""",
)
def option_parsing(spark, sf_dir):
    raw = F.col("raw")
    number = X.parse_number(raw)
    return view(spark, sf_dir, "fv_options").select(
        "event_id", X.parse_boolean(raw, True).alias("flag"), X.parse_positive_int(raw, 7).alias("positive_int"),
        X.parse_nullable_number(raw).alias("nullable_number"), X.clamp(number, 0.0, 100.0).alias("clamped"),
    )


_view(
    "fv_requests",
    [],
    """
SELECT event_id, user_id, CASE event_id % 8 WHEN 0 THEN '10.1.' || CAST(user_id % 200 AS STRING) || '.7' WHEN 1 THEN '' ELSE 'bad' END AS real_ip,
  CASE event_id % 8 WHEN 2 THEN 'for="[2001:DB8::1]:4711";proto=http' WHEN 3 THEN 'unknown, ::ffff:1.2.3.' || CAST(user_id % 200 AS STRING) WHEN 4 THEN '8.8.4.4:99, 1.1.1.1' WHEN 5 THEN 'For=9.9.9.9' WHEN 6 THEN '999.1.1.1' ELSE '' END AS forwarded,
  'agent ' || CAST(user_id AS STRING) AS agent, event_type AS lang FROM events
""",
)


@query(
    "client_ip_parse",
    ["fv_requests"],
    """SELECT event_id, coalesce(ip, 'none') AS client_ip, coalesce(ip, 'anon:' || substr(sha256(agent || '|' || lang), 1, 24)) AS client FROM (
  SELECT *, CASE event_id % 8 WHEN 0 THEN real_ip WHEN 2 THEN '2001:db8::1' WHEN 3 THEN '1.2.3.' || CAST(user_id % 200 AS VARCHAR) WHEN 4 THEN '8.8.4.4' WHEN 5 THEN '9.9.9.9' END AS ip FROM fv_requests) t""",
)
def client_ip_parse(spark, sf_dir):
    df = view(spark, sf_dir, "fv_requests").withColumn(
        "headers",
        F.create_map(
            F.lit("x-real-ip"), "real_ip", F.lit("x-forwarded-for"), "forwarded", F.lit("user-agent"), "agent",
            F.lit("accept-language"), "lang",
        ),
    )
    return X.client_descriptor(df).select(
        "event_id", F.coalesce("client_ip", F.lit("none")).alias("client_ip"), "client"
    )


@query(
    "string_caps",
    [],
    f"SELECT doc_id, substr({O.squeeze(O.sub('text', '[' + B + 'x00-' + B + 'x1f' + B + 'x7f]', ' '))}, 1, 160) AS capped, CASE WHEN length({O.squeeze('text')}) > 120 THEN substr({O.squeeze('text')}, 1, 120) || '...' ELSE {O.squeeze('text')} END AS preview FROM documents",
)
def string_caps(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.without_controls(t, 160).alias("capped"), T.preview(t, 120).alias("preview")
    )
