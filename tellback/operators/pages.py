"""Page analytics: signals, markdown, indexability, usability, links, structure."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import text as T
from tellback.functions import urls as U


def body_text(html: Column, keep_lines: bool = False, limit: int | None = None) -> Column:
    """Readable body text. The whole text is kept unless ``limit`` is given.

    ``keep_lines`` keeps block ends as line breaks, which line-based fact
    parsing needs; by default all whitespace collapses.
    """
    inner = F.regexp_extract(html, "(?is)<body[^>]*>(.*?)</body>", 1)
    out = F.when(inner != "", inner).when(html.rlike("(?is)<body[^>]*></body>"), "").otherwise(html)
    for pattern in (
        "(?is)<h1[^>]*>.*?</h1>",
        "(?is)<h2[^>]*>.*?</h2>",
        "(?is)<script.*?</script>",
        "(?is)<style.*?</style>",
        "(?is)<noscript.*?</noscript>",
        "(?is)<svg.*?</svg>",
    ):
        out = F.regexp_replace(out, pattern, " ")
    if keep_lines:
        out = F.regexp_replace(out, "(?i)<br\\s*/?>|</(?:p|div|section|article|li|h1|h2|h3|h4|h5|h6|tr)>", "\n")
    out = T.decode_basic(T.strip_tags(out))
    if keep_lines:
        blanks = T.WS_SET.replace("\\s", " \\t\\r\\f")
        out = F.regexp_replace(out, f"[{blanks}]+", " ")
        out = T.strip(F.regexp_replace(out, " ?\n[ \n]*", "\n"))
    else:
        out = T.squeeze(out)
    return out if limit is None else F.substring(out, 1, limit)


def jsonld_blocks(html: Column) -> Column:
    found = F.regexp_extract_all(
        html, F.lit("(?is)<script[^>]*type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )
    return F.filter(F.transform(found, T.strip), lambda b: b != "")


def internal_links(url: Column, html: Column) -> Column:
    hrefs = F.regexp_extract_all(
        html, F.lit(f"(?i)<a{T.NO_WORD_AFTER}[^>]*href=[\"']([^\"'#]+)[\"']"), F.lit(1)
    )

    def same_site(base: Column) -> Column:
        links = F.transform(F.array_distinct(hrefs), lambda h: U.resolve_from(base, h))
        inside = lambda u: (u == base["origin"]) | F.startswith(u, F.concat(base["origin"], F.lit("/")))
        return F.array_distinct(F.filter(links, inside))

    return T.let(U.base_parts(url), same_site)


def page_signals(
    pages: DataFrame, x_robots: str | None = None, keep_lines: bool = False, body_limit: int | None = None
) -> DataFrame:
    """One row per page with every signal read from its HTML. No shuffle, no Python."""
    html, url = F.col("html"), F.col("url")
    images = F.regexp_extract_all(html, F.lit(f"(?i)<img{T.NO_WORD_AFTER}[^>]*>"), F.lit(0))
    canonical_raw = T.squeeze(T.decode_basic(T.attr_tag_value(html, "link", "rel", "canonical", "href", False)))
    out = pages.select(
        "*",
        T.tag_text(html, "title").alias("title"),
        T.decode_basic(
            T.first_text(T.meta_content(html, "name", "description"), T.meta_content(html, "property", "og:description"))
        ).alias("description"),
        T.tag_texts(html, "h1").alias("h1_texts"),
        T.tag_texts(html, "h2").alias("h2_texts"),
        T.tag_texts(html, "h3").alias("h3_texts"),
        T.tag_count(html, "li").alias("list_items"),
        T.tag_count(html, "table").alias("tables"),
        images.alias("_images"),
        F.when(canonical_raw != "", F.coalesce(U.resolve(url, canonical_raw), F.lit(""))).otherwise("").alias("canonical"),
        T.decode_basic(T.meta_content(html, "name", "robots")).alias("robots_meta"),
        T.decode_basic(T.meta_content(html, "name", "googlebot")).alias("googlebot_meta"),
        (F.coalesce(F.col(x_robots), F.lit("")) if x_robots else F.lit("")).alias("x_robots_tag"),
        T.decode_basic(T.meta_content(html, "property", "og:title")).alias("og_title"),
        T.decode_basic(T.meta_content(html, "property", "og:description")).alias("og_description"),
        jsonld_blocks(html).alias("jsonld_blocks"),
        internal_links(url, html).alias("links"),
        body_text(html, keep_lines, body_limit).alias("body_text"),
        F.lit("direct").alias("page_source"),
    )
    alt = lambda tag: T.decode_basic(F.regexp_extract(tag, "(?i)alt=[\"']([^\"']*)[\"']", 1))
    out = out.select(
        *[c for c in out.columns if c not in ("_images", "html")],
        F.size("_images").cast("bigint").alias("images"),
        F.size(F.filter("_images", lambda t: alt(t) == "")).cast("bigint").alias("images_without_alt"),
        (F.size("jsonld_blocks") > 0).alias("has_jsonld"),
        ((F.col("og_title") != "") | (F.col("og_description") != "")).alias("has_og"),
    )
    return out.withColumn("content", markdown())


def markdown() -> Column:
    """Title, description, h1 and h2 lines, then the body."""
    part = lambda mark, c: F.when(F.col(c) != "", F.concat(F.lit(mark), F.col(c)))
    lines = lambda mark, c: F.transform(F.col(c), lambda h: F.concat(F.lit(mark), h))
    return T.strip(
        F.array_join(
            F.array_compact(
                F.concat(
                    F.array(part("# ", "title"), part("", "description")),
                    lines("## ", "h1_texts"),
                    lines("### ", "h2_texts"),
                    F.array(part("", "body_text")),
                )
            ),
            "\n\n",
        )
    )


def markdown_signals(rendered: DataFrame) -> DataFrame:
    """The same signals for pages that came as rendered markdown."""
    content = F.col("content")

    def head(mark: str) -> Column:
        found = F.regexp_extract_all(content, F.lit(f"(?m)^{mark} (.+)$"), F.lit(1))
        return F.transform(found, T.strip)

    alts = F.regexp_extract_all(content, F.lit("!\\[(.*?)\\]\\(.+?\\)"), F.lit(1))
    return rendered.select(
        "*",
        head("#").alias("h1_texts"),
        head("##").alias("h2_texts"),
        head("###").alias("h3_texts"),
        F.regexp_count(content, F.lit("(?m)^[-*] .+$")).cast("bigint").alias("list_items"),
        F.floor(F.regexp_count(content, F.lit("\\|.+\\|")) / 3).cast("bigint").alias("tables"),
        F.size(alts).cast("bigint").alias("images"),
        F.size(F.filter(alts, lambda a: a == "")).cast("bigint").alias("images_without_alt"),
        T.contains_any(content, ["json-ld", "schema.org", "application/ld+json"]).alias("has_jsonld"),
        T.contains_any(content, ["og:", "Open Graph"]).alias("has_og"),
        F.lit("rendered").alias("page_source"),
    )


def indexability(signals: DataFrame) -> DataFrame:
    """noindex / indexable / likely_indexable, and how the canonical link relates."""

    def tokens(name: str) -> Column:
        return F.filter(F.split(F.lower(F.col(name)), f"(?:[;,]|{T.WS})+"), lambda t: t != "")

    sources = {"robots meta": "robots_meta", "googlebot meta": "googlebot_meta", "x-robots-tag": "x_robots_tag"}
    denied = F.array_compact(
        F.array(
            *[
                F.when(F.arrays_overlap(tokens(c), F.array(F.lit("noindex"), F.lit("none"))), F.lit(label))
                for label, c in sources.items()
            ]
        )
    )
    any_token = F.size(F.concat(*[tokens(c) for c in sources.values()])) > 0
    canonical, url = F.col("canonical"), F.col("url")
    has_canonical = canonical != ""
    same = T.let(U.comparable_url(canonical), lambda c: (c != "") & (c == U.comparable_url(url)))
    return signals.withColumn("noindex_sources", denied).select(
        "*",
        F.when(F.size("noindex_sources") > 0, "noindex")
        .when(any_token, "indexable")
        .otherwise("likely_indexable")
        .alias("index_status"),
        (F.size("noindex_sources") == 0).alias("allows_indexing"),
        F.when(has_canonical, same).alias("canonical_matches"),
        F.when(has_canonical, U.origin(canonical) == U.origin(url)).alias("canonical_same_origin"),
    )


def page_score() -> Column:
    w = F.col("words")
    return (
        F.when(w >= 150, 60).when(w >= 50, 35).when(w >= 15, 15).otherwise(0)
        + F.when(F.col("title") != "", 10).otherwise(0)
        + F.when(F.col("description") != "", 10).otherwise(0)
        + F.when(F.size("h1_texts") > 0, 10).otherwise(0)
        + F.when(F.col("has_jsonld"), 5).otherwise(0)
        + F.when(F.col("has_og"), 5).otherwise(0)
    ).cast("bigint")


def page_usability(signals: DataFrame, head_chars: int = 400) -> DataFrame:
    """Error-like, usable and strong flags and the 0-100 page score.

    An error page says so at its head; ``head_chars`` is what counts as the head, so that an article which
    mentions 404 further down is no error page.
    """
    sample = F.lower(F.concat_ws(" ", "title", "description", F.substring("content", 1, head_chars)))
    error_like = (
        sample.rlike(f"{T.NO_WORD_BEFORE}404{T.NO_WORD_AFTER}")
        | F.contains(sample, F.lit("page could not be found"))
        | F.contains(sample, F.lit("not found"))
        | F.contains(sample, F.lit("찾을 수 없습니다"))
    )
    out = signals.withColumns({"words": T.word_count(F.col("content")), "error_like": error_like})
    out = out.withColumn("score", page_score())
    return out.withColumns(
        {
            "usable": ~F.col("error_like") & (F.col("words") >= 15),
            "strong": ~F.col("error_like") & (F.col("words") >= 150) & (F.col("score") >= 55),
        }
    )


def min_content_gate(usable: DataFrame, minimum: int = 30) -> DataFrame:
    return usable.withColumn("gate", F.when(F.col("words") < minimum, "rejected").otherwise("accepted"))


def content_metrics(df: DataFrame, long_block: int = 2000) -> DataFrame:
    content = F.col("content")
    blocks = F.filter(F.split(content, "\\n\\n+"), lambda b: F.length(b) > long_block)
    bare = T.strip(F.regexp_replace(content, "[#*\\-|>\\[\\]()!`]", ""))
    return df.withColumns(
        {
            "words": T.word_count(content),
            "long_blocks": F.size(blocks).cast("bigint"),
            "text_ratio": F.round(F.length(bare) * 100.0 / F.greatest(F.length(content), F.lit(1)), 0).cast("bigint"),
        }
    )


def crawl_confidence(df: DataFrame) -> DataFrame:
    """0-100 from words, headings, markup, page count and text ratio."""
    w = F.col("words")
    total = (
        F.when(w >= 150, 35).when(w >= 50, 20).when(w >= 15, 10).otherwise(0)
        + F.when(F.col("h1_count") > 0, 15).otherwise(0)
        + F.when(F.col("h2_count") > 0, 10).otherwise(0)
        + F.when(F.col("has_jsonld"), 10).otherwise(0)
        + F.when(F.col("has_og"), 10).otherwise(0)
        + F.when(F.col("page_count") > 1, 10).otherwise(0)
        + F.when(F.col("text_ratio") >= 60, 10).otherwise(0)
    )
    return df.withColumn("crawl_confidence", F.least(total, F.lit(100)).cast("bigint"))


def keeps_title(title: Column) -> Column:
    """False for list, category, template and year titles."""
    return (
        (title != "")
        & ~title.rlike("(?i)^(List of |분류:|Category:|Template:|틀:)")
        & ~title.rlike("^[0-9]{4}$")
        & ~(title.rlike("^[0-9]") & title.rlike("(?i)compan(y|ies)"))
    )


def path_score(p: Column) -> Column:
    def has(*words: str) -> Column:
        return T.contains_any(p, list(words))

    return (
        F.when(has("about", "회사", "소개"), 30).otherwise(0)
        + F.when(has("service", "서비스"), 25).otherwise(0)
        + F.when(has("product", "제품"), 20).otherwise(0)
        + F.when(has("company"), 20).otherwise(0)
        + F.when(has("contact", "문의"), 15).otherwise(0)
        - F.length(p)
    ).cast("bigint")


def excluded_paths(paths: list[str] = dims.EXCLUDED_PATHS, prefixes: list[str] = dims.EXCLUDED_PREFIXES) -> str:
    """Pattern of these paths, with or without slashes behind, and of all that starts with one of the prefixes."""
    return "^(?:" + "|".join([*(re.escape(p) + "/*$" for p in paths), *(re.escape(p) + ".*[^/]" for p in prefixes)]) + ")"


def _useful(p: Column) -> Column:
    return (p != "/") & (F.size(F.split(p, "/")) <= 4) & T.contains_any(p, dims.USEFUL_PATH_WORDS)


def link_candidates(
    signals: DataFrame, home_paths: list[str] | None = None, key: str = "page_id", excluded: str | None = None
) -> DataFrame:
    """Sub-page candidates of every page: useful same-site links, then usual paths.

    Home pages get only ``home_paths``. ``excluded`` is a pattern of lower-case paths that are no candidates, such as
    ``excluded_paths()``. One row per candidate, best score first;
    duplicates by comparison key keep the earliest link.
    """
    home_paths = dims.HOME_CANDIDATES if home_paths is None else home_paths
    is_home = U.trimmed_path(F.col("url")) == ""
    usual = F.transform(
        F.array(*[F.lit(p) for p in dims.USUAL_PATHS]), lambda p: F.concat(U.origin(F.col("url")), p)
    )
    home = F.transform(
        F.array(*[F.lit(p) for p in home_paths]).cast("array<string>"),
        lambda p: F.concat(U.origin(F.col("url")), p),
    )
    found = F.filter(
        F.col("links"), lambda u: T.let(F.lower(U.path(u)), lambda p: _useful(p) & (~p.rlike(excluded) if excluded else F.lit(True)))
    )
    rows = signals.select(
        key,
        "url",
        F.posexplode(F.when(is_home, home).otherwise(F.concat(found, usual))).alias("pos", "candidate"),
    )
    rows = rows.withColumn("dedupe_key", U.dedupe_key(F.col("candidate"))).filter(
        F.col("dedupe_key") != U.dedupe_key(F.col("url"))
    )
    best = rows.groupBy(key, "url", "dedupe_key").agg(F.min(F.struct("pos", "candidate")).alias("first"))
    return best.select(
        key,
        "url",
        "dedupe_key",
        F.col("first.candidate").alias("candidate"),
        F.col("first.pos").cast("bigint").alias("pos"),
        T.let(F.lower(U.path(F.col("first.candidate"))), path_score).alias("path_score"),
    )


def url_canonicalize(df: DataFrame) -> DataFrame:
    """Distinct comparison URLs with how many source URLs each stands for."""
    return (
        df.select("url", "page_id", U.dedupe_key(F.col("url")).alias("canonical_url"))
        .groupBy("canonical_url")
        .agg(F.count(F.lit(1)).alias("source_urls"), F.min("page_id").alias("first_page_id"))
    )


def url_policy(df: DataFrame, col: str = "input_url") -> DataFrame:
    """Literal part of the public-URL rule: (allowed, reason). Names are not looked up."""
    value = T.strip(F.coalesce(F.col(col), F.lit("")))
    full = F.when(value.rlike("(?i)^https?://"), value).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(value, "^//", ""))
    )
    out = df.withColumn("_full", full)
    name = U.host(F.col("_full"))
    out = out.withColumn(
        "_host",
        F.when(
            name.rlike("^[0-9]{1,10}$"),
            F.concat_ws(
                ".",
                *[
                    F.shiftrightunsigned(name.cast("bigint"), shift).bitwiseAND(F.lit(255)).cast("string")
                    for shift in (24, 16, 8, 0)
                ],
            ),
        ).otherwise(name),
    )
    h = F.col("_host")
    mapped = F.regexp_extract(h, "^\\[::ffff:([0-9.]+)\\]$", 1)
    v4 = F.when(mapped != "", mapped).otherwise(h)
    is_v4 = v4.rlike("^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    octet = lambda i: F.get(F.split(v4, "\\."), i).try_cast("int")
    a, b, c = octet(0), octet(1), octet(2)
    private_v4 = (
        a.isin(0, 10, 127)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 0) & (c <= 2))
        | ((a == 192) & (b == 88) & (c == 99))
        | ((a == 192) & (b == 168))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
        | (a >= 224)
    )
    blocked = h.isin(dims.BLOCKED_HOSTS)
    for suffix in dims.BLOCKED_HOST_SUFFIXES:
        blocked = blocked | h.endswith(suffix)
    reason = (
        F.when(value == "", "empty")
        .when((h == "") | h.rlike("[\\s<>^|%]"), "bad_url")
        .when(U.user_info(F.col("_full")) != "", "credentials")
        .when(blocked, "blocked_host")
        .when(is_v4 & private_v4, "private_ip")
        .when(is_v4, "public")
        .when(h.startswith("["), F.when(h.rlike("^\\[(::1?\\]|f[cd]|fe[89ab]|2001:db8)"), "private_ip").otherwise("ipv6_literal"))
        .when(h.rlike("(^|\\.)(0x[0-9a-f]*|[0-9]+)\\.?$"), "ambiguous_ip")
        .otherwise("public")
    )
    return out.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "public").drop("_full", "_host")


def crawl_error_class(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(T.contains_any(m, ["timeout", "timed out", "aborted"]), "timeout")
        .when(T.contains_any(m, ["fetch failed", "econnrefused", "enotfound", "network"]), "network")
        .when(T.contains_any(m, ["json", "unexpected token", "parse"]), "parse")
        .otherwise("unknown")
    )


# --- entity definition ----------------------------------------------------
def lead_paragraph(content: Column, reach: int = 240) -> Column:
    """Leading non-heading lines joined until the paragraph reaches 240 characters."""
    lines = F.filter(
        F.transform(F.split(content, "\\n+"), T.strip),
        lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("---") & ~s.startswith("[추가 페이지:"),
    )
    folded = F.aggregate(
        lines,
        F.lit(""),
        lambda acc, s: F.when(acc == "", s).when(F.length(acc) >= reach, acc).otherwise(F.concat_ws(" ", acc, s)),
    )
    return T.squeeze(folded)


def first_sentence(paragraph: Column) -> Column:
    found = F.regexp_extract(paragraph, "^(.{1,220}?[.!?]|.{1,220}?다\\.|.{1,220}?요\\.)", 1)
    return T.squeeze(F.when(found != "", found).otherwise(paragraph))


def entity_name(h1_texts: Column, title: Column) -> Column:
    h1 = T.squeeze(F.get(h1_texts, 0))
    t = T.squeeze(title)
    head = T.squeeze(F.get(F.split(t, f"{T.WS}+[|·\\-]{T.WS}+"), 0))
    return F.when(h1 != "", h1).when(t == "", "").when(head != "", head).otherwise(t)


def entity_definition(df: DataFrame) -> DataFrame:
    """Does the first sentence name the entity and say what it is?"""
    out = df.withColumns(
        {
            "entity_name": entity_name(F.col("h1_texts"), F.col("title")),
            "lead_sentence": first_sentence(lead_paragraph(F.col("content"))),
        }
    )
    s, name = F.col("lead_sentence"), F.col("entity_name")
    mentions = (name != "") & F.contains(F.lower(s), F.lower(name))
    pattern = (
        f"(?i)(?:은|는){T.WS}+.+(?:기업|회사|브랜드|서비스|플랫폼|제조사|기관|조직)"
        f"|{T.NO_WORD_BEFORE}is{T.WS}+(?:an?|the){T.WS}+.+(?:company|business|brand|platform|service|organization){T.NO_WORD_AFTER}"
    )
    return out.withColumn("defines_entity", (s != "") & mentions & s.rlike(pattern))


# --- encyclopedia page structure -------------------------------------------
def first_paragraph(html: Column) -> Column:
    texts = F.transform(
        F.regexp_extract_all(html, F.lit(f"(?is)<p{T.NO_WORD_AFTER}[^>]*>.*?</p>"), F.lit(0)), T.plain_html
    )
    return F.coalesce(F.get(F.filter(texts, lambda t: F.length(t) >= 30), 0), F.lit(""))


def section_headings(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(f"(?is)<h([23]){T.NO_WORD_AFTER}[^>]*>(.*?)</h\\1>"), F.lit(2))
    clean = F.transform(found, lambda h: F.trim(F.regexp_replace(T.plain_html(h), "(?i)\\[편집\\]|\\[edit\\]", "")))
    return F.filter(clean, lambda h: h != "")


def infobox_rows(html: Column) -> Column:
    """key/value rows of the first infobox table, in table order."""
    box = F.regexp_extract(html, '(?is)<table[^>]*class="[^"]*infobox[^"]*"[^>]*>.*?</table>', 0)
    rows = F.regexp_extract_all(box, F.lit(f"(?is)<tr{T.NO_WORD_AFTER}[^>]*>.*?</tr>"), F.lit(0))
    cell = lambda r, tag: T.plain_html(
        F.regexp_extract(r, f"(?is)<{tag}{T.NO_WORD_AFTER}[^>]*>(.*?)</{tag}>", 1)
    )
    pairs = F.transform(
        rows,
        lambda r: F.struct(
            F.trim(F.regexp_replace(cell(r, "th"), ":$", "")).alias("key"), cell(r, "td").alias("value")
        ),
    )
    return F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))


def infobox_extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page and infobox key; a repeated key keeps its last value."""
    rows = pages.select(key, F.posexplode(infobox_rows(F.col("html"))).alias("pos", "row"))
    return rows.groupBy(key, F.col("row.key").alias("key")).agg(F.max_by("row.value", "pos").alias("value"))


def _anchors(html: Column) -> Column:
    pattern = f'(?is)<a{T.NO_WORD_AFTER}[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    return F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("anchor"),
    )


def link_extract(pages: DataFrame, key: str = "page_id", lang: str = "lang") -> DataFrame:
    """internal (/wiki/) and external links with their anchor text, one row each."""
    rows = pages.select(key, lang, F.posexplode(_anchors(F.col("html"))).alias("pos", "link"))
    rows = rows.select(
        key,
        "pos",
        lang,
        F.when(F.contains(F.col("link.href"), F.lit("&")), T.decode_full(F.col("link.href")))
        .otherwise(F.col("link.href"))
        .alias("raw"),
        T.plain_html(F.col("link.anchor")).alias("anchor"),
    ).filter("anchor <> ''")
    kind = F.when(F.col("raw").startswith("/wiki/"), "internal").when(F.col("raw").rlike("(?i)^https?://"), "external")
    return rows.select(
        key,
        F.col("pos").cast("bigint").alias("pos"),
        kind.alias("kind"),
        F.when(
            kind == "internal", F.concat(F.lit("https://"), F.col(lang), F.lit(".wikipedia.org"), F.col("raw"))
        )
        .otherwise(F.col("raw"))
        .alias("href"),
        "anchor",
    ).filter("kind is not null")


def structural_features(pages: DataFrame, title: str = "org_name", categories: str | None = None) -> DataFrame:
    """Thirteen structure features of an encyclopedia page, all from one HTML scan."""
    html = F.col("html")
    links = F.filter(
        F.transform(
            _anchors(html), lambda a: F.struct(a["href"].alias("href"), T.plain_html(a["anchor"]).alias("anchor"))
        ),
        lambda a: a["anchor"] != "",
    )
    out = pages.withColumns(
        {
            "first_paragraph": first_paragraph(html),
            "_headings": section_headings(html),
            "_box": infobox_rows(html),
            "_links": links,
            "plain_text": T.plain_html(html),
            "reference_count": F.greatest(
                F.regexp_count(html, F.lit('(?i)id="cite_note')), F.regexp_count(html, F.lit('(?i)class="reference-text"'))
            ).cast("bigint"),
            "has_bullet_lists": html.rlike(f"(?i)<[uo]l{T.NO_WORD_AFTER}"),
            "categories_count": (F.size(categories) if categories else F.lit(0)).cast("bigint"),
        }
    )
    para = F.col("first_paragraph")
    sentence = F.get(F.split(para, "[.!?。]"), 0)
    sentence = F.when(sentence == "", para).otherwise(sentence)
    paragraphs = F.filter(F.transform(F.split("plain_text", "\\n{2,}"), T.strip), lambda p: p != "")
    total = F.aggregate(paragraphs, F.lit(0), lambda acc, p: acc + F.length(p))
    out = out.withColumns(
        {
            "infobox_field_count": F.size(F.array_distinct(F.col("_box.key"))).cast("bigint"),
            "defines_entity": para.rlike(
                f"(?i)은{T.WS}.+(기업|회사|브랜드|제조사|서비스)|is{T.WS}+(an?|the){T.WS}.+(company|corporation|business|brand)"
            ),
            "name_in_first_sentence": F.contains(F.lower(sentence), F.lower(F.col(title))),
            "section_count": F.size("_headings").cast("bigint"),
            "word_count": T.word_count(F.col("plain_text")),
            "avg_paragraph_length": F.when(
                F.size(paragraphs) > 0, F.round(total / F.size(paragraphs), 0)
            ).otherwise(0).cast("bigint"),
            "internal_link_count": F.size(F.filter("_links", lambda a: a["href"].startswith("/wiki/"))).cast("bigint"),
            "external_link_count": F.size(F.filter("_links", lambda a: a["href"].rlike("(?i)^https?://"))).cast("bigint"),
        }
    )
    links_total = F.col("internal_link_count") + F.col("external_link_count")
    return out.withColumns(
        {
            "has_infobox": F.col("infobox_field_count") > 0,
            "text_to_link_ratio": F.round(F.col("word_count") / F.greatest(links_total, F.lit(1)), 2),
        }
    ).drop("_headings", "_box", "_links")


def selection_score(df: DataFrame) -> DataFrame:
    """How promising a page is for a study of weak pages."""
    length = F.coalesce(F.col("page_length"), F.lit(0))
    cats = F.coalesce(F.col("categories"), F.array().cast("array<string>"))
    any_cat = lambda pattern: F.exists(cats, lambda c: c.rlike(f"(?i){pattern}"))
    tier = F.col("tier")
    total = (
        F.when(tier == "sparse_stub", 20).when(tier == "small_startup", 8).when(tier == "national_mid", 5).otherwise(0)
        + F.when(F.col("stub"), 24).otherwise(0)
        + F.when((length > 0) & (length <= 700), 28)
        .when(length <= 1200, 22)
        .when(length <= 2200, 16)
        .when(length <= 4000, 10)
        .when(length <= 8000, 4)
        .otherwise(0)
        + F.when(any_cat("출처가 필요한|unsourced|lacking reliable references"), 12).otherwise(0)
        + F.when(any_cat("광고처럼 작성된|advertising|cleanup|정리가 필요한"), 8).otherwise(0)
        + F.when(any_cat("stub|토막글"), 10).otherwise(0)
        + F.when(F.size(cats) <= 3, 6).otherwise(0)
        + F.when(F.col("title").rlike("[A-Z]{2,}"), 4).otherwise(0)
    )
    return df.withColumn("selection_score", total.cast("bigint"))


def candidate_pages_topk(candidates: DataFrame, usable: DataFrame, k: int = 2) -> DataFrame:
    """Best k usable sub-pages per page. Rank limit is applied before the shuffle."""
    joined = candidates.join(usable.select("dedupe_key", "candidate_page_id"), "dedupe_key")
    w = Window.partitionBy("page_id").orderBy(F.desc("path_score"), "pos", "candidate_page_id")
    return joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
