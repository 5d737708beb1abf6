"""Site-level analytics: robots, llms, sitemaps, page bundles, lint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import jsonld as J
from tellback.functions import text as T
from tellback.functions import urls as U
from tellback.operators import pages as P
from tellback.operators.walks import reached
from tellback.sources.numbering import numbered
from tellback.sources.sinks import store

ROOT_PATHS = ["/", "/*"]


def _directives(group: Column) -> Column:
    """Field/value pairs of one robots group; comments and lines without ':' are skipped."""
    lines = F.filter(
        F.transform(F.split(group, "\n"), T.strip), lambda s: F.contains(s, F.lit(":")) & ~s.startswith("#")
    )
    return F.transform(
        lines,
        lambda s, i: F.struct(
            F.lower(F.trim(F.substring_index(s, ":", 1))).alias("field"),
            T.strip(F.regexp_replace(s, "^[^:]*:", "")).alias("value"),
            i.alias("pos"),
        ),
    )


def robots_rules(robots: DataFrame, key: str = "host") -> DataFrame:
    """(host, agent, directive, path) rows; a directive applies to the agents above it in its group.

    Every declared agent also gives a 'user-agent' row, so an agent without
    rules stays visible. No shuffle: groups are cut inside the row.
    """
    groups = F.split("body", f"\n{T.WS}*\n")
    rows = robots.select(key, F.explode(F.transform(groups, _directives)).alias("g"))
    agents = F.filter("g", lambda d: d["field"] == "user-agent")
    rules = F.filter("g", lambda d: d["field"].isin("allow", "disallow") & (d["value"] != ""))
    pair = lambda agent, field, value: F.struct(
        agent.alias("agent"), field.alias("directive"), value.alias("path")
    )
    per_rule = F.flatten(
        F.transform(
            rules,
            lambda r: F.transform(
                F.filter(agents, lambda a: a["pos"] < r["pos"]), lambda a: pair(a["value"], r["field"], r["value"])
            ),
        )
    )
    declared = F.transform(agents, lambda a: pair(a["value"], F.lit("user-agent"), F.lit("")))
    return rows.select(key, F.explode(F.concat(declared, per_rule)).alias("r")).select(key, "r.*")


def robots_sitemaps(robots: DataFrame, key: str = "host") -> DataFrame:
    """Sitemap URLs a robots file names, with their order."""
    lines = F.filter(_directives(F.col("body")), lambda d: (d["field"] == "sitemap") & (d["value"] != ""))
    base = F.concat(F.lit("https://"), F.col(key), F.lit("/"))
    urls = F.array_distinct(F.filter(F.transform(lines, lambda d: U.resolve(base, d["value"])), lambda u: u.isNotNull()))
    return robots.select(key, F.posexplode(urls).alias("pos", "sitemap_url"))


def bot_access(sites: DataFrame, rules: DataFrame, key: str = "host") -> DataFrame:
    """allow / disallow / unknown per site and AI crawler; own rules win over '*'."""
    root = F.col("path").isin(ROOT_PATHS)
    known = rules.filter(F.col("agent").isin(["*", *dims.AI_BOTS]))
    per_agent = known.groupBy(key, "agent").agg(
        F.bool_or((F.col("directive") == "disallow") & root).alias("denies"),
        F.bool_or((F.col("directive") == "allow") & root).alias("allows"),
    )
    state = F.when(F.col("denies") & ~F.col("allows"), "disallow").otherwise("allow")
    # at most one entry per known agent, so the collected list is bounded
    per_site = per_agent.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("agent", state.alias("state")))).alias("states")
    )
    bots = F.explode(F.array(*[F.lit(b) for b in dims.AI_BOTS]))
    return (
        sites.join(per_site, key, "left")
        .select("*", bots.alias("bot"))
        .withColumn(
            "access", F.coalesce(F.col("states")[F.col("bot")], F.col("states")[F.lit("*")], F.lit("unknown"))
        )
        .drop("states")
    )


def bot_summary(access: DataFrame, key: str = "host") -> DataFrame:
    return access.groupBy(key).agg(
        *[
            F.count_if(F.col("access") == state).alias(name)
            for state, name in (("allow", "bots_allowed"), ("disallow", "bots_denied"), ("unknown", "bots_unknown"))
        ]
    )


def llms_txt(files: DataFrame, key: str = "host") -> DataFrame:
    return files.select(
        key,
        (F.length(T.strip(F.col("body"))) >= 20).alias("llms_exists"),
        F.length("body").cast("bigint").alias("llms_chars"),
    )


def _locs(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(f"(?is)<loc>{T.WS}*(.*?){T.WS}*</loc>"), F.lit(1))
    return F.transform(found, lambda x: T.strip(T.decode_basic(x)))


def pick_sitemap(files: DataFrame, declared: DataFrame, key: str = "host") -> DataFrame:
    """The first available candidate per site: robots-declared ones, then /sitemap.xml. ``files`` has (site, sitemap_url), and the body if it is a table of bodies."""
    own = ["sitemap_url", *(["body"] if "body" in files.columns else [])]
    last = F.struct(F.lit(1).alias("default"), F.lit(0).cast("long").alias("pos"))  # behind all that are declared
    default = files.select(
        key, last.alias("order"), F.concat(F.lit("https://"), F.col(key), F.lit("/sitemap.xml")).alias("sitemap_url")
    ).dropDuplicates([key])
    first = F.struct(F.lit(0).alias("default"), F.col("pos").cast("long").alias("pos"))
    candidates = declared.select(key, first.alias("order"), "sitemap_url").unionByName(default)
    found = files.select(key, *own).join(candidates, [key, "sitemap_url"])
    return found.groupBy(key).agg(F.min_by(F.struct(*own), "order").alias("pick")).select(key, "pick.*")


def sitemap_stats(picked: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Elements and entries of each picked sitemap, from its body or from the rows of ``sources.sitemaps``."""
    if entries is None:
        body = F.col("body")
        out = picked.withColumns(
            {
                "url_count": F.regexp_count(body, F.lit(f"(?i)<url{T.NO_WORD_AFTER}")).cast("bigint"),
                "sitemap_count": F.regexp_count(body, F.lit(f"(?i)<sitemap{T.NO_WORD_AFTER}")).cast("bigint"),
                "loc_count": F.size(_locs(body)).cast("bigint"),
            }
        )
    else:
        counts = entries.groupBy("sitemap_url").agg(
            F.sum("url_tags").alias("url_count"), F.sum("sitemap_tags").alias("sitemap_count"), F.count("loc").alias("loc_count")
        )
        out = picked.join(counts, "sitemap_url", "left").fillna(0, ["url_count", "sitemap_count", "loc_count"])
    return out.withColumns(
        {
            "sitemap_exists": F.greatest("url_count", "sitemap_count", "loc_count") > 0,
            "sitemap_format": F.when(F.col("sitemap_count") > 0, "index")
            .when(F.col("url_count") > 0, "urlset")
            .otherwise("unknown"),
        }
    )


def sitemap_locs(entries: DataFrame, picked: DataFrame, key: str = "host") -> DataFrame:
    """(site, loc): the pages that a site's picked sitemap lists, in itself and in all sitemaps that it leads to over indexes of any depth."""
    links = entries.filter("kind = 'sitemap' and loc is not null").select(F.col("sitemap_url").alias("parent"), F.col("loc").alias("child"))
    maps = reached(links, picked.select(F.col("sitemap_url").alias("seed")))
    listed = entries.filter("kind is distinct from 'sitemap' and loc is not null").select(F.col("sitemap_url").alias("node"), "loc")
    roots = picked.select(key, F.col("sitemap_url").alias("seed"))
    return roots.join(maps.select("seed", "node"), "seed").join(listed, "node").select(key, "loc")


def sitemap_membership(pages: DataFrame, picked: DataFrame, key: str = "host") -> DataFrame:
    """Is the page, or its path, listed in the site's sitemap? Equi joins on (site, URL) and (site, path).

    ``picked`` has a body per site or, from ``sitemap_locs``, a row per entry.
    """
    locs = picked.select(key, F.explode(_locs(F.col("body"))).alias("loc")) if "body" in picked.columns else picked.select(key, "loc")
    locs = locs.select(
        key, U.comparable_url(F.col("loc")).alias("cmp_url"), T.let(U.trimmed_path(F.col("loc")), lambda p: F.when(p == "", "/").otherwise(p)).alias("cmp_path")
    )
    urls = locs.filter("cmp_url <> ''").select(key, "cmp_url").distinct().withColumn("lists_url", F.lit(True))
    paths = locs.filter("cmp_path is not null").select(key, "cmp_path").distinct().withColumn("lists_path", F.lit(True))
    asked = pages.withColumns(
        {
            "cmp_url": U.comparable_url(F.col("url")),
            "cmp_path": T.let(U.trimmed_path(F.col("url")), lambda p: F.when(p == "", "/").otherwise(p)),
        }
    )
    return (
        asked.join(urls, [key, "cmp_url"], "left")
        .join(paths, [key, "cmp_path"], "left")
        .withColumns(
            {
                "lists_url": F.coalesce("lists_url", F.lit(False)),
                "lists_path": F.coalesce("lists_path", F.lit(False)),
            }
        )
        .drop("cmp_url", "cmp_path")
    )


def discovery_summary(
    sites: DataFrame, robots: DataFrame, llms: DataFrame, sitemaps: DataFrame, key: str = "host", entries: DataFrame | None = None
) -> DataFrame:
    """Crawler access, llms.txt and sitemap facts on one row per site. Sitemaps are a table of bodies, or (site, sitemap_url) with their ``entries``."""
    bots = bot_summary(bot_access(sites.select(key), robots_rules(robots, key), key), key)
    maps = sitemap_stats(pick_sitemap(sitemaps, robots_sitemaps(robots, key), key), entries)
    return (
        bots.join(llms_txt(llms, key), key, "left")
        .join(maps.select(key, "sitemap_exists", "sitemap_format", "url_count"), key, "left")
        .select(
            key,
            "bots_allowed",
            "bots_denied",
            "bots_unknown",
            F.coalesce("llms_exists", F.lit(False)).alias("llms_exists"),
            F.coalesce("llms_chars", F.lit(0)).alias("llms_chars"),
            F.coalesce("sitemap_exists", F.lit(False)).alias("sitemap_exists"),
            F.coalesce("sitemap_format", F.lit("unknown")).alias("sitemap_format"),
            F.coalesce("url_count", F.lit(0)).alias("sitemap_urls"),
        )
    )


# --- several pages of a site ---------------------------------------------------
def site_rollup(usable: DataFrame, key: str = "host") -> DataFrame:
    """Per site over all its pages; only sums, so a hot site pre-aggregates in every task."""
    return (
        usable.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.round(F.avg(F.col("usable").cast("double")), 4).alias("usable_share"),
            F.round(F.avg("words"), 2).alias("mean_words"),
            F.round(F.avg("list_items"), 2).alias("mean_list_items"),
            F.sum("images_without_alt").alias("images_without_alt"),
            F.bool_or("has_jsonld").alias("has_jsonld"),
            F.max("score").alias("best_score"),
        )
        .orderBy(F.desc("best_score"), F.desc("pages"), key)
    )


def bundle_roles(usable: DataFrame, extras: int | None = None, key: str = "host") -> DataFrame:
    """Main page (lowest id) and the usable sub-pages of every site, best first: (page_id, role, role_pos).

    Ranks run on ids and scores only. With ``extras`` the rank limit is applied before the shuffle, so a site with
    a third of all pages sends a handful of rows.
    """
    slim = usable.select(
        key, "page_id", "usable", T.let(F.lower(U.path(F.col("url"))), P.path_score).alias("path_score")
    )
    first = Window.partitionBy(key).orderBy("page_id")
    main = slim.withColumn("n", F.row_number().over(first)).filter("n = 1").select(key, "page_id")
    # 'usable' is part of the order, not a filter before the window: a filter would be pushed
    # into the scan projection and repeat the whole signal computation inside the predicate
    best = Window.partitionBy(key).orderBy(F.desc("usable"), F.desc("path_score"), "page_id")
    top = slim.withColumn("n", F.row_number().over(best))
    top = top.filter(F.col("usable") if extras is None else (F.col("n") <= extras + 1) & F.col("usable"))
    kept = top.join(main, [key, "page_id"], "left_anti").withColumn("role_pos", F.row_number().over(best))
    kept = kept if extras is None else kept.filter(F.col("role_pos") <= extras)
    return main.select(key, "page_id", F.lit("main").alias("role"), F.lit(0).alias("role_pos")).unionByName(
        kept.select(key, "page_id", F.lit("extra").alias("role"), "role_pos")
    )


def site_pages(usable: DataFrame, key: str = "host") -> DataFrame:
    """Every site's main page (lowest id) and all its other usable pages, with ``is_main`` and a sortable ``place``.

    The main ids come from a second read of ids and hosts alone; they are stored, so that the join with them can be split for a site of many pages, or needs no
    shuffle where they are few.
    """
    main = store(usable.groupBy(key).agg(F.min("page_id").alias("_main")), "main")
    placed = usable.join(main, key).withColumn("is_main", F.col("page_id") == F.col("_main"))
    score = T.let(F.lower(U.path(F.col("url"))), P.path_score)
    place = F.struct((~F.col("is_main")).alias("extra"), (-score).alias("score"), F.col("page_id").alias("id"))
    return placed.filter(F.col("is_main") | F.col("usable")).withColumn("place", place).drop("_main")


def _heading_rows(pages: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per site and heading: its first place, and whether the main page has it. A heading of many pages is combined
    before the shuffle."""
    def of_kind(k: int):
        return lambda h: F.struct(F.lit(k).alias("kind"), h.alias("heading"))

    named = F.concat(*[F.transform(c, of_kind(k)) for k, c in enumerate(columns)])
    rows = pages.select(key, "is_main", "place", *columns).select(key, "is_main", "place", F.posexplode(named).alias("pos", "h"))
    return rows.select(key, "is_main", F.struct("place", "pos").alias("at"), "h.*")


def _distinct_headings(pages: DataFrame, key: str) -> DataFrame:
    """A row per site, kind (0 for h1, 1 for h2) and heading, with its first place."""
    return _heading_rows(pages, key, "h1_texts", "h2_texts").groupBy(key, "kind", "heading").agg(F.min("at").alias("at"))


def site_headings(pages: DataFrame, key: str = "host", limit: int | None = None) -> DataFrame:
    """All distinct headings of a site over all pages of ``site_pages``: ``kind`` (h1 or h2), number by place, heading.

    These are rows; no site has a list of them, and no task numbers a whole site. ``limit`` keeps the first ones of each kind.
    """
    rows = numbered(_distinct_headings(pages, key), [key, "kind"], F.col("at"), F.col("heading"), limit=limit)
    return rows.select(key, F.when(F.col("kind") == 0, "h1").otherwise("h2").alias("kind"), "n", "heading")


def site_signal_merge(pages: DataFrame, key: str = "host", headings: int | None = None, lists: bool = False) -> DataFrame:
    """Sums, ORs and heading counts over all pages of ``site_pages``. The headings themselves are the rows of ``site_headings``; ``lists`` adds lists of all of
    each level (a site's distinct headings are one row then), and a given number of ``headings`` adds lists of the first ones.

    Sizes add up over the pages, each with its label, so no site's text is put together.
    """
    label = F.concat(F.lit("\n\n---\n[추가 페이지: "), U.path(F.col("url")), F.lit("]\n"))
    part = F.when(F.col("is_main"), F.col("content")).otherwise(F.concat(label, F.col("content")))
    sized = P.content_metrics(pages.withColumn("content", part)).withColumn("chars", F.length("content"))
    sums = ["list_items", "tables", "images", "images_without_alt", "words", "chars", "long_blocks"]
    # stored, so that signals are read once from each page, for the sums and the headings
    sized = store(sized.select(key, "is_main", "place", "title", *sums, "text_ratio", "has_jsonld", "has_og", "h1_texts", "h2_texts"), "sized")
    merged = sized.groupBy(key).agg(
        F.min_by("title", "place").alias("title"),
        F.count(F.lit(1)).alias("page_count"),
        *[F.sum(c).alias(c) for c in sums],
        F.bool_or("has_jsonld").alias("has_jsonld"),
        F.bool_or("has_og").alias("has_og"),
        (F.sum(F.col("text_ratio") * F.col("chars")) / F.greatest(F.sum("chars"), F.lit(1))).alias("text_ratio"),
    )
    listing = lists or headings is not None
    distinct = _distinct_headings(sized, key)
    distinct = store(distinct, "headings") if listing else distinct
    counts = distinct.groupBy(key).agg(F.count_if(F.col("kind") == 0).alias("h1_count"), F.count_if(F.col("kind") == 1).alias("h2_count"))
    out = merged.join(counts, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("h1_count", "h2_count")})
    if not listing:
        return P.crawl_confidence(out)
    # the order of all is their place; only for the first ones do they have to be numbered
    first = distinct if headings is None else numbered(distinct, [key, "kind"], F.col("at"), F.col("heading"), limit=headings)
    order = "at" if headings is None else "n"
    listed = lambda k: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct(order, "heading")))), lambda x: x["heading"]
    )
    found = first.groupBy(key).agg(listed(0).alias("h1_texts"), listed(1).alias("h2_texts"))
    none = F.array().cast("array<string>")
    return P.crawl_confidence(out.join(found, key, "left").withColumns({c: F.coalesce(c, none) for c in ("h1_texts", "h2_texts")}))


def _fresh(pages: DataFrame, key: str) -> DataFrame:
    """Headings of extra pages that the main page lacks, with their first place."""
    rows = _heading_rows(pages, key, "h1_texts", "h2_texts")
    seen = rows.groupBy(key, "heading").agg(F.min("at").alias("at"), F.bool_or("is_main").alias("in_main"))
    return seen.filter(~F.col("in_main")).drop("in_main")


def site_gap(pages: DataFrame, key: str = "host") -> DataFrame:
    """What the extra pages add to the main page."""
    is_main = F.col("is_main")
    label = F.concat(F.lit("--- [추가 페이지: "), U.path(F.col("url")), F.lit("]"))
    own = T.word_count(F.col("content"))
    out = pages.groupBy(key).agg(
        F.count_if(~is_main).alias("extra_pages"),
        F.coalesce(F.sum(F.when(~is_main, own + T.word_count(label))), F.lit(0)).alias("added_words"),
        F.bool_or(is_main & F.col("has_jsonld")).alias("main_jsonld"),
        F.bool_or("has_jsonld").alias("any_jsonld"),
        F.bool_or(is_main & F.col("has_og")).alias("main_og"),
        F.bool_or("has_og").alias("any_og"),
    )
    fresh = _fresh(pages, key).groupBy(key).agg(F.count(F.lit(1)).alias("new_heading_count"))
    return out.join(fresh, key, "left").select(
        key,
        "extra_pages",
        "added_words",
        ((F.col("extra_pages") > 0) & (F.col("added_words") >= 50)).alias("meaningful"),
        (~F.col("main_jsonld") & F.col("any_jsonld")).alias("added_jsonld"),
        (~F.col("main_og") & F.col("any_og")).alias("added_og"),
        F.coalesce("new_heading_count", F.lit(0)).cast("bigint").alias("new_heading_count"),
    )


def new_headings(pages: DataFrame, key: str = "host", limit: int | None = None) -> DataFrame:
    """Headings of extra pages that the main page lacks, first seen first, up to ``limit`` per site when given."""
    ranked = numbered(_fresh(pages, key), [key], F.col("at"), F.col("heading"), name="rank", limit=limit)
    return ranked.select(key, "rank", "heading")


# Words that mark a sentence as saying what a site offers.
SNIPPET_SIGNALS = ["입니다", "제공", "진단", "서비스", "플랫폼", "설립", "대표", "고객", "기업", "ai", "profile", "optimization"]


def promoted_snippets(
    pages: DataFrame, key: str = "host", per_page: int | None = None, per_site: int | None = None, least_chars: int = 40
) -> DataFrame:
    """Useful sentences on extra pages that the main page does not hold.

    Sentences are judged inside their page's row; only useful ones meet the main page, by an equi join to its one row.
    """
    text = F.regexp_replace("content", "\n+", " ")
    cut = F.transform(F.split(text, f"(?<=[.!?。]|다\\.|요\\.){T.WS}+"), lambda x, i: F.struct(i.alias("pos"), T.squeeze(x).alias("sentence")))

    def useful(x: Column) -> Column:
        s = x["sentence"]
        return (
            (F.length(s) >= least_chars)
            & ~s.startswith("#")
            & ~s.rlike("(?i)^[qa][.:]")
            & s.rlike("[가-힣A-Za-z]")
            & T.contains_any(F.lower(s), SNIPPET_SIGNALS)
        )

    kept = F.when(~F.col("is_main"), F.filter(cut, useful)).otherwise(F.array().cast("array<struct<pos:int,sentence:string>>"))
    said = pages.select(key, "page_id", "url", "place", F.explode(kept).alias("x")).select(key, "page_id", "url", "place", "x.*")
    main = pages.filter("is_main").select(key, F.lower("content").alias("main_text"))
    fresh = said.join(main, key).filter(~F.contains(F.col("main_text"), F.lower("sentence"))).drop("main_text")
    by_page = Window.partitionBy(key, "page_id").orderBy("pos")
    if per_page is not None:
        fresh = fresh.withColumn("n", F.row_number().over(by_page)).filter(F.col("n") <= per_page)
    ranked = numbered(fresh, [key], F.col("place"), F.col("pos"), name="rank", limit=per_site)
    return ranked.select(key, "rank", U.path(F.col("url")).alias("source_path"), "sentence")


def best_rendering(direct: DataFrame, rendered: DataFrame, key: str = "page_id") -> DataFrame:
    """Better of the fetched and the rendered page; a strong fetched page wins outright, ties go to it."""
    d = direct.select(key, F.col("strong").alias("d_strong"), F.col("score").alias("d_score"))
    r = rendered.select(key, F.col("score").alias("r_score"))
    return d.join(r, key, "full_outer").select(
        key,
        F.when(F.col("d_strong"), "direct")
        .when(F.col("d_score").isNull(), "rendered")
        .when(F.col("r_score").isNull(), "direct")
        .when(F.col("d_score") >= F.col("r_score"), "direct")
        .otherwise("rendered")
        .alias("picked"),
        F.col("d_score").alias("direct_score"),
        F.col("r_score").alias("rendered_score"),
    )


# --- declared structure and lint -------------------------------------------------
def facts_labels(content: Column, head_chars: int | None = None) -> Column:
    """Distinct labels of 'label: value' lines."""
    lines = F.transform(F.split(T.head(content, head_chars), "\n+"), T.strip)

    def label(line: Column) -> Column:
        with_bullet = F.regexp_extract(line, f"^[-*]{T.WS}*([^:]{{1,30}}?){T.WS}*:{T.WS}*(?=[^{T.WS_SET}].)", 1)
        plain = F.regexp_extract(line, f"^([^:#]{{1,30}}?){T.WS}*:{T.WS}*(?=[^{T.WS_SET}].)", 1)
        return T.squeeze(F.when(line.rlike("^[-*]") & (with_bullet != ""), with_bullet).otherwise(plain))

    return F.array_distinct(F.filter(F.transform(lines, label), lambda x: x != ""))


QUESTION = f"(?im)(?:^|\\n){T.WS}*(?:q[.:]|q{T.WS}|- q[:.]|질문[:.]|문:){T.WS}+"
ANSWER = f"(?im)(?:^|\\n){T.WS}*(?:a[.:]|a{T.WS}|- a[:.]|답변[:.]|답:){T.WS}+"


def faq_structure(df: DataFrame) -> DataFrame:
    """FAQ heading, question/answer line patterns, FAQ JSON-LD (needs ``ld`` signals)."""
    heads = F.concat("h1_texts", "h2_texts")
    return df.withColumns(
        {
            "faq_heading": F.exists(heads, lambda h: h.rlike("(?i)faq|자주 묻는 질문")),
            "faq_lines": F.col("content").rlike(QUESTION) & F.col("content").rlike(ANSWER),
            "faq_jsonld": F.col("ld.faq_count") > 0,
        }
    )


def subpage_registry(df: DataFrame, head_chars: int | None = None) -> DataFrame:
    helpful = F.filter(
        "links", lambda u: T.let(F.lower(U.path(u)), lambda p: (p != "/") & (F.size(F.split(p, "/")) <= 4))
    )
    return df.withColumns(
        {
            "helpful_links": F.size(helpful).cast("bigint"),
            "subpage_heading": T.head(F.col("content"), head_chars).rlike(
                "(?i)(주요 페이지|핵심 페이지|related pages|important pages|subpages?)"
            ),
        }
    )


def with_jsonld(df: DataFrame) -> DataFrame:
    return df.withColumn("ld", J.signals(F.col("jsonld_blocks"), dims.JSONLD_FACT_KEYS))


def lint_inputs(signals: DataFrame) -> DataFrame:
    """Everything the lint needs that comes from the page itself."""
    out = P.entity_definition(P.indexability(with_jsonld(signals)))
    out = subpage_registry(faq_structure(out))
    return out.withColumn("fact_labels", F.size(facts_labels(F.col("content"))).cast("bigint"))


#: Columns of ``lint_inputs`` that ``page_lint`` reads beside the page's id, URL and site.
LINT_COLUMNS = ["title", "description", "page_source", "defines_entity", "fact_labels", "ld", "helpful_links", "allows_indexing", "faq_heading", "faq_lines", "faq_jsonld"]
CHECKS = ["entity-definition", "facts-source-structure", "static-rendering", "subpage-registry", "indexability", "faq-structure"]


def page_lint(inputs: DataFrame, bots: DataFrame, key: str = "host") -> DataFrame:
    """Five checks per page, a sixth where a FAQ exists: (page_id, check_id, status, blocking)."""
    df = inputs.join(bots.select(key, "bots_denied"), key, "left")
    facts, ld_facts = F.col("fact_labels"), F.col("ld.fact_field_count")
    profile = F.col("url").rlike("(?i)/ai-profile(/|$)?") | F.concat_ws(" ", "title", "description").rlike("(?i)ai profile")
    hub = (F.col("ld.has_part_count") > 0) | (F.col("ld.significant_link_count") > 0)
    denied = ~F.col("allows_indexing")
    direct, rendered = F.col("page_source") == "direct", F.col("page_source") == "rendered"

    def check(check_id: str, status: Column, blocking: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(check_id).alias("check_id"), status.alias("status"), blocking.alias("blocking"))
        return made if when is None else F.when(when, made)

    status = lambda ok, warn: F.when(ok, "pass").when(warn, "warn").otherwise("fail")
    checks = [
        check(CHECKS[0], F.when(F.col("defines_entity"), "pass").otherwise("fail"), ~F.col("defines_entity")),
        check(
            CHECKS[1],
            status((facts >= 4) | (ld_facts >= 6), (facts >= 2) | (ld_facts >= 3)),
            (facts < 2) & (ld_facts < 3),
        ),
        check(CHECKS[2], status(direct, rendered), ~direct & ~rendered),
        check(
            CHECKS[3],
            F.when((F.col("helpful_links") >= 2) & hub, "pass").when(profile, "fail").otherwise("warn"),
            profile & (F.col("helpful_links") < 2),
        ),
        check(
            CHECKS[4],
            F.when(denied, "fail").when(F.coalesce("bots_denied", F.lit(0)) > 0, "warn").otherwise("pass"),
            denied,
        ),
        check(
            CHECKS[5],
            F.lit("pass"),
            F.lit(False),
            reduce(lambda a, b: a | b, [F.col(c) for c in ("faq_heading", "faq_lines", "faq_jsonld")]),
        ),
    ]
    return df.select("page_id", "url", key, F.explode(F.array_compact(F.array(*checks))).alias("c")).select(
        "page_id", "url", key, "c.*"
    )


def lint_summary(lint: DataFrame) -> DataFrame:
    return lint.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("total_checks"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("pass", "warn", "fail")],
        F.count_if("blocking").alias("blocking_count"),
        (F.count_if(F.col("status") == "fail") == 0).alias("ready"),
    )


def crawl_evidence(inputs: DataFrame, bots: DataFrame, key: str = "host", few_words: int = 100) -> DataFrame:
    """Evidence flags per page that explain missed facts."""
    df = inputs.join(bots.select(key, "bots_denied"), key, "left")
    return df.select(
        "page_id",
        (F.coalesce("bots_denied", F.lit(0)) > 0).alias("robots_blocked"),
        (F.col("page_source") == "rendered").alias("js_rendered"),
        (~F.col("page_source").isin("direct", "rendered")).alias("no_static_html"),
        (T.word_count(F.col("content")) < few_words).alias("low_words"),
        (F.col("fact_labels") >= 2).alias("has_facts_block"),
        (~F.col("defines_entity")).alias("no_entity_sentence"),
    )
