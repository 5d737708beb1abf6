"""Answer evaluation: which declared facts reached an answer, and why others did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import jsonld as J
from tellback.functions import text as T
from tellback.functions import urls as U

# Phrases that say a fact was not found, and lines that begin another field.
NEGATIVE = f"(?i)찾지{T.WS}*못|확인할?{T.WS}*수{T.WS}*없|not{T.WS}*found|없음|n/a"
OTHER_FIELD = "\\*\\*[^*]+\\*\\*\\s*:|[-*]\\s*\\*\\*[^*]+\\*\\*\\s*:|^[a-z_ ]+\\s*:|^[가-힣A-Za-z ]+\\s*:"
YEARS_SINCE = "18|19|20"


# --- field comparison --------------------------------------------------------------
def same_scalar(field: Column, truth: Column, found: Column) -> Column:
    """Per-field match rule. ``truth`` / ``found`` hold cmp (comparable text), tok (tokens) and yrs (years)."""
    share = T.token_share(truth["tok"], found["tok"])
    inside = T.hold_each_other(truth["cmp"], found["cmp"])
    year = F.arrays_overlap(truth["yrs"], found["yrs"])
    return (
        F.when(field == "founded", year)
        .when(field.isin("description", "unique_value"), (share >= 0.35) | inside)
        .when(field.isin("entity_type", "headquarters"), (share >= 0.4) | inside)
        .when(field.isin("employee_count", "revenue"), year | inside)
        .otherwise(inside | (share >= 0.5))
    )


def measured(col: Column, korean: bool) -> Column:
    """Comparable text, tokens and years of a value, computed once."""
    return T.let(
        T.comparable(col, korean),
        lambda c: F.struct(c.alias("cmp"), T.tokens(c).alias("tok"), T.years(col, YEARS_SINCE).alias("yrs")),
    )


def fuzzy_any(left: Column, right: Column) -> Column:
    """Does any item of one list hold, or share 40% of its tokens with, any item of the other?"""
    pair = lambda a, b: T.hold_each_other(a["cmp"], b["cmp"]) | (T.token_share(a["tok"], b["tok"]) >= 0.4)
    return F.exists(left, lambda a: F.exists(right, lambda b: pair(a, b)))


# --- extractions --------------------------------------------------------------------
def extraction_parse(raw: DataFrame, keys: list[str], text: str = "raw_text") -> DataFrame:
    """Twelve fields of a model's JSON answer as rows: (field, values, state)."""
    body = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "(?i)```json\\s*|```", ""))
    inner = F.regexp_extract(body, "(?s)\\{.*\\}", 0)
    parsed = raw.withColumn("_doc", F.try_parse_json(F.when(inner != "", inner).otherwise(body)))
    doc = F.col("_doc")

    def values(field: str) -> Column:
        at = lambda kind, tail="": F.try_variant_get(doc, F.lit(f"$.{field}{tail}"), kind)
        if field in dims.ARRAY_FIELDS:
            items = F.coalesce(at("array<string>"), at("array<string>", ".value"))
            return T.let(
                F.filter(F.transform(items, lambda v: T.strip(F.coalesce(v, F.lit("")))), lambda v: v != ""),
                lambda x: F.when(F.size(x) > 0, x),
            )
        scalar = T.null_if_blank(F.coalesce(at("string", ".value"), F.when(~F.coalesce(at("string"), F.lit("")).startswith("{"), at("string"))))
        return F.when(scalar.isNotNull(), F.array(scalar))

    rows = F.array(*[F.struct(F.lit(f).alias("field"), values(f).alias("values")) for f in dims.FIELDS])
    out = parsed.select(*keys, doc.isNull().alias("broken"), F.explode(rows).alias("r")).select(*keys, "broken", "r.*")
    return out.withColumn(
        "state", F.when(F.col("broken"), "error").when(F.col("values").isNotNull(), "present").otherwise("missing")
    )


def extraction_rates(parsed: DataFrame, keys: list[str]) -> DataFrame:
    present = F.count_if(F.col("state") == "present")
    return parsed.groupBy(*keys).agg(
        F.when(F.bool_or("broken"), "error").otherwise("success").alias("status"),
        present.alias("fields_present"),
        F.round(present / len(dims.FIELDS), 3).alias("extraction_rate"),
    )


def delivery_eval_extracted(truth: DataFrame, parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Truth rows against extracted values of the same page and field (equi join)."""
    got = parsed.select(*keys, "field", F.col("values").alias("found"), "broken")
    both = truth.select("page_id", "field", "values", "source").join(got, ["page_id", "field"])
    found = F.coalesce("found", F.array().cast("array<string>"))
    many = F.col("field").isin(dims.ARRAY_FIELDS)
    measure = lambda items: F.transform(items, lambda v: measured(v, False))
    one = lambda items: measured(F.get(items, 0), False)
    matched = F.when(many, fuzzy_any(measure(F.col("values")), measure(found))).otherwise(
        T.let(one(F.col("values")), lambda a: T.let(one(found), lambda b: same_scalar(F.col("field"), a, b)))
    )
    return both.select(
        *keys, "field", "source", "values", "found", "broken",
        ((F.size(found) > 0) & F.coalesce(matched, F.lit(False))).alias("matched"),
    )


def delivery_rates(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    return evaluated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("truth_fields"),
        F.count_if("matched").alias("matched_fields"),
        F.round(F.count_if("matched") / F.count(F.lit(1)), 3).alias("delivery_rate"),
    )


# --- free-text answers -----------------------------------------------------------------
def negative_context(text: Column, field: Column) -> Column:
    """Does the answer say it did not find this field, on the line that names it or the next one?

    A line that names another field does not count as the next one. Field names
    hold no line break, so whatever occurs in the text occurs on a line.
    """
    lists = [f"{T.quoted(f)}, array({', '.join(T.quoted(n) for n in ns)})" for f, ns in dims.FIELD_MENTIONS.items()]
    names = F.expr("map(" + ", ".join(lists) + ")")
    wanted = F.concat(
        F.coalesce(names[field], F.array().cast("array<string>")), F.array(F.replace(field, F.lit("_"), F.lit(" ")), field)
    )

    def on_lines(lines: Column) -> Column:
        def hit(line: Column, i: Column) -> Column:
            after = F.coalesce(F.get(lines, i + 1), F.lit(""))
            below = (T.strip(after) != "") & ~T.strip(after).rlike(OTHER_FIELD) & after.rlike(NEGATIVE)
            return (line.rlike(NEGATIVE) | below) & T.any_contains(F.lower(line), wanted)

        return F.exists(F.transform(lines, hit), lambda x: x)

    # most answers have no such phrase at all
    return text.rlike(NEGATIVE) & T.let(F.split(text, "\\r?\\n"), on_lines)


def truth_per_page(truth: DataFrame) -> DataFrame:
    """Truth rows of a page as one list (a dozen fields at most), measured once per page."""
    rows = truth.withColumn("items", F.transform("values", lambda v: measured(v, True)))
    row = F.struct("field", "values", "source", "sources", "items")
    return rows.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("truth"))


def delivery_eval_text(
    responses: DataFrame, truth: DataFrame, keys: list[str], alternates: DataFrame | None = None
) -> DataFrame:
    """One row per answer and declared field: delivered or not.

    The join is on page, with a bounded truth list on one side, so each answer
    text crosses the network once; its tokens are made once, before the explode.
    """
    joined = responses.join(truth_per_page(truth), "page_id")
    if alternates is not None:
        joined = joined.join(alternates, "page_id", "left")
    else:
        joined = joined.withColumn("alternate_names", F.lit(None).cast("array<string>"))
    names = F.transform(F.coalesce("alternate_names", F.array().cast("array<string>")), lambda n: T.comparable(n))
    measured_once = joined.select(
        *keys,
        "text",
        "truth",
        measured(F.col("text"), True).alias("said"),
        F.filter(names, lambda n: n != "").alias("names"),
    )
    staged = measured_once.select(*keys, "text", "said", "names", F.explode("truth").alias("t"))
    field, said = F.col("t.field"), F.col("said")
    in_text = lambda c: (c != "") & F.contains(said["cmp"], c)
    any_item = F.exists("t.items", lambda i: in_text(i["cmp"]) | (T.token_share(i["tok"], said["tok"]) >= 0.4))
    first = F.get("t.items", 0)
    scalar = T.let(first, lambda i: in_text(i["cmp"]) | same_scalar(field, i, said))
    by_name = field.isin("entity_name", "ceo_or_leader") & F.exists("names", in_text)
    hit = F.when(field.isin(dims.ARRAY_FIELDS), any_item).otherwise(scalar | by_name)
    return staged.select(
        *keys,
        field.alias("field"),
        F.col("t.source").alias("source"),
        F.col("t.sources").alias("sources"),
        (~negative_context(F.col("text"), field) & F.coalesce(hit, F.lit(False))).alias("delivered"),
    )


def delivery_summary(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    return evaluated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("declared"),
        F.count_if("delivered").alias("delivered"),
        F.round(F.count_if("delivered") / F.count(F.lit(1)), 3).alias("delivery_rate"),
    )


def faq_delivery(responses: DataFrame, pairs: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    said = responses.select("page_id", *[k for k in keys if k != "page_id"], T.tokens(T.comparable(F.col("text"))).alias("said"))
    own = pairs.select("page_id", "pair_no", "question", T.comparable(F.col("answer")).alias("cmp"))
    got = own.withColumn("tok", T.tokens(F.col("cmp"))).join(said, "page_id")
    return got.select(
        *keys, "pair_no", "question",
        ((F.col("cmp") != "") & (T.token_share(F.col("tok"), F.col("said")) >= share)).alias("delivered"),
    )


def missed_cause(missed: DataFrame) -> DataFrame:
    """First rule that explains a missed field: access, rendering, sparse text, where it was declared."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    ld = F.array_contains("sources", "jsonld")
    block = F.array_contains("sources", "official_facts_block")
    signal = (
        F.when(flag("robots_blocked"), "robots_blocked")
        .when(flag("no_static_html"), "no_static_html")
        .when(flag("js_rendered"), "js_rendering_only")
        .when(flag("low_words"), "content_sparse")
        .when(ld & (block | flag("has_facts_block")), "dual_source_missed")
        .when(ld, "jsonld_only")
        .when(block, "facts_block_only")
        .otherwise("unknown")
    )
    out = missed.withColumn("signal", signal)
    s = F.col("signal")
    return out.withColumn(
        "confidence",
        F.when(s.isin("robots_blocked", "no_static_html"), "high")
        .when(s.isin("js_rendering_only", "content_sparse"), "medium")
        .otherwise("low"),
    )


# --- hints, citations, sub-pages ----------------------------------------------------------
def citation_match_level(responses: DataFrame, keys: list[str]) -> DataFrame:
    """exact / path / host_only / none: the best level any citation reaches.

    The level is the best of all citations, so citation order does not matter.
    """
    own, path = U.bare_host(F.col("url")), F.coalesce(U.trimmed_path(F.col("url")), F.lit(""))
    rank = lambda c: T.let(
        F.struct(U.bare_host(c).alias("h"), F.coalesce(U.trimmed_path(c), F.lit("")).alias("p")),
        lambda x: F.when((x["h"] == "") | (x["h"] != F.col("_host")), 3)
        .when(x["p"] == F.col("_path"), 0)
        .when(F.startswith(x["p"], F.col("_path")) | F.startswith(F.col("_path"), x["p"]), 1)
        .otherwise(2),
    )
    staged = responses.withColumns({"_host": own, "_path": path})
    best = F.coalesce(F.array_min(F.transform("citations", rank)), F.lit(3))
    level = F.element_at(F.array(*[F.lit(x) for x in ("exact", "path", "host_only", "none")]), best + 1)
    return staged.select(*keys, level.alias("citation_level"), (best < 3).alias("cited_official"))


def subpage_reach(subpages: DataFrame, answers: DataFrame, keys: list[str], reach: int | None = None) -> DataFrame:
    """Did an engine reach each sub-page? Equi join on the site, then rules on the answer near its mention.

    ``reach`` is how far behind the first mention the rules look; to the end, and so at later mentions too, unless given.
    """
    subs = subpages.select(
        "page_id", "sub_url", F.lower(F.col("sub_url")).alias("_u"), F.lower(U.path(F.col("sub_url"))).alias("_p"),
        U.bare_host(F.col("sub_url")).alias("_h"), U.trimmed_path(F.col("sub_url")).alias("_tp"),
    )
    said = answers.select(
        "page_id", *[k for k in keys if k != "page_id"], F.lower("text").alias("_t"),
        F.transform("citations", lambda c: F.struct(U.bare_host(c).alias("h"), U.trimmed_path(c).alias("p"), F.lower(c).alias("raw"))).alias("_c"),
    )
    df = subs.join(said, "page_id")
    by_url, by_path = F.position(F.col("_u"), F.col("_t")), F.position(F.col("_p"), F.col("_t"))
    at = F.when(by_url > 0, by_url).otherwise(by_path)
    df = df.withColumn("_near", F.when(at > 0, F.substring(F.col("_t"), at, F.lit(reach) if reach else F.length("_t"))).otherwise(""))
    near = F.col("_near")
    fail = near.rlike("접근 ?실패")
    good = near.rlike("접근 ?성공") | (F.contains(near, F.lit("제목:")) & ~F.contains(near, F.lit("접근실패")))
    cited = F.exists(
        "_c",
        lambda c: F.when(c["h"] == "", F.contains(c["raw"], F.col("_p"))).otherwise(
            (c["p"] == F.col("_tp")) & (c["h"] == F.col("_h"))
        ),
    )
    summary = (F.length(near) > 30) & ~good & ~fail & (near.rlike("요약:|내용:") | (F.length(near) > 100))
    df = df.withColumn(
        "evidence",
        F.when(cited, "citation_match")
        .when(good, "structured_response")
        .when(fail, "structured_fail")
        .when(summary, "content_summary")
        .otherwise("not_mentioned"),
    )
    reached = (
        F.when(F.col("evidence").isin("citation_match", "structured_response"), "yes")
        .when(F.col("evidence") == "content_summary", "uncertain")
        .otherwise("no")
    )
    cause = (
        F.when(fail & near.rlike("차단|block|403|robot|disallow"), "blocked")
        .when(fail & near.rlike("404|not found|찾을 수 없"), "missing_page")
        .when(reached == "no", "not_reached")
        .when(reached == "uncertain", "unclear")
    )
    return df.select(*keys, "sub_url", "evidence", reached.alias("reached"), cause.alias("cause"))
