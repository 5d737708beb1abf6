"""Is an answer about the right entity, and how accurate is it?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import text as T
from tellback.functions import urls as U
from tellback.operators.patterns import held_phrases
from tellback.operators.texts import phrase_hints, sentences_with

_EMPTY = "array<string>"


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_EMPTY))


def _service_hints(raw: Column, limit: int | None = None) -> Column:
    """Words of four or more letters that are no stop words."""
    words = F.split(F.lower(raw), f"[{T.WS_SET},.:;()\\-—/|]+")
    stop = T.literal_list(dims.STOP_WORDS)
    kept = F.filter(
        words, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w) & w.rlike("[a-z가-힣]")
    )
    return T.first(F.array_distinct(kept), limit)


def entity_hints(entities: DataFrame) -> DataFrame:
    """Strong, service, anchor and definition hints of an entity. Computed once per entity, before any join."""
    root = F.regexp_replace(F.col("domain"), "^www\\.", "")
    label = F.substring_index(root, ".", 1)
    df = entities.withColumns({"official_domain": F.lower(root), "root_label": label})
    names = F.concat(F.array("company_name", "title"), _list("aliases"))
    raw = F.concat_ws(" ", F.filter(F.concat(F.array("company_name", "title", "description"), _list("aliases")), lambda x: x != ""))
    parts = F.flatten(
        F.transform(
            F.concat(names, F.array(root, label)),
            lambda v: F.transform(F.split(F.lower(F.coalesce(v, F.lit(""))), "[|()\\-—,:/]+"), T.strip),
        )
    )
    strong = F.array_distinct(F.filter(parts, lambda p: (p != "") & ((F.length(p) >= 6) | (p == F.lower(F.col("root_label"))))))
    df = df.withColumns({"strong_hints": strong, "service_hints": _service_hints(raw)})
    anchors = F.array_distinct(
        F.filter(
            F.transform(
                F.concat(names, F.array("official_domain", F.lower("root_label")), F.col("strong_hints")),
                lambda v: F.lower(T.strip(F.coalesce(v, F.lit("")))),
            ),
            lambda v: F.length(v) >= 2,
        )
    )
    df = df.withColumn("anchor_terms", anchors)
    generic = T.literal_list(dims.GENERIC_TERMS)
    service = F.col("service_hints")
    first_words = F.array_join(F.slice(service, 1, 3), ", ")
    return df.withColumns(
        {
            "definition_hints": F.array_except(F.array_except(service, F.col("anchor_terms")), generic),
            "category_hint": T.first_text(first_words, F.col("title"), F.regexp_extract("description", "^([^.!?]*)", 1)),
            "exact_signals": F.filter(
                F.transform(F.concat(F.array("company_name", "domain"), _list("aliases")), lambda v: F.lower(v)),
                lambda v: F.length(v) >= 6,
            ),
            "archetype_text": F.concat_ws(" ", raw, F.array_join(service, " ")),
        }
    )


def verification_hints(hinted: DataFrame) -> DataFrame:
    """What the entity's own site says: years, e-mails, hosts, phrases, service words."""
    heads = F.concat(_list("h1_texts"), _list("h2_texts"))
    texts = T.distinct_strings(
        F.concat(
            F.array("title", "description", "snap_title", "snap_description"),
            heads,
            F.array("content_preview"),
            _list("jsonld_blocks"),
        )
    )
    said = F.array_join(texts, " ")
    wide = F.concat_ws(
        " ",
        F.filter(
            F.concat(
                F.array("company_name", "title", "snap_title", "description", "snap_description"), heads, _list("aliases")
            ),
            lambda x: x != "",
        ),
    )
    df = hinted.withColumn("_said", said)
    return df.withColumns(
        {
            "has_snapshot": F.col("_said") != "",
            "known_years": T.years(F.col("_said")),
            "known_emails": T.emails(F.col("_said")),
            "known_hosts": F.array_distinct(
                F.concat(F.array("official_domain"), U.mentioned_hosts(F.col("_said")))
            ),
            "known_phrases": phrase_hints(F.concat(F.array("snap_description"), heads, F.array("content_preview"))),
            "known_services": F.array_distinct(F.concat(F.col("service_hints"), _service_hints(wide))),
        }
    ).drop("_said")


def hint_matches(df: DataFrame, text: str = "text") -> DataFrame:
    """Which of the site's own hints an answer repeats; phrases and service words one by one, unless ``held_hints`` has found them."""
    said, low = F.col(text), F.lower(F.col(text))
    inside = lambda c: F.filter(c, lambda h: F.contains(low, F.lower(h)))
    known = {f"matched_{c}": inside(f"known_{c}") for c in ("phrases", "services") if f"matched_{c}" not in df.columns}
    return df.withColumns(
        known
        | {
            "matched_years": F.array_intersect(T.years(said), F.col("known_years")),
            "matched_emails": F.array_intersect(T.emails(said), F.col("known_emails")),
            "matched_hosts": F.array_intersect(U.mentioned_hosts(said), F.col("known_hosts")),
            "founding_claim": said.rlike("(?i)(설립|창립|founded)"),
            "contact_claim": said.rlike("(?i)(문의|연락|contact|email|e-mail)"),
        }
    )


#: Columns of ``held_hints`` and the lists of an entity that they come from.
HINTS = {
    "matched_phrases": "known_phrases", "matched_services": "known_services",
    "held_strong": "strong_hints", "held_exact": "exact_signals", "held_service": "service_hints",
}


def held_hints(answers: DataFrame, entities: DataFrame, key: str = "entity_id", text: str = "text") -> DataFrame:
    """Answers with all hints of their entity that they hold, by one automaton per entity: a pass over the answer, however many hints there are.

    For entities with long lists of hints; ``hint_matches`` and ``recognition_context`` take what it found.
    """
    return held_phrases(answers, entities.select(key, *HINTS.values()), key, text, HINTS)


def recognition_context(df: DataFrame, text: str = "text") -> DataFrame:
    low = F.lower(F.col(text))
    df = df.withColumn("low_text", low)
    t = F.col("low_text")
    uncertain = T.contains_any(t, dims.UNKNOWN_SIGNALS)
    any_of = lambda held, hints: F.when(t.isNotNull(), F.size(held) > 0) if held in df.columns else T.any_contains(t, F.col(hints))
    return df.withColumns(
        {
            "strong_match": any_of("held_strong", "strong_hints"),
            "exact_match": any_of("held_exact", "exact_signals"),
            "service_match": any_of("held_service", "service_hints"),
            "uncertain": uncertain,
            "specific_claims": (F.length(t) >= 120) & T.contains_any(t, dims.CLAIM_WORDS),
        }
    ).withColumn("hedged", ~F.col("uncertain") & T.contains_any(F.col("low_text"), dims.HEDGED_SIGNALS))


def fact_check(df: DataFrame, text: str = "text") -> DataFrame:
    """aligned / weak / domain_mismatch / service_mismatch / wrong_entity from domains, anchors and sentences."""
    t, own = F.col("low_text"), F.col("official_domain")
    official = lambda h: U.same_or_subdomain(h, own)
    df = df.withColumn("_hosts", U.mentioned_hosts(F.col(text)))
    terms = F.filter(
        F.array_distinct(F.concat(F.col("anchor_terms"), F.array("official_domain"))),
        lambda a: (a != "") & (F.contains(a, F.lit(".")) | (F.length(a) >= 6)),
    )
    df = df.withColumns(
        {
            "foreign_hosts": F.filter("_hosts", lambda h: ~official(h)),
            "_said_own": F.exists("_hosts", official),
            "matched_hints": F.filter("definition_hints", lambda h: F.contains(t, h)),
            "_sentences": T.sentences(F.col(text), True),
            "_terms": terms,
        }
    )
    hints, got = F.size("definition_hints"), F.size("matched_hints")
    df = df.withColumns(
        {
            "domain_signal": F.col("_said_own") | (F.col("citations_official") > 0),
            "service_defined": F.when(hints == 0, F.lit(None))
            .when(got == 0, False)
            .when((hints <= 2) | (got >= 2) | (got / hints >= 0.5), True),
            "anchored_sentences": sentences_with(F.col("_sentences"), F.col("_terms")),
            "foreign_sentences": sentences_with(F.col("_sentences"), F.col("foreign_hosts")),
            "_compares": (F.col("intent") == "comparison") & t.rlike(f"(?i)({dims.COMPARISON_CUE})"),
        }
    )
    df = df.withColumn(
        "anchored",
        F.col("domain_signal") | F.col("exact_match") | T.any_contains(t, F.col("_terms")) | (F.col("anchored_sentences") > 0),
    )
    df = df.withColumn("comparison_safe", F.col("_compares") & F.col("anchored"))
    foreign, anchored, claims = F.size("foreign_hosts") > 0, F.col("anchored"), F.col("specific_claims")
    dominant = foreign & (F.col("foreign_sentences") > 0) & (F.col("anchored_sentences") == 0) & ~anchored
    wrong = foreign & ~anchored & ~F.col("exact_match") & claims & (~F.col("comparison_safe") | dominant)
    off_domain = foreign & anchored & ~F.col("domain_signal") & claims & ~F.col("comparison_safe")
    denied = F.coalesce(F.col("service_defined") == F.lit(False), F.lit(False))
    off_service = denied & claims & ~F.col("uncertain") & ~F.col("_compares")
    defined = F.coalesce(F.col("service_defined"), F.lit(False))
    return df.withColumn(
        "verdict",
        F.when(wrong, "wrong_entity")
        .when(off_domain, "domain_mismatch")
        .when(off_service, "service_mismatch")
        .when(F.col("comparison_safe") | anchored | defined, "aligned")
        .otherwise("weak"),
    ).drop("_hosts", "_said_own", "_sentences", "_terms", "_compares")


def recognition_status(df: DataFrame) -> DataFrame:
    v = F.col("verdict")
    strong_or_exact = F.col("exact_match") | F.col("strong_match")
    defined = F.coalesce(F.col("service_defined"), F.lit(False))
    return df.withColumn(
        "match_status",
        F.when(F.col("uncertain"), "unknown")
        .when(v.isin("wrong_entity", "domain_mismatch", "service_mismatch"), "misidentified")
        .when((v == "aligned") & (F.col("comparison_safe") | F.col("anchored") | strong_or_exact), "recognized")
        .when((strong_or_exact | F.col("domain_signal")) & (F.col("service_match") | defined), "recognized")
        .when(F.col("specific_claims") & ~F.col("exact_match"), "misidentified")
        .otherwise("unknown"),
    )


def accuracy_score(df: DataFrame) -> DataFrame:
    """Fixed values for misidentified and unknown answers, else an additive score between 20 and 95."""
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    two = lambda c, many, one: F.when(F.size(c) >= 2, many).when(F.size(c) == 1, one).otherwise(0)
    chars = F.length("low_text")
    yrs, mails, hosts = F.size("matched_years") > 0, F.size("matched_emails") > 0, F.size("matched_hosts") > 0
    total = (
        points(F.col("verdict") == "aligned", 25)
        + points(F.coalesce(F.col("service_defined"), F.lit(False)), 20)
        + points(F.col("domain_signal"), 15)
        + points(F.col("citations_official") > 0, 5)
        + points(F.col("anchored"), 5)
        + points((F.col("mode") == "live_search") & (F.col("citations_total") > 0), 5)
        + points(yrs, 10)
        + points(mails, 8)
        + points(hosts, 6)
        + two("matched_phrases", 10, 5)
        + two("matched_services", 8, 4)
        + F.when(chars > 1000, 5).when(chars > 300, 3).otherwise(0)
        + F.when(F.col("founding_claim") & yrs, 2).when(F.col("founding_claim") & F.col("has_snapshot"), -3).otherwise(0)
        + points(F.col("has_snapshot") & F.col("contact_claim") & ~mails & ~hosts, -3)
    )
    status = F.col("match_status")
    return df.withColumn(
        "accuracy",
        F.when(status == "misidentified", 0)
        .when(status == "unknown", F.when(F.col("verdict") == "weak", 10).otherwise(5))
        .otherwise(F.greatest(F.lit(20), F.least(total, F.lit(95))))
        .cast("bigint"),
    )


def judge(joined: DataFrame) -> DataFrame:
    """Responses that carry citation metrics and their entity's hints, judged in one pass."""
    return accuracy_score(recognition_status(fact_check(recognition_context(hint_matches(joined)))))


def mention_position(df: DataFrame, text: str = "text") -> DataFrame:
    """Where the entity is first named: top, middle, bottom or none."""
    low = F.lower(F.col(text))
    names = F.filter(
        F.transform(F.concat(F.array("company_name", "title"), _list("aliases"), F.array("root_label")), lambda v: F.lower(v)),
        lambda v: F.length(v) >= 2,
    )
    at = F.array_min(F.filter(F.transform(names, lambda n: F.position(n, low)), lambda p: p > 0))
    ratio = F.floor((at - 1) / F.length(F.col(text)) * 100 + 0.5) / 100
    return df.withColumn("mention_ratio", ratio).withColumn(
        "mention_bucket",
        F.when(F.col("mention_ratio").isNull(), "none")
        .when(F.col("mention_ratio") <= 0.2, "top")
        .when(F.col("mention_ratio") <= 0.6, "middle")
        .otherwise("bottom"),
    )


def classifier_override(judged: DataFrame, overrides: DataFrame, keys: list[str], least: float = 0.55) -> DataFrame:
    """Apply a second classifier's JSON verdict where it is valid, sure enough and asked for."""
    doc = F.try_parse_json("verdict_json")
    get = lambda p, kind: F.try_variant_get(F.col("_d"), F.lit(f"$.{p}"), kind)
    second = overrides.withColumn("_d", doc).select(
        *keys,
        get("matchStatus", "string").alias("ai_status"),
        F.coalesce(get("misidentifiedSubtype", "string"), F.lit("none")).alias("ai_subtype"),
        get("confidence", "double").alias("ai_confidence"),
    )
    valid = (
        F.col("ai_status").isin("recognized", "unknown", "misidentified")
        & F.col("ai_subtype").isin("none", "wrong_entity", "domain_mismatch", "service_mismatch")
        & F.col("ai_confidence").isNotNull()
    )
    wanted = (
        (F.col("match_status") == "unknown")
        | (F.col("verdict") == "weak")
        | ((F.col("match_status") == "recognized") & F.col("hedged"))
    )
    sure = F.greatest(F.lit(0.0), F.least(F.col("ai_confidence"), F.lit(1.0))) >= least
    df = judged.join(second, keys, "left").withColumn(
        "override",
        F.when(~wanted, "not_asked").when(F.col("ai_status").isNull() | ~valid, "no_verdict").when(~sure, "low_confidence").otherwise("applied"),
    )
    on = F.col("override") == "applied"
    verdict = (
        F.when(F.col("ai_status") == "recognized", "aligned")
        .when(F.col("ai_status") == "unknown", "weak")
        .when(F.col("ai_subtype") == "none", "wrong_entity")
        .otherwise(F.col("ai_subtype"))
    )
    accuracy = (
        F.when(F.col("ai_status") == "misidentified", F.lit(0))
        .when(F.col("ai_status") == "unknown", F.least(F.col("accuracy"), F.lit(10)))
        .otherwise(F.greatest(F.col("accuracy"), F.lit(20)))
    )
    return df.select(
        *keys,
        "override",
        F.when(on, F.col("ai_status")).otherwise(F.col("match_status")).alias("match_status"),
        F.when(on, verdict).otherwise(F.col("verdict")).alias("verdict"),
        F.when(on, accuracy).otherwise(F.col("accuracy")).cast("bigint").alias("accuracy"),
    )


# --- tasks and query plans ----------------------------------------------------------
def task_grid(entities: DataFrame, chatgpt_recall: bool = False, key: str = "entity_id") -> DataFrame:
    """Every mode, intent and engine per entity with its kind: unsupported, skipped or candidate.

    The grid itself is a constant of eighteen cells, so each entity row is expanded in place.
    """
    cells = []
    for m, mode in enumerate(dims.MODES):
        for i, intent in enumerate(dims.INTENTS):
            for e, engine in enumerate(dims.ENGINE_ORDER):
                if (engine, mode) in dims.UNSUPPORTED:
                    kind = "unsupported"
                elif engine == "chatgpt" and mode == "strict_recall" and not chatgpt_recall:
                    kind = "skipped"
                else:
                    kind = "candidate"
                priority = dims.MODE_PRIORITY[(mode, intent)] + dims.ENGINE_PRIORITY[engine]
                cells.append((mode, intent, engine, kind, priority, m * 9 + i * 3 + e))
    names = ("mode", "intent", "engine", "kind", "priority", "cell")
    rows = ["named_struct(" + ", ".join(f"{T.quoted(n)}, {T.quoted(v)}" for n, v in zip(names, c)) + ")" for c in cells]
    return entities.selectExpr(key, "inline(array(" + ", ".join(rows) + "))")


def task_topk(grid: DataFrame, cached: DataFrame | None = None, most: int = 7, key: str = "entity_id") -> DataFrame:
    """Cached tasks are reused; the best ``most`` candidates of an entity run, the rest are skipped."""
    df = grid
    if cached is not None:
        hit = cached.select(key, "mode", "intent", "engine").distinct().withColumn("_hit", F.lit(True))
        df = df.join(hit, [key, "mode", "intent", "engine"], "left")
        df = df.withColumn("kind", F.when((F.col("kind") == "candidate") & F.col("_hit"), "cached").otherwise(F.col("kind"))).drop("_hit")
    # eighteen rows per entity at most
    w = Window.partitionBy(key, "kind").orderBy(F.desc("priority"), "cell")
    n = F.row_number().over(w)
    return df.withColumn(
        "status", F.when(F.col("kind") != "candidate", F.col("kind")).when(n <= most, "executed").otherwise("skipped")
    )


def task_budget(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("mode").agg(
        F.count_if(F.col("kind") == "candidate").alias("candidates"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("executed", "cached", "skipped", "unsupported")],
    )


def query_plan(hinted: DataFrame, key: str = "entity_id", most: int = 16) -> DataFrame:
    """Planned search queries per entity and intent: slot templates filled, empty ones dropped, distinct."""
    name = T.first_text(F.col("company_name"), F.col("official_domain"), F.col("root_label"), F.lit("이 회사"))
    services = F.array_join(F.slice("service_hints", 1, 3), " ")
    names = T.distinct_strings(
        F.concat(F.array("company_name", "title", "official_domain", F.lower("root_label")), _list("aliases"))
    )
    df = hinted.select(
        key,
        name.alias("name"),
        "official_domain",
        F.when(services != "", services).otherwise(F.col("category_hint")).alias("category"),
        F.coalesce(F.get(names, 1), F.lit("")).alias("anchor"),
    )
    fills = {"{name}": "name", "{domain}": "official_domain", "{category}": "category", "{anchor}": "anchor"}

    def filled(template: str) -> Column:
        out = F.lit(template)
        for mark, col in fills.items():
            if mark in template:
                out = F.replace(out, F.lit(mark), F.col(col))
        if "{domain}" in template:
            out = F.when(F.col("official_domain") == "", "").otherwise(out)
        return T.strip(out)

    def queries(intent: str) -> Column:
        rows = [
            F.struct(filled(t).alias("query"), F.lit(slot.split("_")[0]).alias("slot"))
            for slot in dims.INTENT_SLOTS[intent]
            for t in dims.QUERY_SLOTS[slot]
        ]
        usable = F.filter(F.array(*rows), lambda r: r["query"] != "")
        texts = lambda u: F.transform(u, lambda r: r["query"])
        first = lambda u: F.filter(u, lambda r, i: F.array_position(texts(u), r["query"]) == i + 1)
        return F.slice(T.let(usable, first), 1, most)

    plans = [
        df.select(key, F.lit(intent).alias("intent"), F.posexplode(queries(intent)).alias("pos", "q"))
        for intent in dims.INTENTS
    ]
    out = plans[0]
    for more in plans[1:]:
        out = out.unionByName(more)
    return out.select(key, "intent", (F.col("pos") + 1).cast("bigint").alias("query_no"), "q.slot", "q.query")


def prompt_batch(texts: DataFrame, key: str, templates: list[str], most: int = 24_000) -> DataFrame:
    """Prompt rows: text cut to an engine's input size with a marker, template picked by a stable hash."""
    body = T.strip(F.col("text"))
    cut = F.length(body) > most
    pick = (T.hash31(F.col(key).cast("string")) % len(templates)).cast("int")
    return texts.select(
        key,
        F.length(body).cast("bigint").alias("input_chars"),
        cut.alias("truncated"),
        F.get(F.array(*[F.lit(t) for t in templates]), pick).alias("template"),
        F.when(cut, F.concat(F.substring(body, 1, most), F.lit("\n\n[TRUNCATED]"))).otherwise(body).alias("input"),
    )


# --- roll-up ----------------------------------------------------------------------
def answer_summary(judged: DataFrame) -> DataFrame:
    """Roll-up by mode and by mode and intent over supported answers.

    Counting metrics need one pass over grouping sets; distinct search queries
    are counted on exploded rows beside it.
    """
    rows = judged.filter(~F.col("status").isin("unsupported", "skipped"))
    sets = [["mode"], ["mode", "intent"]]
    n = F.count(F.lit(1))
    has = lambda c: F.count_if(c)
    share = lambda c: F.round(has(c) / n, 4)
    one_of = lambda c, values, tag: [has(F.col(c) == v).alias(f"{tag}_{v}") for v in values]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], "mode", "intent").agg(
        n.alias("supported"),
        has(F.col("grounded")).alias("grounded"),
        share(F.col("grounded")).alias("grounded_coverage"),
        has(F.col("citations_official") > 0).alias("with_official"),
        share(F.col("citations_official") > 0).alias("official_coverage"),
        F.sum("citations_total").alias("total_citations"),
        F.sum("citations_official").alias("official_citations"),
        F.round(F.try_divide(F.sum("citations_official"), F.sum("citations_total")), 4).alias("official_citation_ratio"),
        has(F.col("coverage_status").isin("strong", "partial")).alias("fan_out_observed"),
        has(F.col("coverage_status") == "opaque").alias("fan_out_opaque"),
        F.round(F.avg(F.when(F.col("coverage_ratio") > 0, F.col("coverage_ratio"))), 4).alias("fan_out_average"),
        *one_of("source_mix", ["official_only", "mixed", "third_party_only", "none"], "mix"),
        *one_of("fit_status", ["strong", "official_gap", "off_pattern", "mixed", "none"], "fit"),
        *one_of("verdict", ["aligned", "weak", "domain_mismatch", "service_mismatch", "wrong_entity"], "fact"),
        F.round(F.avg("authority_average"), 4).alias("authority_average"),
        F.round(F.avg("fit_average"), 4).alias("fit_average"),
        F.sum("tier_high").alias("tier_high"),
        F.sum("tier_medium").alias("tier_medium"),
        F.sum("tier_low").alias("tier_low"),
        share(F.size("search_queries") > 0).alias("query_metadata_coverage"),
        share(F.col("verdict") == "aligned").alias("fact_alignment_coverage"),
    )

    def dominant(tag: str, order: list[str]) -> Column:
        counts = [F.struct(F.col(f"{tag}_{v}").alias("n"), F.lit(-i).alias("o"), F.lit(v).alias("v")) for i, v in enumerate(order)]
        best = F.array_max(F.array(*counts))
        return F.when(best["n"] > 0, best["v"]).otherwise("none")

    out = out.withColumns(
        {
            "mix_dominant": dominant("mix", ["official_only", "mixed", "third_party_only"]),
            "fit_dominant": dominant("fit", ["strong", "official_gap", "off_pattern", "mixed"]),
            "tier_dominant": dominant("tier", ["high", "medium", "low"]),
        }
    )
    said = rows.select("mode", "intent", F.explode("search_queries").alias("q"))
    distinct = said.groupingSets([[F.col(c) for c in s] for s in sets], "mode", "intent").agg(
        F.count_distinct("q").alias("search_query_count")
    )
    named = lambda df: df.withColumn("intent", F.coalesce("intent", F.lit("*")))
    return named(out).join(named(distinct), ["mode", "intent"], "left").withColumn(
        "search_query_count", F.coalesce("search_query_count", F.lit(0))
    )
