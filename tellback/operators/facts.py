"""Declared facts: facts blocks, JSON-LD, infoboxes, FAQ pairs -> long truth rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellback import dims
from tellback.functions import jsonld as J
from tellback.functions import text as T
from tellback.operators.pages import infobox_rows

FACTS, JSONLD = "official_facts_block", "jsonld"
ITEM_CUT = ",|·|/| 및 | and "
_ENTRY = "array<struct<field:string,values:array<string>>>"


def field_of_label(label: Column) -> Column:
    """Fact field of a label: exact alias, else the first alias among its /, | or · segments."""
    table = dims.alias_map()
    parts = lambda n: F.transform(F.split(n, f"{T.WS}*[/|·]{T.WS}*"), lambda s: F.trim(s))
    hits = lambda n: F.filter(F.transform(parts(n), lambda s: table[s]), lambda f: f.isNotNull())
    return T.let(T.squeeze(F.lower(label)), lambda n: F.coalesce(table[n], F.get(hits(n), 0)))


def normal_values(field: Column, value: Column, limits: dict[str, int] | None = None, item_chars: int | None = None, items: int | None = None) -> Column:
    """Accepted value(s) of a field as a list, NULL when the value is empty.

    ``limits`` (such as ``dims.MAX_VALUE_LENGTH``) refuses longer values by field, ``item_chars`` longer items of a list,
    ``items`` longer lists. None of them applies unless given.
    """
    most = T.literal_map((limits or {"": 0}).items())

    def as_list(v: Column) -> Column:
        kept = F.filter(
            F.transform(F.split(v, ITEM_CUT), T.strip), lambda i: (i != "") & (F.length(i) <= item_chars if item_chars else F.lit(True))
        )
        return T.let(kept, lambda x: F.when((F.size(x) >= 1) & (F.size(x) <= items if items else F.lit(True)), x))

    def accept(v: Column) -> Column:
        scalar = F.when(~F.coalesce(F.length(v) > most[field], F.lit(False)), F.array(v)) if limits else F.array(v)
        return F.when((v == "") | field.isNull(), F.lit(None)).when(
            field.isin(dims.ARRAY_FIELDS), as_list(v)
        ).otherwise(scalar)

    return T.let(T.squeeze(F.regexp_replace(value, f"^[\\-*•·{T.WS_SET}]+", "")), accept)


def _entry(field: Column, values: Column) -> Column:
    return F.struct(field.alias("field"), values.alias("values"))


def _one_per_field(entries: Column, last: bool) -> Column:
    """First or last entry of each field; at most as many as there are fields."""
    fields = lambda e: F.array_distinct(F.transform(e, lambda x: x["field"]))
    pick = -1 if last else 1
    return T.let(
        entries,
        lambda e: F.transform(
            fields(e), lambda f: F.try_element_at(F.filter(e, lambda x: x["field"] == f), F.lit(pick))
        ),
    )


def _valid(entries: Column) -> Column:
    return F.filter(entries, lambda e: e["field"].isNotNull() & e["values"].isNotNull())


LABEL_LINE = f"^[-*]?{T.WS}*([^:：]{{1,60}}){T.WS}*[:：]{T.WS}*(.+)$"


def block_from_lines(content: Column, **cuts) -> Column:
    """Runs of two or more 'label: value' lines. A line without a colon ends a run,
    an unknown label does not; a later value of a field wins.

    Runs are cut by text markers inside the row, so no window or shuffle is needed.
    """
    lines = F.filter(F.transform(F.split(content, "\n+"), T.strip), lambda s: s != "")
    marked = F.array_join(F.transform(lines, lambda s: F.when(s.rlike(LABEL_LINE), s).otherwise("\u0002")), "\u0001")
    runs = F.transform(
        F.split(marked, "\u0002"), lambda run: F.filter(F.split(run, "\u0001"), lambda s: s != "")
    )

    def entry(line: Column) -> Column:
        return T.let(
            field_of_label(F.regexp_extract(line, LABEL_LINE, 1)),
            lambda f: _entry(f, normal_values(f, F.regexp_extract(line, LABEL_LINE, 2), **cuts)),
        )

    kept = F.filter(F.transform(runs, lambda r: _valid(F.transform(r, entry))), lambda r: F.size(r) >= 2)
    return _one_per_field(F.flatten(kept), last=True)


def _label_alternation() -> str:
    aliases = sorted((a for a, _ in dims.alias_rows()), key=len, reverse=True)
    return "|".join(re.escape(a).replace("\\ ", " ") for a in aliases)


def _from_window(window: Column, **cuts) -> Column:
    """Label/value pairs of running text; a value ends where the next label starts."""
    marked = F.regexp_replace(window, f"(?i)({_label_alternation()}){T.WS}*[:：]{T.WS}*", "\u0001$1\u0002")
    pieces = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))

    def entry(piece: Column) -> Column:
        return T.let(
            field_of_label(F.substring_index(piece, "\u0002", 1)),
            lambda f: _entry(f, normal_values(f, F.regexp_extract(piece, "(?s)\u0002(.*)$", 1), **cuts)),
        )

    return T.let(
        _one_per_field(_valid(F.transform(pieces, entry)), last=False),
        lambda e: F.when(F.size(e) >= 2, e).otherwise(F.array().cast(_ENTRY)),
    )


def block_inline(content: Column, reach: int | None = None, **cuts) -> Column:
    """Facts written as running text. The stretch after a facts heading is tried first, then the whole text.

    Without ``reach`` a stretch goes to the end of the text; the first heading's then holds all others.
    """
    anchors = "|".join(dims.FACT_ANCHORS)

    def windows(text: Column) -> Column:
        if reach is None:
            rest = F.regexp_extract(text, f"(?is)((?:{anchors}).*)$", 1)
            return F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))
        pieces = F.split(F.regexp_replace(text, f"(?i)({anchors})", "\u0003$1"), "\u0003")
        # every piece holds its heading, so this many pieces always fill the reach
        enough = reach // min(len(a) for a in dims.FACT_ANCHORS) + 1
        return T.let(
            pieces,
            lambda p: F.transform(
                F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
                lambda _, i: F.substring(F.array_join(F.slice(p, i + 2, enough), ""), 1, reach),
            ),
        )

    def best(text: Column) -> Column:
        anchored = F.filter(F.transform(windows(text), lambda w: _from_window(w, **cuts)), lambda e: F.size(e) >= 2)
        return F.coalesce(F.get(anchored, 0), _from_window(text, **cuts))

    return T.let(T.squeeze(content), best)


def facts_block(content: Column, **cuts) -> Column:
    """Line facts override inline facts. ``cuts`` are those of ``normal_values``."""

    def merge(lines: Column, inline: Column) -> Column:
        known = F.transform(lines, lambda e: e["field"])
        return F.concat(lines, F.filter(inline, lambda e: ~F.array_contains(known, e["field"])))

    return T.let(block_from_lines(content, **cuts), lambda a: T.let(block_inline(content, **cuts), lambda b: merge(a, b)))


def explode_entries(df: DataFrame, entries: Column, key: str = "page_id") -> DataFrame:
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.field", "e.values")


# --- ground truth ----------------------------------------------------------------
def _doc_text(doc: Column, path: str) -> Column:
    return F.nullif(F.trim(F.coalesce(J.text(doc, path), F.lit(""))), F.lit(""))


def _doc_value(field: str, doc: Column) -> Column:
    """Value list a JSON-LD document declares for a field, NULL when none."""
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    if field == "entity_name":
        name = _doc_text(doc, "$.name")
        titled = F.contains(name, F.lit("|")) | F.contains(name, F.lit(" - ")) | (F.length(name) > 60)
        return one(F.when(~titled, name))
    if field == "ceo_or_leader":
        plain = F.when(~F.coalesce(J.text(doc, "$.founder"), F.lit("")).startswith("{"), _doc_text(doc, "$.founder"))
        return one(F.coalesce(_doc_text(doc, "$.founder.name"), plain))
    if field == "headquarters":
        return one(F.coalesce(_doc_text(doc, "$.address.addressLocality"), _doc_text(doc, "$.address.addressRegion")))
    if field == "key_products":
        many = F.coalesce(
            F.try_variant_get(doc, F.lit("$.knowsAbout"), "array<variant>"),
            F.array(F.try_variant_get(doc, F.lit("$.knowsAbout"), "variant")),
        )
        names = F.transform(
            many,
            lambda v: F.coalesce(
                F.try_variant_get(v, F.lit("$.name"), "string"), F.try_variant_get(v, F.lit("$"), "string"), F.lit("")
            ),
        )
        return T.let(F.filter(F.transform(names, lambda n: F.trim(n)), lambda x: x != ""), lambda x: F.when(F.size(x) > 0, x))
    path = {"description": "$.description", "founded": "$.foundingDate", "entity_type": "$.serviceType"}[field]
    return one(_doc_text(doc, path))


# The JSON-LD property that declares a field.
JSONLD_PROPERTY = {
    "entity_name": "$.name",
    "description": "$.description",
    "founded": "$.foundingDate",
    "ceo_or_leader": "$.founder",
    "entity_type": "$.serviceType",
    "headquarters": "$.address",
    "key_products": "$.knowsAbout",
}


def eligible(docs: Column) -> Column:
    wanted = T.literal_list(dims.ENTITY_JSONLD_TYPES)
    return F.filter(docs, lambda d: F.arrays_overlap(J.types(d), wanted))


def ground_truth(pages: DataFrame, key: str = "page_id", **cuts) -> DataFrame:
    """One row per page and declared field: (values, source, sources).

    The facts block comes first; eligible JSON-LD documents fill the gaps in
    document order, or confirm a block value by being added to its sources. ``cuts`` (see
    ``normal_values``) refuse values that are too long.
    """
    staged = pages.select(
        key,
        facts_block(F.col("content"), **cuts).alias("block"),
        eligible(J.graph_or_self(F.col("jsonld_blocks"))).alias("docs"),
    )
    no_values = F.lit(None).cast("array<string>")

    def row(field: str) -> Column:
        from_block = F.get(F.filter("block", lambda e: e["field"] == field), 0)["values"]
        if field not in JSONLD_PROPERTY:
            from_docs, confirmed = no_values, F.lit(False)
        else:
            found = F.filter(F.transform("docs", lambda d: _doc_value(field, d)), lambda v: v.isNotNull())
            from_docs = F.get(found, 0)
            confirmed = (
                F.size(found) > 0
                if field == "headquarters"
                else F.exists("docs", lambda d: F.coalesce(J.text(d, JSONLD_PROPERTY[field]), F.lit("")) != "")
            )
        return F.struct(
            F.lit(field).alias("field"),
            F.coalesce(from_block, from_docs).alias("values"),
            F.when(from_block.isNotNull(), FACTS).otherwise(JSONLD).alias("source"),
            F.when(from_block.isNotNull() & confirmed, F.array(F.lit(FACTS), F.lit(JSONLD)))
            .when(from_block.isNotNull(), F.array(F.lit(FACTS)))
            .otherwise(F.array(F.lit(JSONLD)))
            .alias("sources"),
        )

    rows = F.filter(F.array(*[row(f) for f in dims.FIELDS]), lambda r: r["values"].isNotNull())
    return staged.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def alternate_names(pages: DataFrame, key: str = "page_id") -> DataFrame:
    docs = eligible(J.graph_or_self(F.col("jsonld_blocks")))
    names = F.flatten(F.transform(docs, lambda d: F.transform(J.strings(d, "$.alternateName"), lambda n: F.trim(n))))
    return pages.select(key, F.filter(names, lambda n: n != "").alias("alternate_names"))


def _box_value(box: Column, field: str) -> Column:
    """Last value of the first infobox key that answers the field."""
    values = [
        F.nullif(F.trim(F.try_element_at(F.filter(box, lambda p: p["key"] == k), F.lit(-1))["value"]), F.lit(""))
        for k in dims.INFOBOX_KEYS[field]
    ]
    return F.coalesce(*values)


def ground_truth_infobox(pages: DataFrame, key: str = "page_id", title: str = "org_name") -> DataFrame:
    """Truth of encyclopedia pages: title, infobox values, definition sentence."""
    staged = pages.select(
        key,
        F.col(title).alias("title"),
        "lang",
        T.strip(F.col("first_paragraph")).alias("para"),
        infobox_rows(F.col("html")).alias("box"),
    )
    para, en = F.col("para"), F.col("lang") == "en"
    kinds_en, kinds_ko = "company|corporation|brand|business", "기업|회사|브랜드|제조사|서비스"
    # entity types are read with the definition test, in either language
    ws, before, after = T.WS, T.NO_WORD_BEFORE, T.NO_WORD_AFTER
    defined = F.when(
        en, para.rlike(f"(?i){before}is{ws}+(?:an?|the){ws}+.+(?:{kinds_en}){after}")
    ).otherwise(para.rlike(f"(?:은|는){ws}+.+(?:{kinds_ko})"))
    said_type = F.when(
        en, F.regexp_extract(para, f"(?i){before}is{ws}+(?:an?|the){ws}+(.{{1,60}}?)(?:{kinds_en}){after}", 1)
    ).otherwise(F.regexp_extract(para, f"(?:은|는){ws}+(.{{1,60}}?)(?:{kinds_ko})", 1))
    para_type = F.nullif(F.trim(F.when(defined, said_type)), F.lit(""))
    box = F.col("box")
    items = F.filter(F.transform(F.split(_box_value(box, "key_products"), ITEM_CUT + "|\n|;"), T.strip), lambda i: i != "")
    year = F.nullif(F.regexp_extract(_box_value(box, "founded"), f"{before}((?:18|19|20)[0-9]{{2}}){after}", 1), F.lit(""))

    def row(field: str, values: Column, source: Column | str) -> Column:
        src = F.lit(source) if isinstance(source, str) else source
        return F.struct(F.lit(field).alias("field"), values.alias("values"), src.alias("source"))

    one = lambda c: F.when(c.isNotNull(), F.array(c))
    box_type = _box_value(box, "entity_type")
    rows = [
        row("entity_name", one(F.nullif(F.trim("title"), F.lit(""))), "title"),
        row(
            "entity_type",
            one(F.coalesce(box_type, para_type)),
            F.when(box_type.isNotNull(), "infobox").otherwise("first_paragraph_definition"),
        ),
        row("founded", one(year), "infobox"),
        row("key_products", F.when(F.size(items) > 0, items), "infobox"),
        row("description", one(F.when(defined & (para != ""), para)), "first_paragraph_definition"),
    ]
    rows += [
        row(f, one(_box_value(box, f)), "infobox")
        for f in ("headquarters", "ceo_or_leader", "employee_count", "revenue", "parent_company")
    ]
    kept = F.filter(F.array(*rows), lambda r: r["values"].isNotNull())
    return staged.select(key, F.explode(kept).alias("r")).select(key, "r.*")


def ground_truth_official(pages: DataFrame, key: str = "page_id", head_chars: int | None = None) -> DataFrame:
    """Short official-page variant: labelled lines (any line, no runs), then JSON-LD."""
    table = dims.alias_map(dims.OFFICIAL_LABELS)
    pattern = f"^[-*]?{T.WS}*([^:]{{1,30}}){T.WS}*:{T.WS}*(.+)$"
    lines = F.transform(F.split(T.head(F.col("content"), head_chars), "\n+"), T.strip)

    def entry(line: Column) -> Column:
        field = table[F.lower(T.strip(F.regexp_extract(line, pattern, 1)))]
        value = T.strip(F.regexp_extract(line, pattern, 2))
        items = F.filter(F.transform(F.split(value, ITEM_CUT), T.strip), lambda i: i != "")
        values = F.when(value == "", F.lit(None)).when(field.isin(dims.ARRAY_FIELDS), items).otherwise(F.array(value))
        return _entry(field, values)

    staged = pages.select(
        key,
        _one_per_field(_valid(F.transform(lines, entry)), last=True).alias("block"),
        J.graph_or_self(F.col("jsonld_blocks")).alias("docs"),
    )
    # the variant reads plain properties only
    paths = {
        "entity_name": "$.name",
        "description": "$.description",
        "founded": "$.foundingDate",
        "ceo_or_leader": "$.founder.name",
        "entity_type": "$.serviceType",
        "headquarters": "$.address.addressLocality",
    }

    def row(field: str) -> Column:
        own = F.get(F.filter("block", lambda e: e["field"] == field), 0)["values"]
        values = own
        if field in paths:
            found = F.filter(F.transform("docs", lambda d: _doc_text(d, paths[field])), lambda v: v.isNotNull())
            values = F.coalesce(own, F.when(F.size(found) > 0, F.array(F.get(found, 0))))
        return F.struct(
            F.lit(field).alias("field"),
            values.alias("values"),
            F.when(own.isNotNull(), FACTS).otherwise(JSONLD).alias("source"),
        )

    rows = F.filter(F.array(*[row(f) for f in dims.FIELDS]), lambda r: F.size(r["values"]) > 0)
    return staged.select(key, F.explode(rows).alias("r")).select(key, "r.*")


# --- FAQ -------------------------------------------------------------------------
Q_LINE = f"(?i)^{T.WS}*(?:q[.:]|q{T.WS}|- q[:.]|질문[:.]|문:){T.WS}*(.+)"
A_LINE = f"(?i)^{T.WS}*(?:a[.:]|a{T.WS}|- a[:.]|답변[:.]|답:){T.WS}*(.+)"


def faq_pairs(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Question/answer pairs: JSON-LD FAQPage entries, then adjacent Q and A lines."""
    docs = F.filter(J.graph_or_self(F.col("jsonld_blocks")), lambda d: F.array_contains(J.types(d), "FAQPage"))
    pair = lambda q, a, source: F.struct(
        F.lit(source).alias("source"), q.alias("question"), a.alias("answer")
    )
    items = F.flatten(
        F.transform(
            docs,
            lambda d: F.coalesce(
                F.try_variant_get(d, F.lit("$.mainEntity"), "array<variant>"),
                F.array(F.try_variant_get(d, F.lit("$.mainEntity"), "variant")),
            ),
        )
    )
    from_docs = F.transform(
        items,
        lambda m: pair(
            F.coalesce(J.text(m, "$.name"), F.lit("")), F.coalesce(J.text(m, "$.acceptedAnswer.text"), F.lit("")), "jsonld"
        ),
    )
    lines = F.split("content", "\n+")
    from_lines = T.let(
        lines,
        lambda ls: F.transform(
            ls,
            lambda line, i: pair(
                T.strip(F.regexp_extract(line, Q_LINE, 1)),
                T.strip(F.regexp_extract(F.coalesce(F.get(ls, i + 1), F.lit("")), A_LINE, 1)),
                "content",
            ),
        ),
    )
    both = F.filter(F.concat(from_docs, from_lines), lambda p: (p["question"] != "") & (p["answer"] != ""))
    rows = pages.select(key, F.posexplode(both).alias("pos", "p"))
    return rows.select(key, (F.col("pos") + 1).cast("bigint").alias("pair_no"), "p.*")
