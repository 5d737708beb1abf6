"""Stepwise rewrite experiment: definition, facts block, sections, inner links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellback.functions import text as T
from tellback.operators.benchmark import STAGES

# Section headings and fact labels per language.
HEADINGS = {
    "en": ["[Overview]", "[History]", "[Products and Services]", "[Organization]", "[Other]"],
    "ko": ["[개요]", "[역사]", "[주요 제품 및 서비스]", "[조직 및 경영]", "[기타]"],
}
FACT_COLUMNS = ["name", "founded", "headquarters", "leader", "entity_type", "employees", "revenue"]
LABELS = {
    "en": ["Company", "Founded", "Headquarters", "Leader", "Industry", "Employees", "Revenue"],
    "ko": ["회사명", "설립", "본사", "대표", "업종", "직원수", "매출"],
}


def _blank_to_null(name: str) -> Column:
    return T.null_if_blank(F.col(name))


def topic_particle(text: Column) -> Column:
    """은 after a final consonant, 는 otherwise (also after non-Hangul)."""
    code = F.ascii(F.right(F.trim(text), F.lit(1)))
    return F.when(code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 != 0), "은").otherwise("는")


def definition_sentence() -> Column:
    name, hq = _blank_to_null("name"), _blank_to_null("headquarters")
    kind = T.squeeze(F.regexp_replace(F.col("entity_type"), "[.。]+$", ""))
    kind_ko = F.nullif(F.trim(F.regexp_replace(kind, "(회사|기업|브랜드) *$", "")), F.lit(""))
    kind_en = F.nullif(
        F.trim(F.regexp_replace(kind, f"(?i){T.NO_WORD_BEFORE}(company|corporation|business|brand)$", "")), F.lit("")
    )
    who = F.coalesce(name, F.lit("이 기업"))
    subject = F.concat(who, topic_particle(who), F.lit(" "))
    ko = F.concat(
        subject,
        F.coalesce(F.concat(hq, F.lit("에 본사를 둔 ")), F.lit("")),
        F.coalesce(F.concat(kind_ko, F.lit(" ")), F.lit("")),
        F.lit("기업이다."),
    )
    en = F.concat(
        F.coalesce(name, F.lit("This company")),
        F.lit(" is a "),
        F.coalesce(F.concat(kind_en, F.lit(" ")), F.lit("")),
        F.lit("company"),
        F.coalesce(F.concat(F.lit(" based in "), hq), F.lit("")),
        F.lit("."),
    )
    return F.when(F.col("lang") == "en", en).otherwise(ko)


def rewrite_definition(text: Column) -> tuple[Column, Column]:
    """(text, applied): a definition sentence first, unless the page already has one."""
    use = ~F.col("defines_entity")
    made = T.strip(F.concat(definition_sentence(), F.lit("\n\n"), text))
    return F.when(use, made).otherwise(text), use


def fact_lines() -> Column:
    def lines(lang: str) -> Column:
        return F.array_compact(
            F.array(
                *[
                    F.concat(F.lit(f"{label}: "), _blank_to_null(c))
                    for label, c in zip(LABELS[lang], FACT_COLUMNS)
                ]
            )
        )

    return F.when(F.col("lang") == "en", lines("en")).otherwise(lines("ko"))


def rewrite_facts(text: Column) -> tuple[Column, Column]:
    """A facts block first, when three or more facts are known and the page has no infobox."""
    use = ~F.col("has_infobox") & (F.size(fact_lines()) >= 3)
    head = F.when(F.col("lang") == "en", "[Company Facts]").otherwise("[기업 정보]")
    made = T.strip(F.concat(head, F.lit("\n"), F.array_join(fact_lines(), "\n"), F.lit("\n\n"), text))
    return F.when(use, made).otherwise(text), use


def plain_sentences(text: Column) -> Column:
    found = F.regexp_extract_all(T.squeeze(text), F.lit("([^.!?。]+[.!?。]?)"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def sections(sentences: Column, most: int = 5) -> Column:
    """Even chunks of sentences: a third of them per section, two to ``most`` sections."""
    n = F.size(sentences)
    count = F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(n / 3))).cast("int")
    per = F.ceil(n / count).cast("int")
    chunks = lambda size: F.transform(
        F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1),
        lambda i: F.array_join(F.slice(sentences, i * size + 1, size), " "),
    )
    return F.when(n > 0, T.let(per, chunks)).otherwise(F.array().cast("array<string>"))


def sectioned(sentences: Column) -> Column:
    heads = lambda lang: F.array(*[F.lit(h) for h in HEADINGS[lang]])
    head = F.when(F.col("lang") == "en", heads("en")).otherwise(heads("ko"))
    return T.let(
        head,
        lambda h: F.array_join(
            F.transform(sections(sentences), lambda c, i: F.concat(F.get(h, i), F.lit("\n"), c)), "\n\n"
        ),
    )


def rewrite_sections(text: Column) -> tuple[Column, Column]:
    use = (F.col("section_count") <= 2) & (F.size(plain_sentences(text)) >= 4)
    made = T.let(plain_sentences(text), lambda s: F.when(F.size(s) >= 4, T.strip(sectioned(s))).otherwise(F.lit(None)))
    return F.when(F.col("section_count") <= 2, F.coalesce(made, text)).otherwise(text), use


def rewrite_links(text: Column, most: int | None = None) -> tuple[Column, Column]:
    """First occurrence of each anchor wrapped in [[ ]], longest anchors first, up to ``most`` when given."""
    usable = F.filter(
        F.array_distinct(F.transform("anchors", T.strip)),
        lambda a: (F.length(a) >= 2) & ~a.rlike("^[0-9]+$"),
    )
    ordered = F.transform(
        F.array_sort(F.transform(usable, lambda a, i: F.struct((-F.length(a)).alias("l"), i.alias("i"), a.alias("a")))),
        lambda s: s["a"],
    )

    def wrap(acc: Column, a: Column) -> Column:
        linked = F.concat(F.lit("[["), a, F.lit("]]"))
        fits = (F.lit(most is None) | (acc["n"] < (most or 0))) & F.contains(acc["t"], a) & ~F.contains(acc["t"], linked)
        made = F.overlay(acc["t"], linked, F.position(a, acc["t"]), F.length(a))
        return F.struct(F.when(fits, made).otherwise(acc["t"]).alias("t"), (acc["n"] + F.when(fits, 1).otherwise(0)).alias("n"))

    folded = F.aggregate(ordered, F.struct(text.alias("t"), F.lit(0).alias("n")), wrap)
    return folded["t"], folded["n"] > 0


def stage_texts(study: DataFrame, key: str = "page_id") -> DataFrame:
    """Text after every step and the steps applied so far: one row per page and stage.

    Each step is its own projection, so a step's text is computed once and read by the next.
    """
    df = study.withColumns({"t0": T.strip(F.col("text")), "a0": F.lit(False)})
    steps = [rewrite_definition, rewrite_facts, rewrite_sections, rewrite_links]
    for i, step in enumerate(steps, start=1):
        made, applied = step(F.col(f"t{i - 1}"))
        df = df.withColumns({f"t{i}": made, f"a{i}": applied})
    so_far = lambda n: F.array_compact(
        F.array(*[F.when(F.col(f"a{i}"), F.lit(STAGES[i])) for i in range(1, n + 1)])
    ) if n else F.array().cast("array<string>")
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("stage_no"),
                F.col(f"t{i}").alias("text"),
                F.col(f"a{i}").alias("applied"),
                so_far(i).alias("steps"),
            )
            for i in range(len(STAGES))
        ]
    )
    return df.select(key, F.inline(rows))
