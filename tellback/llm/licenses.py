"""Licence texts by sentence rules, in SQL functions only.

A text is cut into sentences; each normalised sentence that is a known licence sentence becomes its identifier. A line may be a sentence, but a
known one may also go on over single line breaks and semicolons, as in notices wrapped at 70 to 80 columns; a blank line ends it. Of known sentences
that start at one place the longest counts. The identifiers of a text in their order are matched with ordered rules: a rule fits where its identifiers follow one another, also with other sentences between them. A rule that
another found rule contains at the same place gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences, normalised: lower case, words of letters and digits with one blank between.
SENTENCES = {
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl3-or-later": "either version 3 of the license or at your option any later version",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "ccbync4-line": "licensed under cc by nc 4 0",
    "ccby4-line": "licensed under cc by 4 0",
    "ccbysa4-line": "licensed under cc by sa 4 0",
    "mit-line": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "apache2-line": "licensed under the apache license version 2 0",
    "apache2-the-license": "licensed under the apache license version 2 0 the license",
    "apache2-may-not": "you may not use this file except in compliance with the license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "mit-grant-whole": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "as-is-whole": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
}
#: The first sentence of GNU notices with the versions that end it.
SENTENCES |= {
    f"gpl{n}-free-{kind}": f"{SENTENCES['gpl-free']} {version}"
    for n in (2, 3)
    for kind, version in (("or-later", f"either version {n} of the license or at your option any later version"), ("only", f"version {n} of the license"))
}
#: (rule, licence, identifiers in order, or regular expressions of them).
RULES = [
    ("gpl3-line", "GPL-3.0", ["gpl3-line"]),
    ("gpl-header", "GPL-3.0-or-later", ["(gpl-free|gpl3-free-or-later)", "gpl-hope"]),
    ("gpl3-or-later", "GPL-3.0-or-later", ["(gpl3-free-or-later|gpl-free (.* )?gpl3-or-later)"]),
    ("gpl3-only", "GPL-3.0-only", ["gpl3-free-only"]),
    ("gpl2-or-later", "GPL-2.0-or-later", ["gpl2-free-or-later"]),
    ("gpl2-only", "GPL-2.0-only", ["gpl2-free-only"]),
    ("ccbync4-line", "CC-BY-NC-4.0", ["ccbync4-line"]),
    ("ccby4-line", "CC-BY-4.0", ["ccby4-line"]),
    ("ccbysa4-line", "CC-BY-SA-4.0", ["ccbysa4-line"]),
    ("mit-line", "MIT", ["mit-line"]),
    ("mit-text", "MIT", ["mit-grant(-whole)?", "mit-notice", "as-is(-whole)?"]),
    ("apache2-line", "Apache-2.0", ["apache2-line"]),
    ("apache2-header", "Apache-2.0", ["apache2-the-license", "apache2-may-not"]),
    ("bsd2-text", "BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("bsd3-text", "BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd4-text", "BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"]),
    ("unlicense-line", "Unlicense", ["public-domain"]),
]
#: Found rules that give way to others in the same text.
INSTEAD = {"bsd2-text": "bsd3-text", "bsd3-text": "bsd4-text", "gpl3-or-later": "gpl-header"}
#: What becomes a mark in a normalised text: ends of sentences, semicolons with white space behind, line breaks. The digits of "2.0" stay together.
MARKS = [(r";+(?![;\s]|$)", " "), (r"[.!?]+(?=\s|$)", " | "), (r";+(?=\s|$)", " ; "), (r"\r\n|\r|\n", " / "), (r"[^a-z0-9|;/]+", " ")]
#: What may stand between the words of a known sentence: a semicolon, one line break.
BETWEEN = "(?: ;)?(?: /)? "
#: The name of a copyright holder in "bsd-endorse"; it may have the mark of "Inc.".
HOLDER = "(?:[a-z0-9]+(?: [|;])?(?: /)? ){1,12}?"
#: Words that every known sentence has one of; sentences without are not normalised.
HINT = "(?i)licens|permission|redistribut|warranty|copyright|public[^a-zA-Z0-9]+domain|any later version"


def _pattern(id: str) -> str:
    """A known sentence in a normalised text with marks."""
    if id == "bsd-endorse":
        before, after = SENTENCES[id].split(" the copyright holder nor the names of its ")
        return BETWEEN.join(before.split()) + BETWEEN + HOLDER + BETWEEN.join("nor the names of".split()) + BETWEEN + f"(?:its{BETWEEN})?" + BETWEEN.join(after.split())
    # the sentence goes on with a version that is none of the known ones
    unless = f"(?!{BETWEEN}(?:either{BETWEEN})?version )" if id == "gpl-free" else ""
    return BETWEEN.join(SENTENCES[id].split()) + unless


def _identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in ((s, i) for i, s in SENTENCES.items()) for x in pair])
    marked = F.translate(F.lower(text), "|/", "  ")
    for what, mark in MARKS:
        marked = F.regexp_replace(marked, what, mark)
    marked = F.regexp_replace(F.concat(F.lit("| "), marked, F.lit(" |")), " +", " ")
    longest_first = sorted(SENTENCES, key=lambda i: -len(SENTENCES[i]))
    found = F.regexp_extract_all(marked, F.lit(f"(?<=[|/;] )(?:{'|'.join(map(_pattern, longest_first))})(?= [|/;])"), F.lit(0))
    plain = lambda s: F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", " "), "^neither the name of .* nor the names of (?:its )?", "neither the name of the copyright holder nor the names of its ")
    return F.when(text.rlike(HINT), F.transform(found, lambda s: known[plain(s)])).otherwise(F.array().cast("array<string>"))


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, licences (names, sorted, joined by a blank), rules (found ones in the order of RULES) and n_sentences (known ones) of each row.

    Null and empty texts, and texts without a known rule, have empty strings; n_sentences is 0 without a known sentence. Repeated rows are judged alike. A
    text may hold any number of licences. Other columns are not looked at.
    """
    rows = docs.select(F.col(id).alias("id"), _identifiers(F.coalesce(F.col(text), F.lit(""))).alias("ids"))
    line = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    # the line holds identifiers only, so a pattern with anything between is one pass over a short text
    fits = [(rule, licence, line.rlike(".* " + " (.* )?".join(ids) + " .*")) for rule, licence, ids in RULES]
    fit = dict((rule, f) for rule, _, f in fits)
    final = [(rule, licence, f & ~fit[INSTEAD[rule]] if rule in INSTEAD else f) for rule, licence, f in fits]
    rules = F.filter(F.array(*[F.when(f, F.lit(rule)) for rule, _, f in final]), lambda x: x.isNotNull())
    licences = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(f, F.lit(licence)) for _, licence, f in final]), lambda x: x.isNotNull())))
    return rows.select(F.col("id").alias(id), F.array_join(licences, " ").alias("licences"), F.array_join(rules, " ").alias("rules"), F.size("ids").cast("long").alias("n_sentences"))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL for texts whose known sentences stand on one line each, without semicolons."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(i)}, {quoted(s)})" for i, s in SENTENCES.items())
    found = ", ".join(f"regexp_matches(line, {quoted(' ' + ' (.* )?'.join(ids) + ' ')}) AS {quoted(rule).replace(chr(39), chr(34))}" for rule, _, ids in RULES)
    name = lambda rule: f'"{rule}"' + (f' AND NOT "{INSTEAD[rule]}"' if rule in INSTEAD else "")
    rules = ", ".join(f"CASE WHEN {name(rule)} THEN {quoted(rule)} END" for rule, _, _ in RULES)
    licences = ", ".join(f"CASE WHEN {name(rule)} THEN {quoted(licence)} END" for rule, licence, _ in RULES)
    return f"""
WITH known(id, sentence) AS (VALUES {values}),
parts AS (SELECT row_number() OVER () AS r, doc_id, string_split_regex(coalesce(text, ''), '[\\n\\r]+|[.!?;]+(?:[ \\t]+|$)') AS s FROM {table}),
each AS (SELECT r, unnest(s) AS sentence, generate_subscripts(s, 1) AS k FROM parts),
ids AS (
  SELECT e.r, string_agg(known.id, ' ' ORDER BY k) AS line, count(*) AS n FROM each e
  JOIN known ON known.sentence = trim(regexp_replace(lower(e.sentence), '[^a-z0-9]+', ' ', 'g')) GROUP BY e.r),
fit AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, ' ' || coalesce(line, '') || ' ' AS line FROM parts LEFT JOIN ids USING (r)),
flags AS (SELECT doc_id, n_sentences, {found} FROM fit)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{licences}], lambda x: x IS NOT NULL))), ' ') AS licences,
  array_to_string(list_filter([{rules}], lambda x: x IS NOT NULL), ' ') AS rules, n_sentences FROM flags
"""
