"""Column expressions for text: whitespace, HTML, entities, tokens, sentences.

The reference regexes follow JavaScript: ``\\s`` covers Unicode spaces and
``\\b``/``\\w`` are ASCII-only, so both are spelled out here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript whitespace set, as the inside of a character class.
WS_SET = r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{WS_SET}]"
WORD = "[A-Za-z0-9_]"
NO_WORD_BEFORE = f"(?<!{WORD})"
NO_WORD_AFTER = f"(?!{WORD})"

# Entities decoded on fetched pages, in this order.
BASIC_ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
]

# Named entities decoded on encyclopedia pages.
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": " ",
    "ndash": "-",
    "mdash": "-",
    "hellip": "...",
    "middot": "·",
}


def quoted(value) -> str:
    """A Python value as a SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, bool) or value is None:
        return "null" if value is None else str(value).lower()
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def literal_list(values) -> Column:
    """A constant array in one expression; long word lists stay one literal in the plan."""
    return F.expr("array(" + ", ".join(quoted(v) for v in values) + ")")


def literal_map(pairs) -> Column:
    """A constant map in one expression."""
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in pairs) + ")")


def let(value: Column, body) -> Column:
    """Bind a value once inside one expression, so its work is not repeated."""
    return F.get(F.transform(F.array(value), body), 0)


# Spelled so that printable ASCII is refused by one range test, and so that a
# single plain space between words, the common case, is not a match at all.
_WS_NO_SPACE = WS_SET.replace("\\s", "\\t\\n\\f\\r")
_RUN = f"(?=[^!-~])(?: {WS}+|[{_WS_NO_SPACE}]{WS}*)"
_NOT_WS = f"[!-~[^{WS_SET}]]"


def squeeze(col: Column) -> Column:
    """Whitespace runs become one space, ends trimmed; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), _RUN, " "))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def null_if_blank(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, "<[^>]+>", " ")


def decode_basic(col: Column) -> Column:
    out = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), BASIC_ENTITIES, col)
    return F.regexp_replace(out, "(?i)&#x27;", "'")


def _code_point(number: Column) -> Column:
    """Character for a code point; built-in char() is wrong above 255."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _decode_numeric(text: Column, pattern: str, digits_from: int, radix: int) -> Column:
    """Replace each distinct numeric entity of the text once."""

    def swap(acc: Column, entity: Column) -> Column:
        digits = F.regexp_extract(F.substring(entity, digits_from, 9), "^[0-9A-Fa-f]+", 0)
        return F.replace(acc, entity, _code_point(F.conv(digits, radix, 10).cast("bigint")))

    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    return F.aggregate(found, text, swap)


def _decode_named(text: Column) -> Column:
    """One left-to-right pass, so that a decoded '&' is not read again."""
    table = literal_map(NAMED_ENTITIES.items())
    pieces = F.split(F.regexp_replace(text, "&([A-Za-z]+);", "\u0001$1\u0002"), "[\u0001\u0002]")
    return F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(i % 2 == 0, piece).otherwise(
                F.coalesce(table[F.lower(piece)], F.concat(F.lit("&"), piece, F.lit(";")))
            ),
        ),
        "",
    )


def decode_full(col: Column) -> Column:
    """Decimal, hexadecimal and named entities; text without '&' passes untouched."""
    numeric = lambda t: F.when(
        F.contains(t, F.lit("&#")),
        let(
            _decode_numeric(t, "(&#[0-9]{1,7};)", 3, 10),
            lambda d: _decode_numeric(d, "(&#[xX][0-9a-fA-F]{1,6};)", 4, 16),
        ),
    ).otherwise(t)
    return let(
        col, lambda t: F.when(F.contains(t, F.lit("&")), let(numeric(t), _decode_named)).otherwise(t)
    )


def plain_html(col: Column) -> Column:
    """Text of an encyclopedia page fragment."""
    text = F.regexp_replace(col, "(?is)<style.*?</style>|<script.*?</script>", " ")
    text = F.regexp_replace(text, '(?is)<sup.*?</sup>|<table class="metadata.*?</table>', " ")
    return squeeze(decode_full(strip_tags(text)))


def word_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(_NOT_WS + "+")).cast("bigint")


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(f"(?i)<{tag}{NO_WORD_AFTER}")).cast("bigint")


def tag_text(html: Column, tag: str) -> Column:
    return squeeze(decode_basic(strip_tags(F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))))


def first(values: Column, limit: int | None = None) -> Column:
    """The first ``limit`` items of a list, or all of them."""
    return values if limit is None else F.slice(values, 1, limit)


def head(text: Column, limit: int | None = None) -> Column:
    """The first ``limit`` characters of a text, or all of them."""
    return text if limit is None else F.substring(text, 1, limit)


def tag_texts(html: Column, tag: str, limit: int | None = None) -> Column:
    """Distinct texts of a heading tag, in page order."""
    raw = F.regexp_extract_all(html, F.lit(f"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    texts = F.transform(raw, lambda x: squeeze(decode_basic(strip_tags(x))))
    return first(F.array_distinct(F.filter(texts, lambda x: x != "")), limit)


def first_text(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))


def attr_tag_value(html: Column, tag: str, attr: str, name: str, value_attr: str, empty_ok: bool) -> Column:
    """Value of a tag chosen by one attribute, in either attribute order."""
    body = "[^\"']*" if empty_ok else "[^\"']+"
    key = f"{attr}=[\"']{name}[\"']"
    val = f"{value_attr}=[\"']({body})[\"']"
    return first_text(
        F.regexp_extract(html, f"(?i)<{tag}[^>]*{key}[^>]*{val}[^>]*>", 1),
        F.regexp_extract(html, f"(?i)<{tag}[^>]*{val}[^>]*{key}[^>]*>", 1),
    )


def meta_content(html: Column, attr: str, name: str) -> Column:
    return attr_tag_value(html, "meta", attr, name, "content", True)


def distinct_strings(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x != ""))


def any_contains(text: Column, needles: Column) -> Column:
    return F.exists(needles, lambda n: F.contains(text, n))


def contains_any(text: Column, needles: list[str]) -> Column:
    if len(needles) > 6:
        return any_contains(text, literal_list(needles))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def sentences(col: Column, break_on_newline: bool = False) -> Column:
    """Korean / English sentence split."""
    cut = f"(?<=[.!?。]|다\\.|요\\.){WS}+" + ("|\\n+" if break_on_newline else "")
    return F.filter(F.transform(F.split(col, cut), strip), lambda x: x != "")


def comparable(col: Column, korean: bool = True) -> Column:
    """Lower-cased text without punctuation, Korean counters and particles."""
    text = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[\\[\\](),.:;'\"`]", " ")
    if korean:
        text = F.regexp_replace(text, f"([0-9]+){WS}*[년월일명개원억만천백]+", "$1")
        # JavaScript \b after a Hangul character means: an ASCII word character follows.
        text = F.regexp_replace(text, f"([가-힣])(은|는|이|가|을|를|의|에|로|와|과|도|서)(?={WORD})", "$1")
    return squeeze(text)


def tokens(comparable_text: Column) -> Column:
    """Distinct tokens of two or more characters of an already comparable text."""
    parts = F.split(comparable_text, "[^0-9a-zA-Z가-힣]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 2))


def token_share(left: Column, right: Column) -> Column:
    """Shared distinct tokens over the larger token set; 0 when either is empty."""
    bigger = F.greatest(F.size(left), F.size(right))
    smaller = F.least(F.size(left), F.size(right))
    shared = F.size(F.array_intersect(left, right))
    return F.when(smaller > 0, shared.cast("double") / bigger).otherwise(F.lit(0.0))


def hold_each_other(left: Column, right: Column) -> Column:
    return (left != "") & (right != "") & (F.contains(left, right) | F.contains(right, left))


def years(col: Column, since: str = "19|20") -> Column:
    pattern = f"{NO_WORD_BEFORE}((?:{since})[0-9]{{2}}){NO_WORD_AFTER}"
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(1)))


def emails(col: Column) -> Column:
    pattern = f"(?i){NO_WORD_BEFORE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}{NO_WORD_AFTER}"
    return F.array_distinct(
        F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(0)), F.lower)
    )


def preview(col: Column, limit: int) -> Column:
    text = squeeze(col)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def hash31(col: Column) -> Column:
    """31-multiplier string hash in 32-bit wrap-around, absolute value."""
    span = F.lit(4294967296)
    raw = F.aggregate(
        F.split(col, ""),
        F.lit(0).cast("bigint"),
        lambda acc, ch: F.when(ch == "", acc).otherwise((acc * 31 + F.ascii(ch)) % span),
    )
    wrapped = F.pmod(raw, span)
    return F.abs(F.when(wrapped >= 2147483648, wrapped - span).otherwise(wrapped))


def round_half(col: Column, digits: int) -> Column:
    return F.round(col.cast("double"), digits)
