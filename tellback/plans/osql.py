"""SQL fragments for the DuckDB side of the comparison."""

from __future__ import annotations

from tellback.functions.text import BASIC_ENTITIES, NAMED_ENTITIES, WS, WS_SET


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {lit(WS + '+')}, ' ', 'g'), ' ')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, '{flags}')"


def get(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)}, {group})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def strip_tags(x: str) -> str:
    return sub(x, "<[^>]+>", " ")


def decode_basic(x: str) -> str:
    for entity, char in BASIC_ENTITIES:
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return sub(x, "(?i)&#x27;", "'")


def clean_fragment(x: str) -> str:
    return squeeze(decode_basic(strip_tags(x)))


def tag_text(x: str, tag: str) -> str:
    return clean_fragment(get(x, f"(?is)<{tag}[^>]*>(.*?)</{tag}>"))


def uniq(x: str, keep: str = "v <> ''") -> str:
    """First-seen distinct of a list, after a filter."""
    return (
        f"list_transform(list_sort(list_transform(list_distinct(list_filter({x}, lambda v: {keep})), "
        f"lambda w: {{'p': list_position({x}, w), 'v': w}})), lambda s: s.v)"
    )


def tag_texts(x: str, tag: str) -> str:
    got = every(x, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return f"({uniq(f'list_transform({got}, lambda h: {clean_fragment('h')})')})"


def tag_count(x: str, tag: str) -> str:
    return f"len({every(x, f'(?i)<{tag}' + chr(92) + 'b')})"


def first_text(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def attr_value(x: str, tag: str, attr: str, name: str, value_attr: str, empty_ok: bool) -> str:
    body = "[^\"']*" if empty_ok else "[^\"']+"
    key, val = f"{attr}=[\"']{name}[\"']", f"{value_attr}=[\"']({body})[\"']"
    return first_text(
        get(x, f"(?i)<{tag}[^>]*{key}[^>]*{val}[^>]*>"), get(x, f"(?i)<{tag}[^>]*{val}[^>]*{key}[^>]*>")
    )


def meta(x: str, attr: str, name: str) -> str:
    return attr_value(x, "meta", attr, name, "content", True)


def words(x: str) -> str:
    s = squeeze(x)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END)"


def named_entities(x: str) -> str:
    for name, char in NAMED_ENTITIES.items():
        if name != "amp":
            x = sub(x, f"(?i)&{name};", char)
    return sub(x, "(?i)&amp;", "&")


# --- URLs ---------------------------------------------------------------
def host(x: str) -> str:
    return f"lower({get(x, '(?i)^https?://(?:[^/?#]*@)?([^/?#:@]*)')})"


def bare_host(x: str) -> str:
    return sub(host(x), r"^www\.")


def origin(x: str) -> str:
    return f"(CASE WHEN {host(x)} <> '' THEN lower({get(x, '(?i)^(https?)://')}) || '://' || {host(x)} END)"


def encode_path(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ''), lambda ch: CASE WHEN ch = ' ' THEN '%20' "
        f"WHEN regexp_matches(ch, '[^!-~]|[\"<>`{{}}^]') THEN url_encode(ch) ELSE ch END), '')"
    )


def path(x: str) -> str:
    raw = get(x, "(?i)^https?://[^/?#]*([^?#]*)")
    return f"(CASE WHEN {raw} = '' THEN '/' ELSE {encode_path(raw)} END)"


def query(x: str) -> str:
    return get(x, r"(?i)^https?://[^?#]*(\?[^#]*)")


def normal(x: str) -> str:
    return f"({origin(x)} || {path(x)} || {query(x)})"


def absolute(base: str, href: str) -> str:
    """Absolute text of a link before normalisation."""
    folder = get(path(base), "^(.*/)")
    sch = f"lower({get(base, '(?i)^(https?)://')})"
    return (
        f"(CASE WHEN {has(href, '(?i)^https?://')} THEN {href} WHEN {has(href, '^[A-Za-z][A-Za-z0-9+.-]*:')} THEN NULL "
        f"WHEN starts_with({href}, '//') THEN {sch} || ':' || {href} WHEN starts_with({href}, '/') THEN {origin(base)} || {href} "
        f"WHEN starts_with({href}, '?') THEN {origin(base)} || {path(base)} || {href} "
        f"WHEN {href} = '' OR starts_with({href}, '#') THEN {base} ELSE {origin(base)} || {folder} || {href} END)"
    )


def trimmed_path(x: str) -> str:
    return sub(path(x), "/+$", "")


def comparable_url(x: str) -> str:
    return f"coalesce({origin(x)} || (CASE WHEN {trimmed_path(x)} = '' THEN '/' ELSE {trimmed_path(x)} END) || {query(x)}, '')"


def dedupe_key(x: str) -> str:
    kept = (
        f"list_filter(string_split(substr({query(x)}, 2), '&'), lambda p: p <> '' AND NOT "
        f"regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|fbclid|gclid|hubs_|mc_)|^(gad_source|igshid|ref|ref_src)$'))"
    )
    p = path(x)
    return (
        f"coalesce({origin(x)} || (CASE WHEN {p} <> '/' AND {p} LIKE '%/' THEN {sub(p, '/$')} ELSE {p} END) || "
        f"(CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END), {x})"
    )


def comparable(x: str, korean: bool = True) -> str:
    t = sub(f"lower(coalesce({x}, ''))", "[\\[\\](),.:;'\"`]", " ")
    if korean:
        t = sub(t, rf"([0-9]+){WS}*[년월일명개원억만천백]+", r"\1")
        # a Hangul particle is dropped when an ASCII word character follows
        t = sub(t, "([가-힣])(은|는|이|가|을|를|의|에|로|와|과|도|서)([A-Za-z0-9_])", r"\1\3")
    return squeeze(t)


def tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({x}, '[^0-9a-zA-Z가-힣]+'), lambda t: length(t) >= 2))"


def token_share(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
        f"len(list_intersect({a}, {b}))::DOUBLE / greatest(len({a}), len({b})) END)"
    )


def hold_each_other(a: str, b: str) -> str:
    return f"({a} <> '' AND {b} <> '' AND (contains({a}, {b}) OR contains({b}, {a})))"


def years(x: str, since: str = "19|20") -> str:
    b = chr(92) + "b"
    return f"list_distinct({every(x, f'{b}((?:{since})[0-9][0-9]){b}', 1)})"


def plain_html(x: str) -> str:
    for pattern in (
        "(?is)<style.*?</style>",
        "(?is)<script.*?</script>",
        "(?is)<sup.*?</sup>",
        '(?is)<table class="metadata.*?</table>',
        "<[^>]+>",
    ):
        x = sub(x, pattern, " ")
    for entity, char in (("&#8364;", "€"), ("&#x41;", "A")):
        x = f"replace({x}, '{entity}', '{char}')"
    return squeeze(named_entities(x))


def joined(x: str, sep: str = " | ") -> str:
    return f"array_to_string({x}, {lit(sep)})"
