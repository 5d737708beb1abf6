"""Column expressions for http(s) URLs: parts, resolution, comparison keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellback.functions.text import let, strip

# Query keys that only track visits.
TRACKING_PREFIXES = ["utm_", "fbclid", "gclid", "hubs_", "mc_"]
TRACKING_KEYS = ["gad_source", "igshid", "ref", "ref_src"]


_SPLIT = (
    "(?is)^(https?)://(?:[^/?#\\\\]*@)?(\\[[^\\]]*\\]|[^/?#\\\\:@]*)(?::([0-9]*))?(?:(?=[/?#])([^?#]*)(\\?[^#]*)?(?:#.*)?)?$"
)
# A path with one of these needs more than a copy.
_UNUSUAL = "[^!-~]|[\"<>`{}^]|(?:^|/)\\.{1,2}(?:/|$)"


def parts(url: Column) -> Column:
    """[scheme, host, port, path, query] of an http(s) URL in one regex pass; one item when it is none."""
    return F.split(F.regexp_replace(url, _SPLIT, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001")


def _origin(p: Column) -> Column:
    port, sch = F.get(p, 2), F.lower(F.get(p, 0))
    default = (port == "") | ((sch == "http") & (port == "80")) | ((sch == "https") & (port == "443"))
    return F.when(
        (F.size(p) == 5) & (F.get(p, 1) != ""),
        F.concat(sch, F.lit("://"), F.lower(F.get(p, 1)), F.when(default, "").otherwise(F.concat(F.lit(":"), port))),
    )


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(path.rlike("/\\.{1,2}$"), "/").otherwise("")
    return let(F.concat(F.array_join(kept, "/"), tail), lambda x: F.when(x == "", "/").otherwise(x))


def _encoded(path: Column) -> Column:
    """Percent-encode what a browser would."""
    return F.array_join(
        F.transform(
            F.split(path, ""),
            lambda ch: F.when(ch == " ", "%20").when(ch.rlike("[^!-~]|[\"<>`{}^]"), F.url_encode(ch)).otherwise(ch),
        ),
        "",
    )


def _path(p: Column) -> Column:
    return let(
        F.get(p, 3),
        lambda raw: F.when(raw == "", "/").when(raw.rlike(_UNUSUAL), _encoded(_without_dots(raw))).otherwise(raw),
    )


def user_info(url: Column) -> Column:
    return F.regexp_extract(url, "(?i)^https?://([^/?#\\\\]*)@", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "(?i)^https?://(?:[^/?#\\\\]*@)?(\\[[^\\]]*\\]|[^/?#\\\\:@]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), "^www\\.", "")


def origin(url: Column) -> Column:
    """scheme://host[:port], NULL when the URL is not http(s) or has no host."""
    return let(parts(url), _origin)


def path(url: Column) -> Column:
    """Browser path name: '/' when empty, percent-encoded, dots resolved; NULL without a URL."""
    return let(parts(url), _path)


def query(url: Column) -> Column:
    return F.regexp_extract(url, "(?i)^https?://[^?#]*(\\?[^#]*)", 1)


def _whole(p: Column, path_out: Column) -> Column:
    return F.concat(_origin(p), path_out, F.get(p, 4))


def normal(url: Column) -> Column:
    """Absolute URL without fragment, NULL when unusable."""
    return let(parts(url), lambda p: _whole(p, _path(p)))


def base_parts(url: Column) -> Column:
    """What link resolution needs of a page URL, to be bound once per page."""
    return let(
        parts(url),
        lambda p: F.struct(
            F.lower(F.get(p, 0)).alias("scheme"),
            _origin(p).alias("origin"),
            _path(p).alias("path"),
            F.get(p, 4).alias("query"),
        ),
    )


def resolve_from(base: Column, href: Column) -> Column:
    """Absolute http(s) URL of a link, given ``base_parts``; NULL for other schemes."""
    folder = F.regexp_extract(base["path"], "^(.*/)", 1)

    def absolute(h: Column) -> Column:
        return (
            F.when(h.rlike("(?i)^https?://"), h)
            .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(h.startswith("//"), F.concat(base["scheme"], F.lit(":"), h))
            .when(h.startswith("?"), F.concat(base["origin"], base["path"], h))
            .when((h == "") | h.startswith("#"), F.concat(base["origin"], base["path"], base["query"]))
            .otherwise(F.concat(base["origin"], folder, h))
        )

    return let(
        strip(href),
        lambda h: F.when(h.rlike("^/(?!/)") & ~h.rlike("#|" + _UNUSUAL), F.concat(base["origin"], h)).otherwise(
            normal(F.when(h.rlike("^/(?!/)"), F.concat(base["origin"], h)).otherwise(absolute(h)))
        ),
    )


def resolve(base: Column, href: Column) -> Column:
    return let(base_parts(base), lambda b: resolve_from(b, href))


def trimmed_path(url: Column) -> Column:
    return F.regexp_replace(path(url), "/+$", "")


def comparable_url(url: Column) -> Column:
    """Fragment dropped, trailing slashes dropped, query kept; '' when unusable."""
    bare = lambda p: let(
        F.regexp_replace(_path(p), "/+$", ""), lambda t: F.when(t == "", "/").otherwise(t)
    )
    return F.coalesce(let(parts(url), lambda p: _whole(p, bare(p))), F.lit(""))


def _tracking(pair: Column) -> Column:
    key = F.lower(F.regexp_extract(pair, "^([^=]*)", 1))
    return key.isin(TRACKING_KEYS) | key.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")


def dedupe_key(url: Column) -> Column:
    """Fragment, tracking parameters and one trailing slash removed."""

    def query_out(raw: Column) -> Column:
        kept = F.filter(F.split(F.regexp_replace(raw, "^\\?", ""), "&"), lambda p: (p != "") & ~_tracking(p))
        return F.when(raw == "", "").otherwise(
            let(F.array_join(kept, "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
        )

    return F.coalesce(
        let(
            parts(url),
            lambda p: F.concat(_origin(p), F.regexp_replace(_path(p), "(?<=.)/$", ""), query_out(F.get(p, 4))),
        ),
        url,
    )


def same_or_subdomain(hostname: Column, domain: Column) -> Column:
    return (hostname != "") & (domain != "") & (
        (hostname == domain) | F.endswith(hostname, F.concat(F.lit("."), domain))
    )


def mentioned_hosts(text: Column) -> Column:
    """Host names in text: from URLs first, then bare dotted names; www. removed."""
    value = F.coalesce(text, F.lit(""))
    from_urls = F.transform(
        F.regexp_extract_all(value, F.lit("(?i)(https?://[^\\s)\"'<>\\]]+)"), F.lit(1)), bare_host
    )
    bare = F.transform(
        F.regexp_extract_all(
            value,
            F.lit("(?i)(?<![A-Za-z0-9_])((?:www\\.)?[a-z0-9-]+(?:\\.[a-z0-9-]+)+)(?![A-Za-z0-9_])"),
            F.lit(1),
        ),
        bare_host_name,
    )
    return F.array_distinct(F.filter(F.concat(from_urls, bare), lambda h: h != ""))


def bare_host_name(value: Column) -> Column:
    """Dotted name that looks like a host (letters in the last two labels), else ''."""
    name = F.regexp_replace(
        F.regexp_extract(F.lower(F.trim(value)), "(?<![a-z0-9_])([a-z0-9-]+(?:\\.[a-z0-9-]+)+)(?![a-z0-9_])", 1),
        "^www\\.",
        "",
    )
    # letters only in the last label, a letter in the one before it
    return let(name, lambda x: F.when(x.rlike("[a-z][a-z0-9-]*\\.[a-z]{2,24}$|[0-9-][a-z0-9-]*[a-z][a-z0-9-]*\\.[a-z]{2,24}$"), x).otherwise(""))
