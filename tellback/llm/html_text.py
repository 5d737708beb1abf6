"""Main text of web pages by composite text density.

A page is read once into a tree. What its mark-up names as no part of an article (menus, footers, adverts, forms, comments ...) is left
out. For each block the density is its characters per tag, lowered for text in links:

    density = C/T * log(C/LC * T/LT) / log(ln(C/(C-LC) * LC + LCb/Cb * C + e))

with characters C, tags T, characters and tags in links LC and LT, and b for the body. The block with the largest sum of its children's
densities holds the text; an ``article`` or ``main`` around it is taken whole. Without one, blocks beside the path from the body to it are added
when they are at least as dense as the least dense block of that path. Nothing else within the chosen blocks is dropped.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellback.llm import util

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Parts of formulas: text in a line, and no mark-up that makes an article less dense.
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE |= MATH
#: Elements that end an open one of the same kind within the nearest container.
ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tr td th tbody thead", "table"), "tfoot": ("tr td th tbody", "table"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
NOT_TEXT = frozenset("head nav footer aside form button select datalist dialog menu object audio video canvas".split())
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
#: Whole words of class, or a whole id, that name what is no part of an article.
NOT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer header masthead sidebar aside cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe subscription signup "
    "login comment comments disqus replies reactions respond share sharing social related recommended recommendations widget pagination pager toolbar "
    "skip hidden".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What no name leaves out, and what none leaves out within an article: headings and their links, sections, tables.
NAMELESS = HEADINGS | frozenset("html body article main tr thead th".split())
NAMELESS_IN_ARTICLE = frozenset("section table caption tbody tfoot td".split())


def _left_out(tag: str, attributes: str, in_article: bool, in_heading: bool) -> tuple[bool, bool]:
    """Whether the element is left out whatever it holds, and whether it is if it does not hold the article."""
    if tag in NOT_TEXT or (tag == "header" and not in_article):
        return tag != "form", tag == "form"
    if not attributes or attributes.isspace():
        return False, False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if found.get("role", "").lower() in NOT_ROLES or found.get("aria-hidden", "").lower() == "true" or found.get("hidden", "until-found").lower() != "until-found":
        return True, False
    if "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, False
    if tag in NAMELESS or in_heading:
        return False, False
    names = found.get("class", "").lower().split()
    if in_article and (tag in NAMELESS_IN_ARTICLE or "section" in names):
        return False, False
    return False, not NOT_NAMES.isdisjoint(names) or found.get("id", "").strip().lower() in NOT_NAMES


class Page:
    """Blocks of a page in order: parents stand before their children."""

    def __init__(self, source: str):
        self.tag, self.parent = ["body"], [-1]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.named: dict[int, bool] = {}  # blocks that are left out if they do not hold the article: whether they are within one
        self.pieces: list[tuple[int, str]] = []  # (block, text); an empty text parts what stands around it
        self._read(source)
        self._leave_out()

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]  # tag, block, left out, in a link, in an article
        counts: dict[str, int] = {}
        at, pieces = 0, self.pieces

        def text(part: str) -> None:
            _, block, out, link, _ = stack[-1]
            if out or not part:
                return
            part = html.unescape(part)
            size = len(part) if not part.isspace() else 0
            self.chars[block] += size
            if link:
                self.link_chars[block] += size
            pieces.append((block, part))

        def close() -> None:
            tag = stack.pop()[0]
            counts[tag] -= 1
            if tag not in INLINE:
                pieces.append((stack[-1][1], ""))

        def close_to(names: frozenset, fence: frozenset) -> None:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in names:
                    while len(stack) > depth:
                        close()
                    return
                if stack[depth][0] in fence:
                    return

        while match := _MARKUP.search(source, at):
            text(source[at : match.start()])
            at = match.end()
            name = _TAG_NAME.match(match[0])
            if not name:
                continue
            ending, tag = name[1], name[2].lower()
            if ending:
                if counts.get(tag):
                    while stack[-1][0] != tag:
                        close()
                    close()
                elif tag == "p" or tag == "br":
                    pieces.append((stack[-1][1], ""))
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = end.start() if end else len(source)
                if end:
                    close_mark = source.find(">", at)
                    at = close_mark + 1 if close_mark >= 0 else len(source)
                continue
            if tag in ENDS:
                close_to(*ENDS[tag])
            if counts.get("p") and tag not in INLINE and tag not in VOID or counts.get("p") and tag == "hr":
                close_to(frozenset(["p"]), frozenset(["table", "td", "th", "button", "object"]))
            _, block, out, link, article = stack[-1]
            if tag in VOID:
                if not out:
                    self.tags[block] += 1
                    if tag in ("br", "hr"):
                        pieces.append((block, ""))
                continue
            article = article or tag in ("article", "main")
            named = False
            if not out:
                out, named = _left_out(tag, match[3] or "", article, any(counts.get(h) for h in HEADINGS))
            link = link or tag == "a"
            if not out:
                if tag in INLINE and not named:
                    self.tags[block] += tag not in MATH
                    if link:
                        self.link_tags[block] += 1
                elif tag not in ("html", "body"):
                    self.tag.append(tag)
                    self.parent.append(block)
                    for values, first in ((self.chars, 0), (self.tags, 1), (self.link_chars, 0), (self.link_tags, int(link))):
                        values.append(first)
                    block = len(self.tag) - 1
                    if named:
                        self.named[block] = article
            if tag not in INLINE:
                pieces.append((block, ""))
            counts[tag] = counts.get(tag, 0) + 1
            stack.append((tag, block, out, link, article))
        text(source[at:])

    def _leave_out(self) -> None:
        """Empties the blocks whose names leave them out.

        Those stay that hold an article or most of the page's text; the latter only within an article or where no article holds text, as comments may
        well be longer than the article they are about.
        """
        self.out = np.zeros(len(self.tag), bool)
        if not self.named:
            return
        held, articles = self.chars[:], [tag in ("article", "main") for tag in self.tag]
        for k in range(len(self.tag) - 1, 0, -1):
            held[self.parent[k]] += held[k]
            articles[k] = articles[k] and held[k] > 0
        holds = articles[:]
        for k in range(len(self.tag) - 1, 0, -1):
            holds[self.parent[k]] = holds[self.parent[k]] or holds[k]
        for k in range(1, len(self.tag)):
            most = k in self.named and 2 * held[k] > held[0] and (self.named[k] or not holds[0])
            if self.out[self.parent[k]] or k in self.named and not holds[k] and not most:
                self.out[k] = True
                for values in (self.chars, self.tags, self.link_chars, self.link_tags):
                    values[k] = 0

    def densities(self) -> tuple[list[float], list[float]]:
        """Density of each block, and the sum of the densities of its children and of its own text."""
        n = len(self.tag)
        c, t, lc, lt = self.chars[:], self.tags[:], self.link_chars[:], self.link_tags[:]
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            for values in (c, t, lc, lt):
                values[up] += values[k]
        share = lc[0] / max(c[0], 1)

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            t, lc1, lt = max(t, 1), max(lc, 1), max(lt, 1)
            base = math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e)) if lc or share else 0.0
            plain = c / t
            ratio = max(c / lc1 * t / lt, 1.0)
            return plain * (math.log(ratio + 1) / (base + 1))

        dense = [density(*x) for x in zip(c, t, lc, lt)]
        sums = [density(*x) if x[0] else 0.0 for x in zip(self.chars, self.tags, self.link_chars, self.link_tags)]
        for k in range(1, n):
            sums[self.parent[k]] += dense[k]
        return dense, sums

    def text(self) -> str:
        dense, sums = self.densities()
        n = len(self.tag)
        best = max(range(n), key=lambda k: (sums[k], -k))
        path, k = [best], best
        while k:
            k = self.parent[k]
            path.append(k)
        marked = [k for k in path if self.tag[k] in ("article", "main")]
        chosen = np.zeros(n, bool)
        if marked:
            chosen[marked[-1]] = True
        else:
            least, on_path = min(dense[k] for k in path), set(path)
            chosen[best] = True
            for k in range(1, n):
                if k not in on_path and self.parent[k] in on_path and self.parent[k] != best and dense[k] >= least > 0:
                    chosen[k] = True
        for k in range(1, n):
            chosen[k] |= chosen[self.parent[k]]
        return " ".join("".join(part or " " for block, part in self.pieces if chosen[block] and not self.out[block] or not part).split())


def main_text(source: str | None) -> str:
    """The main text of one page; empty for null, empty pages and pages without text."""
    return Page(source).text() if source else ""


def extracted(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in ``name``. Null pages give an empty text, repeated rows the same one."""
    return util.appended(pages, html, name, "string", lambda values: pa.array([main_text(v) for v in values.to_pylist()], pa.string()))


def extracted_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points), a row for each row of ``pages``. Other columns are not looked at."""
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
