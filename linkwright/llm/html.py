"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each with the path of block elements from the
root to it. Per path the text length, the punctuation, the text inside links and
the number of blocks are added up; text and punctuation a block are the path's
two ratios. Both are smoothed over the paths that follow each other on the page,
fused by their product, and thresholded. The paths that pass vote, by fused
score, for the innermost element that holds most of it; blocks there are content
unless their path is mostly links, so a one-word paragraph between long ones and
the heading above them stay. Where an <article> or <main> is declared, its paths
that pass are the content, with the headings right above, and no vote is taken. What the page itself declares as something else
(navigation, forms, scripts, hidden parts, elements named as adverts, notices,
comments and the like) never enters the ratios.

Row-local: no shuffle, one pass over each page, linear in its length.

Edge cases: null or empty html gives empty text; unclosed elements end where
their parent ends, an unclosed script at the end of the page; a page without any
markup is one block; repeated pages are treated alike; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|\Z)", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Everything up to their end tag is text of no interest.
RAW = frozenset("script style title textarea noscript template iframe svg math object select".split())
NOISE = frozenset("nav header footer aside form button menu dialog label fieldset head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CONTENT = frozenset("article main".split())
#: Words of class, id or role that name something other than the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended recommendations comment comments disqus reply replies responses respond widget complementary contentinfo search pagination pager toolbar".split()
)
#: Before such a word in one class, these speak of the layout around it (has-sidebar), or of what a post is filed under (tag-social).
AROUND = frozenset("with has no without tag category".split())
#: An element's own head: entry-header holds a heading.
OWN_HEADERS = frozenset("article post page story entry content main".split())
_HEADING = re.compile("h[1-6]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Weights of a path's smoothing window; share of the mean fused score that selects; share of selected score an element must hold; link share above which a path is a menu.
SMOOTH, SELECT, HOLD, LINKS = (0.25, 0.5, 0.25), 0.5, 0.6, 0.6


def _named_noise(value: str, first: bool) -> bool:
    """Whether a class, id or role names noise: comment-body does, has-sidebar and entry-header do not. ``first``: only a name that begins with it."""
    for name in value.split():
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        for before, word in zip(["", *words], words[:1] if first else words):
            if word in NOISE_WORDS and before not in AROUND and not (word == "header" and before in OWN_HEADERS):
                return True
    return False


def _noise(tag: str, attributes: str, nested: bool) -> bool:
    """``nested``: inside an article or main. The outermost of them counts as noise by name alone."""
    if tag in NOISE:
        return True
    if tag in ("html", "body") or not attributes.strip():
        return False
    outer = tag in CONTENT and not nested
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if not outer and (name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value)):
            return True
        if name in ("class", "id", "role") and _named_noise(value, tag in CONTENT):
            return True
    return False


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of each text block that no declared noise holds, in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, bool, str]] = []  # tag, noise, path step
    dark = links = 0
    parts: list[str] = []
    linked: list[str] = []
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal path
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((path, text, len(" ".join(entities.unescape("".join(linked)).split()))))
            parts.clear()
            linked.clear()

    def pop() -> None:
        nonlocal dark, links
        tag, noise, _ = stack.pop()
        dark -= noise
        links -= tag == "a"

    def say(text: str) -> None:
        nonlocal path
        if dark or not text:
            return
        if not parts:
            path = tuple(step for _, _, step in stack if step)
        parts.append(text)
        if links:
            linked.append(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            continue
        if closing:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] != tag:
                if tag in INLINE and stack[k][0] not in INLINE:
                    k = -1  # an inline end tag does not close blocks
                    break
                k -= 1
            if tag not in INLINE:
                flush()
            if k >= 0:
                while len(stack) > k:
                    pop()
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            if tag not in ("svg", "math", "object", "select"):
                continue
            continue
        if tag not in INLINE:
            flush()
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag[0] == "h" and tag[1:].isdigit() or tag in ("div", "ul", "ol", "table", "article", "section", "footer", "nav", "aside", "header", "form"):
                ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("p",))
                k = len(stack) - 1
                while k >= 0 and (stack[k][0] in INLINE or stack[k][0] in ("p",)) and stack[k][0] not in ends:
                    k -= 1
                if k >= 0 and stack[k][0] in ends:
                    while len(stack) > k:
                        pop()
        noise = _noise(tag, attributes, any(t in CONTENT for t, _, _ in stack))
        if tag == "header" and any(t in CONTENT for t, _, _ in stack):
            noise = False  # an article's own header holds its heading
        stack.append((tag, noise, "" if tag in INLINE else tag))
        dark += noise
        links += tag == "a"
    flush()
    return out


def content(found: list[tuple[tuple[str, ...], str, int]]) -> list[str]:
    """The blocks that tag-path ratios select."""
    if not found:
        return []
    paths: dict[tuple[str, ...], list[float]] = {}
    for path, text, linked in found:
        s = paths.setdefault(path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += 0 if CONTENT & set(path) else linked  # links of a declared body are text
        s[3] += 1
    order = list(paths)
    ratio = [(max(0.0, c - x) / n, (u if x <= LINKS * c else 0) / n) for c, u, x, n in paths.values()]

    def smooth(values: list[float]) -> list[float]:
        n = len(values)
        return [sum(w * values[min(max(i + d, 0), n - 1)] for d, w in zip((-1, 0, 1), SMOOTH)) for i in range(n)]

    text, punctuation = smooth([a for a, _ in ratio]), smooth([b for _, b in ratio])
    fused = [math.log1p(a) * (1 + b) for a, b in zip(text, punctuation)]
    least = SELECT * sum(fused) / len(fused)
    menus = {p for p in order if paths[p][2] > LINKS * paths[p][0]}
    chosen = {p: f * paths[p][0] for p, f in zip(order, fused) if f >= least and p not in menus}
    if not chosen:
        chosen = {p: 1.0 for p in order if p not in menus}
    declared = [p for p in chosen if CONTENT & set(p)]
    if declared:
        kept: list[str] = []
        below = False  # whether the block below is kept; a heading goes with it
        for p, t, _ in reversed(found):
            below = bool(CONTENT & set(p)) and (p in chosen or below and bool(_HEADING.fullmatch(p[-1])))
            if below:
                kept.append(t)
        return kept[::-1]
    held: dict[tuple[str, ...], float] = {}
    for p, f in chosen.items():
        for k in range(len(p)):
            held[p[:k]] = held.get(p[:k], 0.0) + f
    whole = sum(chosen.values())
    home = max((p for p, f in held.items() if f >= HOLD * whole), key=len, default=())
    return [t for p, t, _ in found if p not in menus and (p in chosen or p[: len(home)] == home)]


def main_text(page: str | None) -> str:
    return "\n\n".join(content(blocks(page or "")))


def _extract(batches):
    for batch in batches:
        names = batch.schema.names
        texts = [main_text(p) for p in batch.column(names.index("html")).to_pylist()]
        kept = [i for i, n in enumerate(names) if n != "html"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[names[i] for i in kept] + ["text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    bound_batches(pages.sparkSession)
    got = pages.select("page_id", "url", "html")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema if f.name != "html")
    return got.mapInArrow(_extract, fields + ", text string, n_chars long")
