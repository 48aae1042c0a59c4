"""Main text of HTML pages by tag-path ratios.

A page is parsed to blocks of text, each with its path of tags from the root. For each path the
text length and the punctuation a block has on average are taken; the two series over the page's
blocks are smoothed, fused by multiplication and cut at half their standard deviation. The blocks
above it find the content's container (an article or main element that holds most of them, or
else the deepest element that does), and what the container holds, short paragraphs too, is the
text. Blocks in navigation, headers, footers, asides, forms, notices, adverts, comments and the
like take no part: tags and roles say so, and a class or id whose every word does, but for words that
mean nothing here (`related-links`, not `related-work`). Names don't count against an element around
a main or article element.

Defined cases: null and empty pages, and pages without text, give an empty text; unclosed and
stray tags are mended by the usual rules; rows may repeat; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import shared

CHUNK_BYTES = 1 << 20
#: Share of the standard deviation at which the fused series is cut; share of the selected text a container must hold.
CUT, HOLDS = 0.5, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCT = re.compile(r"[.,;:!?。，、！？；：…¿¡]")
_WORD = re.compile(r"[a-z]+|[0-9]+")

# Names of HTML elements by their role here, and words that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
BOILER_TAGS = frozenset("nav footer aside form head script style noscript template iframe svg button select textarea title dialog menu object canvas audio video".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidenav aside footer foot cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login search pagination pager toolbar widget widgets copyright disclaimer masthead skip".split()
)
#: Words that say nothing of what an element holds: beside them a word above names all of it, beside any other it may not.
PLAIN_WORDS = frozenset(
    "a the box bar block wrap wrapper container section sections list item items area panel inner outer top bottom left right upper lower main site page global "
    "primary secondary post entry article user users reader readers form forms link links button buttons icon icons text title small large slot unit group holder "
    "row col column div in".split()
)
#: Words that name a header; one inside an article keeps its headings.
HEADER_WORDS = frozenset("header topbar".split())
#: Those that name an article which isn't the page's.
ARTICLE_WORDS = frozenset("comment comments reply ad ads advert related promo".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What a start tag ends when it is still open, up to the nearest of the stops.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I | re.A)


class Element:
    __slots__ = ("tag", "parent", "path", "boiler", "named", "holds", "header", "article", "main", "heading")

    def __init__(self, tag: str, parent: Element | None, attrs: str):
        self.tag, self.parent = tag, parent
        self.path = f"{parent.path}/{tag}" if parent else tag
        self.article = tag == "article"
        self.main = tag == "main"
        boiler, named = tag in BOILER_TAGS, False
        header = tag == "header"
        if attrs and not attrs.isspace():
            for m in _ATTR.finditer(attrs):
                name = m[1].lower()
                value = (m[2] or m[3] or m[4] or "").lower()
                if name in ("class", "id"):
                    for words in map(_WORD.findall, value.split()):
                        own = [w for w in words if w not in PLAIN_WORDS and not w.isdigit()]
                        if own and all(w in BOILER_WORDS for w in own) and tag not in ("html", "body", "main"):
                            named = named or tag != "article" or not ARTICLE_WORDS.isdisjoint(own)
                        header = header or bool(own) and all(w in HEADER_WORDS for w in own)
                elif name == "role":
                    boiler = boiler or value in BOILER_ROLES
                    self.article = self.article or value == "article"
                    self.main = self.main or value == "main"
                elif name == "itemprop":
                    self.article = self.article or value == "articlebody"
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                    boiler = True
        self.boiler, self.named, self.holds = boiler, named, frozenset()
        if (self.main or self.article) and not (boiler or named):
            e = parent
            while e is not None:
                e.holds |= {"main" if self.main else "article"}
                e = e.parent
        self.header = header or bool(parent and parent.header)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)


    def boilerplate(self, spared: frozenset | None) -> bool:
        """Whether this or an element around it is boilerplate; names don't count on elements that hold one of spared, or at all if it is None."""
        e = self
        while e is not None:
            if e.boiler or (e.named and spared is not None and spared.isdisjoint(e.holds)):
                return True
            e = e.parent
        return False


class Block:
    __slots__ = ("element", "text")

    def __init__(self, element: Element, text: str):
        self.element, self.text = element, text

    def within(self, kind: str) -> bool:
        e = self.element
        while e is not None:
            if getattr(e, kind):
                return True
            e = e.parent
        return False


def blocks(page: str) -> list[Block]:
    """Blocks of text in page order, white space collapsed and character references decoded."""
    found: list[Block] = []
    stack = [Element("#root", None, "")]
    parts: list[str] = []

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                e = stack[-1]
                while e.parent is not None and e.tag not in BLOCK:
                    e = e.parent
                # Inline boilerplate (a button) has been left out of parts already.
                found.append(Block(e, text))

    def left_out() -> bool:
        """Inline boilerplate; that of blocks is decided when the page is known."""
        for e in reversed(stack):
            if e.tag in BLOCK:
                return False
            if e.boiler or e.named:
                return True
        return False

    def close(to: int) -> None:
        if any(e.tag in BLOCK for e in stack[to:]):
            end_block()
        del stack[to:]

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not left_out():
            parts.append(page[at:stop])
        if m is None:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK and stack[k].tag != "p":
                    break
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in BLOCK:
            end_block()
            if tag in _CLOSES:
                ends, stops = _CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in stops:
                        break
                    if stack[k].tag in ends:
                        close(k)
            # A paragraph ends where a block begins, with the inline elements left open in it.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(Element(tag, stack[-1], m[3]))
    end_block()
    return found


def _smooth(x: np.ndarray) -> np.ndarray:
    padded = np.concatenate((x[:1], x, x[-1:]))
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def select(found: list[Block]) -> np.ndarray:
    """Whether each block's path has text and punctuation enough, by smoothed and fused tag-path ratios."""
    length, punct, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        p = b.element.path
        length[p] += len(b.text)
        punct[p] += len(_PUNCT.findall(b.text))
        count[p] += 1
    text_ratio = np.array([length[b.element.path] / count[b.element.path] for b in found])
    punct_ratio = np.array([punct[b.element.path] / count[b.element.path] for b in found])
    fused = _smooth(text_ratio) * (1 + _smooth(punct_ratio))
    return fused >= min(CUT * float(fused.std()), float(fused.max()))


def _content(whole: list[Block], spared: frozenset | None) -> list[Block]:
    found = []
    for b in whole:
        if b.element.boilerplate(spared):
            continue
        if b.element.header and not (b.element.heading and (b.within("article") or b.within("main"))):
            continue
        found.append(b)
    return found


def main_text(page: str | None) -> str:
    whole = blocks(page or "")
    # Names decide, but not against a main element in what is named; where they leave nothing, not against an article, then not at all.
    for spared in (frozenset(("main",)), frozenset(("main", "article")), None):
        if found := _content(whole, spared):
            break
    if not found:
        return ""
    chosen = select(found)
    held: dict[int, list] = {}
    total = 0
    for b, ok in zip(found, chosen.tolist(), strict=True):
        if not ok:
            continue
        total += len(b.text)
        e, depth = b.element, 0
        while e is not None:
            held.setdefault(id(e), [e, 0])[1] += len(b.text)
            e, depth = e.parent, depth + 1
    most = [e for e, n in held.values() if n >= HOLDS * total]
    deep = lambda e: e.path.count("/")
    articles = [e for e in most if e.article]
    mains = [e for e in most if e.main]
    # Articles: the outermost; without one, main; without either, the deepest element that holds most.
    box = min(articles, key=deep) if articles else max(mains, key=deep) if mains else None
    if box is None:
        whole = [e for e, n in held.values() if n >= 0.9 * total]
        box = max(whole, key=deep)
        if box.tag in ("p", "li", "td", *HEADINGS) and box.parent is not None:
            box = box.parent

    def inside(e: Element | None) -> bool:
        while e is not None:
            if e is box:
                return True
            e = e.parent
        return False

    keep = [k for k, b in enumerate(found) if inside(b.element)]
    if box.tag in ("body", "html", "#root"):
        # Nothing encloses the content: from the first block selected, or the headings before it, to the last.
        on = [k for k in keep if chosen[k]]
        first, last = on[0], on[-1]
        while first and found[first - 1].element.heading:
            first -= 1
        keep = [k for k in keep if first <= k <= last]
    return "\n\n".join(found[k].text for k in keep)


def _extract(batches):
    for batch in batches:
        for part in shared.chunks(batch, "html", CHUNK_BYTES):
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(_extract, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.read_table(spark, sf_dir, "pages"))
