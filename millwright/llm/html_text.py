"""Main text of web pages by tag-path ratios.

Every text node has a tag path from the root, its tags with their classes. Nodes with one
path usually play one role in a page, so text length and punctuation are gathered by path:

1. length ratio: characters outside links, by text node of the path;
2. punctuation ratio: punctuation marks, by text node of the path;
3. both are smoothed over page order with a Gaussian window, weighted by how alike the
   neighbouring paths are, and fused by multiplication;
4. names weigh in: a fused value counts `MARKED` times as much under a tag, role, class or id
   that says boilerplate, and `NAMED` times under one that says content;
5. nodes whose value reaches a share of the standard deviation are content nodes.

Content nodes decide what comes out. The region is the smallest sectioning element that holds
nearly all of their text, whatever its name. Its blocks are the result, in page order, so
headings, lists and short paragraphs come along with the paths that were chosen; marked nodes
come out only if they are content nodes themselves, and nodes that are mostly links do not where
the region is the whole page. What browsers do not show (scripts, styles, hidden elements) and the
parts of forms are no text nodes at all.

Each page is judged alone, so the operator needs no shuffle and its memory is one Arrow batch
of pages; the text of a page is never cut.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.session import table

#: Tags, comments, declarations and processing instructions.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is not shown as text, and parts of forms.
UNSHOWN = RAW | frozenset("head form button select option input label dialog svg math object canvas audio video map datalist fieldset legend".split())
#: Elements named for what stands beside the main text.
BESIDE = frozenset("nav footer aside menu search".split())
#: Elements that can be the region of a page's content.
REGIONS = frozenset("article main section div td body center html".split()) | {""}
#: How much a value counts under names of boilerplate, and of content.
MARKED, NAMED = 0.01, 2.0
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id, split at what is no letter, that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv alert alerts advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist commentary consent cookie cookies copyright disqus feedback footer gdpr "
    "header login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promoted promotion recommended related replies reply respond "
    "share sharing sidebar signup skip social sponsor sponsored subscribe taboola teaser toolbar topbar tracking widget widgets".split()
)
#: Those of them that hold beside a word for content too.
PLAIN = frozenset("ad ads advert comment comments footer menu nav related sidebar".split())
CONTENT = frozenset("article content entry main post story text body".split())
#: An open element of the key's kind ends where one of these starts.
CLOSES = {tag: ("p",) for tag in BLOCK - {"html", "body", "head", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}} | {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "tbody": ("tr", "td", "th", "tbody", "thead", "p"), "tfoot": ("tr", "td", "th", "tbody", "thead", "p"), "thead": ("tr", "td", "th", "p"), "body": ("head",),
}
#: An implied end tag reaches no further up than to one of these.
SCOPE = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote select button".split())
CELLS = frozenset("table thead tbody tfoot tr td th".split())
#: Deeper elements become siblings, as in browsers.
DEEPEST = 512
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")


@dataclass(slots=True)
class Element:
    """An element of the open-element tree: `shown` if its text can be seen and is no part of a
    form, `marked` inside what is named boilerplate, `named` inside what is named content."""

    tag: str
    parent: Element | None
    depth: int
    step: str = ""
    shown: bool = True
    marked: bool = False
    named: bool = False
    linked: bool = False
    header: bool = False
    mass: float = 0.0

    def path(self) -> tuple[str, ...]:
        out, at = [], self
        while at is not None:
            out.append(at.step)
            at = at.parent
        return tuple(reversed(out))


@dataclass(slots=True)
class Node:
    """A text node: its element, text and the number of its block."""

    element: Element
    text: str
    block: int
    size: int = 0
    points: int = 0
    score: float = 0.0


def _words(value: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)}


def _open(tag: str, rest: str, parent: Element | None) -> Element:
    """A new element with what its tag, role, class and id say of it."""
    at = Element(tag, parent, parent.depth + 1 if parent else 0, tag)
    if parent is not None:
        at.shown, at.marked, at.named, at.linked, at.header = parent.shown, parent.marked, parent.named, parent.linked, parent.header
    at.shown &= tag not in UNSHOWN
    at.marked |= tag in BESIDE
    at.named |= tag in ("article", "main")
    at.linked |= tag == "a"
    at.header |= tag == "header"
    if rest and rest.strip(" /\n\t"):
        values = {k.lower(): html_lib.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)}
        names = f"{values.get('class', '')} {values.get('id', '')}".strip()
        if names:
            at.step = f"{tag}.{' '.join(names.split())}"
        if tag not in ("html", "body", "main", "article") and tag not in HEADINGS:
            said = _words(names)
            if said & BOILERPLATE == {"header"}:
                at.header = True
            elif said & BOILERPLATE and not (said & CONTENT and not said & PLAIN):
                at.marked = True
            elif (said & CONTENT or values.get("itemprop") == "articlebody") and tag in ("div", "section", "td"):
                at.named = True
        role = values.get("role", "").lower()
        at.marked |= role in ROLES and tag != "article"
        at.named |= role in ("main", "article")
        if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
            at.shown = False
    return at


def parse(page: str) -> list[Node]:
    """Text nodes in page order with their elements; forgiving like browsers are."""
    out: list[Node] = []
    block, pos = 0, 0
    root = current = Element("", None, -1)
    while m := MARKUP.search(page, pos):
        if raw := page[pos : m.start()]:
            out.append(Node(current, html_lib.unescape(raw) if "&" in raw else raw, block))
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            at = current
            while at is not root and at.tag != tag and not (at.tag in CELLS and tag not in SCOPE and tag not in CELLS):
                at = at.parent
            if at.tag == tag:
                current = at.parent
            if tag in BLOCK:
                block += 1
            continue
        rest = m[3] if m[2] else m[6]
        if tag in CLOSES:
            current = _implied_end(current, CLOSES[tag])
        if tag in BLOCK:
            block += 1
        element = _open(tag, rest or "", current if current.depth < DEEPEST else current.parent)
        if tag == "br":
            out.append(Node(current, " ", block))
        elif tag in VOID or tag in ("svg", "math") and (rest or "").rstrip().endswith("/"):
            continue
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else len(page)
        else:
            current = element
    if raw := page[pos:]:
        out.append(Node(current, html_lib.unescape(raw), block))
    return out


def _implied_end(current: Element, closed: tuple[str, ...]) -> Element:
    """What is open once every element of the kinds `closed` in scope has ended."""
    at = up = current
    while at.parent is not None and (at.tag not in SCOPE or at.tag in closed):
        if at.tag in closed:
            up = at.parent
        at = at.parent
    return up


def _alike(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of equal leading steps of two paths."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return same / max(len(a), len(b), 1)


def score(nodes: list[Node], width: int = 2) -> None:
    """Sets each node's smoothed and fused value of its path, weighed by names."""
    paths = [n.element.path() for n in nodes]
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for n, p in zip(nodes, paths, strict=True):
        n.size, n.points = len(n.text.strip()), len(PUNCTUATION.findall(n.text))
        s = sums[p]
        s[0] += 1
        s[1] += 0 if n.element.linked else n.size
        s[2] += 0 if n.element.linked else n.points
    length, points = ([sums[p][k] / sums[p][0] for p in paths] for k in (1, 2))
    near = [math.exp(-(d * d) / 2) for d in range(width + 1)]
    for i, n in enumerate(nodes):
        a = b = total = 0.0
        for j in range(max(0, i - width), min(len(nodes), i + width + 1)):
            w = near[abs(i - j)] * _alike(paths[i], paths[j])
            a, b, total = a + w * length[j], b + w * points[j], total + w
        fused = a / total * (1 + b / total) if total else 0.0
        n.score = fused * (MARKED if _marked(n) else NAMED if n.element.named else 1.0)


def _marked(n: Node) -> bool:
    """Named boilerplate, or in a header and no heading of an article's own one."""
    return n.element.marked or n.element.header and not _heading(n.element)


def content(nodes: list[Node], share: float = 0.5) -> list[Node]:
    """The scored nodes that reach `share` of the standard deviation of all values, at least the
    best; none on a page of nothing but marked links."""
    mean = sum(n.score for n in nodes) / len(nodes)
    spread = math.sqrt(sum((n.score - mean) ** 2 for n in nodes) / len(nodes))
    line = min(share * spread, max(n.score for n in nodes))
    return [n for n in nodes if n.score >= line and (n.score > 0 or not _marked(n))]


def region(chosen: list[Node], hold: float = 0.9) -> Element:
    """The deepest element that can be a region and holds `hold` of the chosen nodes' text."""
    total = sum(n.size for n in chosen)
    for n in chosen:
        at = n.element
        while at is not None:
            at.mass += n.size
            at = at.parent
    at = max(chosen, key=lambda n: n.size).element
    while at.parent is not None and (at.mass < hold * total or at.tag not in REGIONS):
        at = at.parent
    return at


def _inside(at: Element, top: Element) -> bool:
    while at.depth > top.depth:
        at = at.parent
    return at is top


def extract(page: str | None, share: float = 0.5) -> str:
    """Main text of a page: blocks in page order joined by one line feed. Null, empty and
    text-free pages give the empty string. White space (str.split's) inside a block is one
    space; `<br>` is white space. Of equal values all are content nodes."""
    if not page:
        return ""
    shown = [n for n in parse(page) if n.element.shown]
    judged = [n for n in shown if n.text.strip()]
    if not judged:
        return ""
    score(judged)
    chosen = content(judged, share)
    if not chosen:
        return ""
    best, top = {id(n) for n in chosen}, region(chosen)
    links: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for n in judged:
        links[n.block][n.element.linked] += n.size or 1
    blocks: dict[int, list[str]] = {}
    for n in shown:
        if _inside(n.element, top) and (id(n) in best or not _marked(n) and not (top.tag in ("", "html", "body") and links[n.block][1] > links[n.block][0])):
            blocks.setdefault(n.block, []).append(n.text)
    return "\n".join(line for parts in blocks.values() if (line := " ".join("".join(parts).split())))


def _heading(at: Element | None) -> bool:
    """In a heading of a header that stands in named content."""
    inside = False
    while at is not None:
        inside |= at.tag in HEADINGS
        if at.tag in ("article", "main") or at.named and not (at.parent and at.parent.named):
            return inside
        at = at.parent
    return False


def main_text(column: Column) -> Column:
    """Main text of a column of pages."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py()) for p in pages], pa.string())

    return run(column)


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """Every row with `text` and `n_chars` (code points) added; columns of these names are
    replaced. Null pages give empty texts; repeated rows stay; an empty table stays empty."""
    rows = pages.select(*(c for c in pages.columns if c not in ("text", "n_chars")), main_text(F.col(column)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
