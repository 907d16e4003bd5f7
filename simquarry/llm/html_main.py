"""Main text of HTML pages by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf tag path. Per path the text length
and the punctuation are summed and set against the number of nodes on the path; both ratios are
smoothed over sibling paths (those that differ in the last tag only), fused by their geometric
mean, discounted by link text, and thresholded. The blocks of the content node, the deepest element
that leaves out only links and boilerplate, are the result, without elements that are boilerplate
by tag or by class; the selected paths tell whether a main element holds the page's text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])", re.I)
_NAME = re.compile(r"[^\s/>]*+")
_TAIL = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
#: Tags whose quotes never close, from which on a page's tags end at their first ">".
BROKEN = 8
_PUNCT = re.compile(r"[.,;:!?…。，！？]")

# Fixed values of HTML.
#: Elements whose text is left out; those of raw text reach to the page's end if nothing closes them.
RAW = frozenset("script style textarea title".split())
SKIPPED = RAW | frozenset("noscript template iframe select".split())
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in SKIPPED}
#: Elements that "/>" closes, whatever they are.
FOREIGN = frozenset("svg math iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Void elements that part blocks; a block runs on across the others.
BREAKS = frozenset("br hr".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big blink canvas cite code data del dfn em font i ins kbd label map mark meter nobr output picture progress q rb rtc ruby rp rt s samp slot small span strike strong sub sup time tt u var video svg math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
BOILERPLATE_TAGS = frozenset("nav aside footer form button dialog menu head".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets cookie cookies consent gdpr banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted comment comments respond replies disqus newsletter subscribe signup login popup modal overlay pagination pager toolbar copyright".split()
)
#: Names that content has as well: the path scores decide.
WEAK_NAMES = frozenset("side notice notices alert reply share sharing social related recommended recommendations subscription tags search legal skip".split())
#: Words that may stand beside a name in one token.
QUALIFIERS = frozenset("site page main top bottom left right primary secondary global mobile desktop container wrapper box bar area block section list link links".split())
_WORD = re.compile(r"[a-z0-9]+")
WEAK, STRONG, BY_TAG = 1, 2, 3
THRESHOLD = 0.25


def _name_mark(name: str, inside: bool) -> int:
    """How sure one whole class token, id, role or label is to name boilerplate."""
    found = _WORD.findall(name)
    names = [w for w in found if w in BOILERPLATE_NAMES and not (inside and w == "header")]
    weak = [w for w in found if w in WEAK_NAMES]
    if not names and not weak or any(w not in QUALIFIERS and w not in BOILERPLATE_NAMES and w not in WEAK_NAMES for w in found):
        return 0
    return STRONG if names else WEAK


def _mark(tag: str, attrs: str, inside: bool) -> int:
    """0, or how sure an element is to be boilerplate: WEAK or STRONG by name, or BY_TAG."""
    if tag in BOILERPLATE_TAGS:
        return BY_TAG
    if tag == "header":
        return 0 if inside else BY_TAG
    if tag in ("html", "body", "main", "article") or "=" not in attrs:
        return 0
    out = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "role", "id"):
            out = max([out, *(_name_mark(name, inside) for name in value.split())])
        elif key == "aria-label":
            out = max(out, _name_mark(value, inside))
    return out


class Block:
    __slots__ = ("page", "text", "node", "linked")

    def __init__(self, page: Page, text: str, node: int, linked: int):
        self.page, self.text, self.node, self.linked = page, text, node, linked

    @property
    def path(self) -> tuple[str, ...]:
        """The root-to-leaf tag path, without inline elements."""
        out, p = [], self.page.path[self.node]
        while p:
            p, tag = self.page.paths[p]
            out.append(tag)
        return tuple(reversed(out))


class Page:
    """A page's elements, in the order they open, and its text blocks without scripts, styles,
    titles and comments.

    Element 0 is the page itself. An element has its parent, tag and mark, the number of its tag
    path, the nearest element around it (or itself) that isn't inline, and the last element
    inside it; elements inside n are therefore n to last[n]. All lists grow by one entry an
    element, whatever the depth, and every step of the reader is proportional to what it reads or
    to the elements that it closes."""

    def __init__(self, html: str):
        self.parent, self.tag, self.mark, self.path, self.outer, self.inside = [0], [""], [0], [0], [0], [False]
        self.paths: list[tuple[int, str]] = [(0, "")]
        self._known: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self._stack: list[int] = []
        self._at: dict[str, list[int]] = defaultdict(list)  # places of open elements in the stack
        self._solid: list[int] = []  # places of those that aren't inline
        self._pieces: list[str] = []
        self._linked, self._owner = 0, -1
        self._read(html)
        self.last = list(range(len(self.tag)))
        for n in range(len(self.tag) - 1, 0, -1):
            up = self.parent[n]
            self.last[up] = max(self.last[up], self.last[n])

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text and self._owner >= 0:
                self.blocks.append(Block(self, text, self._owner, self._linked))
            self._pieces.clear()
        self._linked, self._owner = 0, -1

    def _text(self, raw: str) -> None:
        if not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        if self._owner < 0 and not text.isspace():
            self._owner = self._stack[self._solid[-1]] if self._solid else 0
        if self._at["a"]:
            self._linked += len(text)

    def _pop(self, place: int) -> None:
        """Closes the open elements from this place of the stack on."""
        if self._solid and self._solid[-1] >= place:
            self._flush()
        while len(self._stack) > place:
            tag = self.tag[self._stack.pop()]
            self._at[tag].pop()
            if tag not in INLINE:
                self._solid.pop()

    def _push(self, tag: str, attrs: str) -> None:
        up, n = self._stack[-1] if self._stack else 0, len(self.tag)
        inside = self.inside[up]
        self.parent.append(up)
        self.tag.append(tag)
        self.mark.append(_mark(tag, attrs, inside))
        self.inside.append(inside or tag in ("article", "main"))
        self._at[tag].append(len(self._stack))
        if tag in INLINE:
            self.path.append(self.path[up])
            self.outer.append(self.outer[up])
        else:
            key = self.path[up], tag
            if key not in self._known:
                self._known[key] = len(self.paths)
                self.paths.append(key)
            self.path.append(self._known[key])
            self.outer.append(n)
            self._solid.append(len(self._stack))
        self._stack.append(n)

    def _last_open(self, tags) -> int:
        return max((self._at[t][-1] for t in tags if self._at[t]), default=-1)

    def _close(self, tag: str) -> None:
        place = self._at[tag][-1] if self._at[tag] else -1
        if tag in INLINE:
            # An inline end tag doesn't reach out of the block that it stands in.
            if place >= 0 and (not self._solid or place > self._solid[-1]):
                self._pop(place)
        elif place >= 0:
            self._pop(place)
        else:
            self._flush()

    def _open(self, tag: str, attrs: str, empty: bool) -> None:
        if tag in CLOSES_P and self._solid and self.tag[self._stack[self._solid[-1]]] == "p":
            self._pop(self._solid[-1])
        if tag in SIBLING:
            place = self._last_open(SIBLING[tag])
            if place > self._last_open(STOPS.get(tag, ("table",))):
                self._pop(place)
        if tag in BREAKS or tag not in INLINE and tag not in VOID:
            self._flush()
        if not (tag in VOID or empty and (tag in FOREIGN or tag not in CLOSES_P and tag not in INLINE)):
            self._push(tag, attrs)

    def _read(self, html: str) -> None:
        at, broken, unclosed = 0, 0, set()
        while m := _MARKUP.search(html, at):
            self._text(html[at : m.start()])
            at, lead = m.end(), m[0]
            if lead == "<!--":
                end = at if html.startswith((">", "->"), at) else html.find("-->", at)
                at = len(html) if end < 0 else html.index(">", end) + 1
            elif lead.startswith("<![") or lead.startswith("<!") or lead.startswith("<?"):
                raw = len(lead) > 2
                end = html.find("]]>" if raw else ">", at)
                if raw:
                    self._text(html[at : end if end >= 0 else len(html)].replace("&", "&amp;"))
                at = len(html) if end < 0 else end + (3 if raw else 1)
            else:
                closing = lead[1] == "/"
                name = _NAME.match(html, at - 1)
                tail = _TAIL.match(html, name.end()) if broken < BROKEN else None
                if tail is None:
                    # A quote that never closes, or no ">" at all: an unfinished tag ends the page.
                    broken += 1
                    end = html.find(">", name.end())
                    if end < 0:
                        at = len(html)
                        break
                    attrs, at = html[name.end() : end], end + 1
                else:
                    attrs, at = tail[0][:-1], tail.end()
                tag = name[0].lower()
                if closing:
                    self._close(tag)
                    continue
                empty = attrs.endswith("/")
                if tag in SKIPPED:
                    if empty and (tag in FOREIGN or self._at["svg"] or self._at["math"]):
                        continue
                    end = None if tag in unclosed else _CLOSE[tag].search(html, at)
                    if end or tag in RAW:
                        at = end.end() if end else len(html)
                        continue
                    unclosed.add(tag)
                self._open(tag, attrs, empty)
        self._text(html[at:])
        self._flush()


def blocks(html: str) -> list[Block]:
    return Page(html).blocks


def path_scores(page: Page, found: list[Block]) -> dict[int, float]:
    """The fused ratio of each tag path."""
    length, punct, nodes, links = defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(int)
    for b in found:
        p = page.path[b.node]
        length[p] += len(b.text)
        punct[p] += len(_PUNCT.findall(b.text))
        nodes[p].add(b.node)
        links[p] += b.linked
    text_ratio = {p: length[p] / len(nodes[p]) for p in length}
    punct_ratio = {p: punct[p] / len(nodes[p]) for p in length}
    family = defaultdict(list)
    for p in length:
        family[page.paths[p][0] if p else -1].append(p)
    out = {}
    for kin in family.values():
        mean = [sum(r[q] for q in kin) / len(kin) for r in (text_ratio, punct_ratio)]
        for p in kin:
            fused = ((0.5 * text_ratio[p] + 0.5 * mean[0]) * (1 + 0.5 * punct_ratio[p] + 0.5 * mean[1])) ** 0.5
            out[p] = fused * max(0.0, 1 - links[p] / max(1, length[p])) * len(nodes[p]) ** 0.5
    return out


def content_blocks(page: Page) -> tuple[list[Block], list[int]]:
    """The blocks outside boilerplate, with those under a weak name, and each element's mark, its
    own or one around it. A name doesn't count on an element that holds the page's main or largest
    article element or, on pages without one beside it, most of the page's text."""
    n_nodes, up = len(page.tag), page.parent
    by_tag = [m == BY_TAG for m in page.mark]
    for n in range(1, n_nodes):
        by_tag[n] = by_tag[n] or by_tag[up[n]]
    seen = [b for b in page.blocks if not by_tag[b.node]]
    size, held, above = [0] * n_nodes, [0] * n_nodes, [0] * n_nodes
    for b in seen:
        size[b.node] += len(b.text)
    for n in range(n_nodes - 1, 0, -1):
        size[up[n]] += size[n]
    articles = [n for n in range(1, n_nodes) if page.tag[n] in ("article", "main") and size[n]]
    for n in articles:
        held[n] = 1
    for n in range(n_nodes - 1, 0, -1):
        held[up[n]] += held[n]
    own = set(articles)
    for n in range(1, n_nodes):
        above[n] = above[up[n]] + (up[n] in own)
    top = max(articles, key=lambda n: (page.tag[n] == "main", size[n], -n), default=-1)
    marks = list(page.mark)
    for n in range(1, n_nodes):
        if marks[n] and (n < top <= page.last[n] or 2 * size[n] > size[0] and above[n] + held[n] == len(articles)):
            marks[n] = 0
        marks[n] = max(marks[n], marks[up[n]])
    return [b for b in seen if marks[b.node] <= WEAK], marks


def _common(page: Page, nodes: list[int]) -> int:
    """The deepest element that isn't inline and holds all of them: that of the first and the
    last one, as elements inside another follow it directly."""
    low, high = min(nodes), max(nodes)
    while low and page.last[low] < high:
        low = page.parent[low]
    return page.outer[low]


def main_text(html: str | None) -> str:
    """The main text of one page; empty where there is none."""
    page = Page(html or "")
    content, marks = content_blocks(page)
    if not content:
        return ""
    scores = path_scores(page, content)
    top = max(scores.values())
    picked = {p for p, x in scores.items() if x >= THRESHOLD * top}
    is_picked = lambda b: page.path[b.node] in picked
    content = [b for b in content if not marks[b.node] or is_picked(b) and 2 * b.linked < len(b.text)]
    if not content:
        return ""
    chosen = [b for b in content if is_picked(b)] or content
    headed = [False] * len(page.tag)
    for n in range(1, len(page.tag)):
        headed[n] = page.tag[n] == "h1" or headed[page.parent[n]]
    # The content node: the deepest element that holds every block but those made of links, or the
    # nearest article or main element around it. Where one main element holds all selected
    # text, other text outside it than headlines doesn't count.
    firm = [b for b in content if 2 * b.linked < len(b.text) or headed[b.node]] or content
    around, at = 0, _common(page, [b.node for b in chosen])
    while at:
        around, at = at if page.tag[at] == "main" else around, page.parent[at]
    firm = [b for b in firm if around <= b.node <= page.last[around] or headed[b.node]] or content
    node = _common(page, [b.node for b in firm])
    at, main, article = node, 0, 0
    while at and not article:
        article, main, at = at if page.tag[at] == "article" else 0, at if page.tag[at] == "main" else main, page.parent[at]
    node = article or main or node
    # A content node that is itself one paragraph widens to its parent.
    if page.tag[node] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "td"):
        node = page.outer[page.parent[node]]
    return " ".join(b.text for b in content if node <= b.node <= page.last[node])


def extract_main(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` without its HTML column and with `text` and `n_chars` (its code points).

    The whole page is read. Null, empty and text-free pages have an empty text. Input columns
    named text or n_chars are replaced."""
    keep = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_col}`").cast("string").alias(html_col))

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = rows.select(*(F.col(f"`{c}`") for c in keep), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(run, schema)
