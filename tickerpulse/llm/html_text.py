"""Main text of web pages by tree scoring.

A page is read once into a light element tree. Every paragraph (the text directly inside one block
element) earns points: one, one per comma, and up to three for its length. The points pass to its
container in full, to the next ancestor by half, and to each further one by a share that falls with
the distance. A container's score is its points times one minus its link density (the share of its
characters inside links). The best container is kept, and with it those of its siblings, of any element, that
score well against it or are link-poor. The same goes for the siblings of each ancestor below an article or
main element, or below one that has a fair share of its points from other children; above that, link-poor headings.

Menus, headers, footers, sidebars, notices, adverts, forms, comments and everything that is not text never
count, by element or by class and id words. A class or id word alone does not rule out an element that holds the
page's article, or most of the page's points where no article stands elsewhere: such words also name layouts.

The text of what is kept: character references decoded, white space inside a block turned into one
space, blocks joined in page order by one space. Nothing else is dropped or cut.

Broken markup is read as browsers do in the common cases: unclosed paragraphs and items end where the
next one begins, stray end tags are ignored, a tag cut off by the end of the page is no text.

Defined results: a null or empty page, and one without any text, give an empty string; repeated rows and
null ids are read one by one; pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|xmp|iframe|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var".split())
DROPPED = frozenset("head nav header footer aside form button select option menu dialog noscript template svg math canvas "
                    "object audio video map script style title textarea iframe fieldset".split())
#: Words of a class, id or role that mark what is not the article.
NOT_ARTICLE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav "
                        "navbar navigation footer header masthead breadcrumb breadcrumbs comment comments disqus respond cookie cookies "
                        "consent notice popup modal overlay share sharing social subscribe newsletter signup login related "
                        "recommended pagination pager widget toolbar complementary contentinfo search commentlist commentlisting reviews "
                        "userreviews".split())
KEPT_NAMES = frozenset("html body article main".split())
#: An element that a new one of the listed names ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "body": {"head"}}
PARAGRAPHS = frozenset("p li dt dd td th pre blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
SCOPES = frozenset("ul ol dl table article section div main body html".split())


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of an ancestor's points outside the kept child from which on its other children are looked at.
SEVERAL = 0.2


def _attributes(attrs: str) -> dict[str, str]:
    """Names (lower case) and values of a tag's attributes, the first of each name."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _hidden(own: dict[str, str]) -> bool:
    return ("hidden" in own and own["hidden"].lower() != "until-found") or own.get("aria-hidden", "").strip().lower() == "true" \
        or bool(_NO_DISPLAY.search(own.get("style", "")))


def _unwanted(name: str, attrs: str) -> bool:
    return name in DROPPED or bool(attrs) and name not in KEPT_NAMES and _hidden(_attributes(attrs))


def _marked(name: str, attrs: str) -> bool:
    """Whether a class, id or role word says that this is not the article. Words end at capitals too (sidebarLeft)."""
    if not attrs:
        return False
    own = _attributes(attrs)
    return any(not NOT_ARTICLE.isdisjoint(w.lower() for w in _WORDS.findall(own.get(key, ""))) for key in ("class", "id", "role"))


class _Page:
    """Elements as parallel lists: name, parent, dropped, marked by a class word; and the text runs in page order."""

    def __init__(self, source: str):
        self.name, self.parent, self.drop, self.mark = ["#page"], [-1], [False], [False]
        self.runs: list[tuple[int, str, bool]] = []  # block element, text, inside a link
        self.stack = [0]
        self.links = 0
        at = 0
        for m in _TAG.finditer(source):
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                self._close(name)
            else:
                self._open(name, m["attrs"])
        if at < len(source):
            self._text(source[at:])

    def _block(self) -> int:
        for e in reversed(self.stack):
            if self.name[e] not in INLINE:
                return e
        return 0

    def _text(self, text: str) -> None:
        if self.drop[self.stack[-1]]:
            return
        self.runs.append((self._block(), html.unescape(text) if "&" in text else text, self.links > 0))

    def _pop_to(self, depth: int) -> None:
        for e in self.stack[depth:]:
            self.links -= self.name[e] == "a"
        del self.stack[depth:]

    def _find(self, names: set[str], stop: frozenset[str]) -> int | None:
        for depth in range(len(self.stack) - 1, 0, -1):
            name = self.name[self.stack[depth]]
            if name in names:
                return depth
            if name in stop:
                return None
        return None

    def _open(self, name: str, attrs: str) -> None:
        if name in VOID:
            if name in ("br", "hr") and not self.drop[self.stack[-1]]:
                self.runs.append((self._block(), " ", False))
            return
        if name == "a" and self.links:
            depth = self._find({"a"}, SCOPES)
            if depth:
                self._pop_to(depth)
        elif name not in INLINE:
            depth = self._find({"p"}, SCOPES)
            if depth:
                self._pop_to(depth)
            if name in ENDS:
                depth = self._find(ENDS[name], SCOPES - ENDS[name])
                if depth:
                    self._pop_to(depth)
        here = self.stack[-1]
        self.name.append(name)
        self.parent.append(here)
        self.drop.append(self.drop[here] or _unwanted(name, attrs))
        self.mark.append(not self.drop[-1] and _marked(name, attrs))
        if not attrs.endswith("/"):
            self.stack.append(len(self.name) - 1)
            self.links += name == "a"

    def _close(self, name: str) -> None:
        if name in INLINE:  # an inline end tag does not reach past its block
            for depth in range(len(self.stack) - 1, 0, -1):
                own = self.name[self.stack[depth]]
                if own == name:
                    return self._pop_to(depth)
                if own not in INLINE:
                    return None
            return None
        depth = self._find({name}, SCOPES - {name} if name in ("p", "li") else frozenset())
        if depth:
            self._pop_to(depth)
        return None


def _drop_marked(page: _Page, worth: dict[int, float]) -> None:
    """Drop what a class word marks, unless it holds the page's article or most of the points."""
    held = [0.0] * len(page.name)
    for block, points in worth.items():
        held[block] += points
    for e in range(len(page.name) - 1, 0, -1):  # parents stand before their children
        held[page.parent[e]] += held[e]
    article = max((e for e, name in enumerate(page.name) if name in ("article", "main") and not page.mark[e] and held[e] > 0),
                  key=lambda e: (held[e], -e), default=0)
    above, at = set(), article
    while at >= 0:
        above.add(at)
        at = page.parent[at]
    in_article = [False] * len(page.name)
    for e in range(1, len(page.name)):
        in_article[e] = not article or e == article or in_article[page.parent[e]]
        most = held[e] > 0.5 * held[0] and in_article[e]
        marked = page.mark[e] and page.name[e] not in KEPT_NAMES and not (article and e in above) and not most
        page.drop[e] = page.drop[e] or marked or page.drop[page.parent[e]]


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source or not source.strip():
        return ""
    page = _Page(source)
    size, linked, commas = {}, {}, {}
    for block, text, link in page.runs:
        n = len(text) if link or not text.isspace() else 0
        size[block] = size.get(block, 0) + n
        commas[block] = commas.get(block, 0) + text.count(",") + text.count("，") + text.count("、")
        if link:
            linked[block] = linked.get(block, 0) + n
    worth = {block: 1 + commas[block] + min(3.0, n / 100) for block, n in size.items() if n}
    if any(page.mark):
        _drop_marked(page, worth)
    points: dict[int, float] = {}
    total, links, held = [0] * len(page.name), [0] * len(page.name), [0.0] * len(page.name)
    for block, value in worth.items():
        if page.drop[block]:
            continue
        at = page.parent[block] if page.name[block] in PARAGRAPHS and block else block
        level = 0
        while at >= 0:
            points[at] = points.get(at, 0.0) + (value if level == 0 else value / 2 if level == 1 else value / (3 * level))
            at, level = page.parent[at], level + 1
        at = block
        while at >= 0:
            total[at] += size[block]
            links[at] += linked.get(block, 0)
            held[at] += value
            at = page.parent[at]
    if not points:
        return ""
    score = {e: p * (1 - links[e] / total[e]) for e, p in points.items()}
    best = max(score, key=lambda e: (score[e], e))
    children: dict[int, list[int]] = {}
    for e in range(1, len(page.name)):
        if total[e] and not page.drop[e]:
            children.setdefault(page.parent[e], []).append(e)

    def poor(length: int, in_links: int) -> bool:
        return length > 0 and (in_links < 0.25 * length if length > 80 else in_links == 0)

    path = [best]  # the best container and its ancestors
    while page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    top = min(1, len(path) - 1)  # up to here, the other children are looked at
    for k in range(1, len(path)):
        others = sum(held[e] for e in children.get(path[k], ()) if e != path[k - 1] and poor(total[e], links[e]))
        if others and (page.name[path[k]] in ("article", "main") or others >= SEVERAL * held[path[k - 1]]):
            top = k
    keep, direct = {best}, set()
    for k in range(1, len(path)):
        here = path[k]
        for e in children.get(here, ()):
            if e != path[k - 1] and (poor(total[e], links[e]) and (k <= top or page.name[e] in HEADINGS)
                                     or k <= top and score.get(e, 0.0) >= 0.2 * score[best]):
                keep.add(e)
        if k <= top and poor(size.get(here, 0), linked.get(here, 0)):
            direct.add(here)
    inside = [False] * len(page.name)
    for e in range(len(page.name)):
        inside[e] = not page.drop[e] and (e in keep or (e > 0 and inside[page.parent[e]]))
    out, last = [], None
    for block, text, _ in page.runs:
        if inside[block] or block in direct:
            if block != last:
                out.append(" ")
                last = block
            out.append(text)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; no shuffle, rows stream in Arrow batches."""
    narrow = pages.select("page_id", "url", F.col(html_col).alias("html"))
    kinds = narrow.schema["page_id"].dataType.simpleString(), narrow.schema["url"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
