"""Main text of web pages by tree scoring (operator 5).

Every run of text between block borders is a paragraph.  It earns points for its length and commas, discounted by its
share of link text, and passes them to its container in full and to further ancestors in falling shares.  The container
with the most points, discounted by its own link density, is the article; siblings that score well beside it are kept.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role,
class or id before scoring (if nothing is left then, classes and ids are not looked at), and lists of links beside the article after it.
Every step is linear in the page, however deep its elements nest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeloom.llm.storage import table

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*+(?:>|\Z)
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | <(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$|(?<=["']))""", re.I)
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_LEFT_OUT = frozenset("nav header footer aside form head button select option fieldset input svg canvas object dialog menu video audio map math applet template".split()) | _RAW
#: An opening tag ends an open element of these without an end tag.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
_HOLDS = frozenset("ul ol dl table div section article main body html tr".split())
_PARAGRAPH = frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd td th blockquote figcaption caption address summary".split())
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "announcement disclaimer newsletter subscribe subscription signup login paywall sidebar sidebars side rail menu menus nav navbar navigation breadcrumb breadcrumbs "
    "toolbar topbar masthead header footer foot comment comments commentlist disqus reply replies respond discussion share sharing social related recommended "
    "recommendations teaser popup modal overlay pagination pager widget widgets copyright legal search form skip hidden navigationbar contentinfo complementary dialog".split()
)
#: Words that may stand beside a noise word in a class or id that means noise; any other word gives it another sense.
_LAYOUT = frozenset(
    "top bottom left right main site page global primary secondary mobile desktop sticky fixed inner outer container wrapper wrap holder frame area box block section bar panel module row col "
    "column unit slot list group item items link links posts inline full wide small large first last js id the".split()
)
_MAIN = frozenset("article content main post entry story body text".split())
#: Words that mean reader comments beside any other, but those that tell of a state only ("comments-open").
_COMMENTS = frozenset("comment comments commentlist commenter commenters disqus".split())
_STATES = frozenset("with without has have no open opened closed enabled disabled allow allowed on off".split())
_NEVER = frozenset("html body main article".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _means_noise(value: str) -> bool:
    """Whether a class, id or role holds a token of noise words, with none but layout words beside them, or of comment words."""
    for token in value.split():
        words = {w.lower() for w in _WORDS.findall(token)}
        if words & _COMMENTS:
            if not words & _STATES:
                return True
            continue
        noise = words & _NOISE
        if noise and words <= noise | _LAYOUT and not (words & _MAIN) - _LAYOUT:
            return True
    return False


class _Page:
    """Elements of a page as parallel lists, and its runs of text: [element, pieces, length, link length]."""

    def __init__(self, html: str, by_class: bool = True):
        self.tag, self.parent, self.out, self.bonus, self.by_class = ["html"], [-1], [False], [0.0], by_class
        self.runs: list[list] = []
        # For each element, whether it is in an article, its nearest block and its nearest holder (itself counts).
        self.in_article, self.block, self.holder = [False], [0], [0]
        #: Open elements by name, inline ones by block and name, and by holder and name: tells at once that there is nothing to close.
        self.opened: Counter = Counter()
        self._read(html)

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        out, bonus = self.out[parent] or tag in _LEFT_OUT, 12.0 if tag in ("article", "main") else 0.0
        if tag == "header" and not self.out[parent] and self.in_article[parent]:
            out = False  # an article's own header holds its heading
        if attrs and not out:
            for name, *values in _ATTR.findall(attrs):
                name, value = name.lower(), "".join(values)
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                    out = True
                elif name != "style":
                    if {w.lower() for w in _WORDS.findall(value)} & _MAIN:
                        bonus += 3
                    if self.by_class and tag not in _NEVER and _means_noise(value):
                        out = True
        self.tag.append(tag)
        self.parent.append(parent)
        self.out.append(out)
        self.bonus.append(bonus)
        made = len(self.tag) - 1
        self.in_article.append(tag == "article" or self.in_article[parent])
        self.block.append(self.block[parent] if tag in _INLINE else made)
        self.holder.append(made if tag in _HOLDS else self.holder[parent])
        return made

    def _count(self, node: int, by: int) -> None:
        name, parent = self.tag[node], self.parent[node]
        self.opened[name] += by
        self.opened[self.block[parent], name] += by
        self.opened[-1 - self.holder[parent], name] += by

    def _close(self, node: int, last: int, links: int) -> tuple[int, int]:
        """Closes all from ``node`` up to ``last``: (the element around, open links)."""
        while True:
            self._count(node, -1)
            links -= self.tag[node] == "a"
            up = self.parent[node]
            if node == last:
                return up, links
            node = up

    def _read(self, html: str) -> None:
        at, node, run, links, tag = 0, 0, None, 0, self.tag
        for m, empty in self._tokens(html):
            start = m.start() if m else len(html)
            if start > at and not self.out[node]:
                piece = unescape(html[at:start])
                if run is None:
                    run = [node, [], 0, 0]
                    self.runs.append(run)
                run[1].append(piece)
                size = len(piece.strip())
                run[2] += size
                if links:
                    run[3] += size
            if m is None:
                break
            at = m.end()
            name = m["tag"] or m["tag2"]
            if name is None:
                continue
            name, end = name.lower(), m["end"] or m["end2"]
            if name == "br":
                if run is not None:
                    run[1].append(" ")
                continue
            inline = name in _INLINE
            if not inline:
                run = None
            if end:
                # An inline end tag doesn't close a block.
                if self.opened[(self.block[node], name) if inline else name]:
                    up = node
                    while tag[up] != name:
                        up = self.parent[up]
                    node, links = self._close(node, up, links)
                elif name == "p":
                    run = None
                continue
            if not inline:
                closes = _ENDS.get(name, ())
                holder = self.holder[node]
                if tag[holder] in closes or any(self.opened[-1 - holder, x] for x in ("p", *closes)):
                    up = node
                    while up > 0 and tag[up] != "p" and tag[up] not in closes:
                        up = self.parent[up]
                    if up > 0:
                        node, links = self._close(node, up, links)
            made = self._open(name, m["attrs"] or m["attrs2"] or "", node)
            if name not in _VOID and not empty:
                if name == "a":
                    links += 1
                node = made
                self._count(made, 1)

    @staticmethod
    def _tokens(html: str) -> Iterator[tuple[re.Match | None, bool]]:
        """Tokens, and whether they are elements without contents; contents of raw elements are passed over, whatever their spelling.

        A raw element without an end tag reaches to the page's end; if it closes itself, it has no contents.
        """
        at, unclosed = 0, set()
        while m := _TOKEN.search(html, at):
            at, empty = m.end(), False
            name = (m["tag"] or m["tag2"] or "").lower()
            if name in _RAW and not (m["end"] or m["end2"]):
                close = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                if close:
                    at = close.start()
                else:
                    unclosed.add(name)
                    empty = (m["attrs"] or m["attrs2"] or "").endswith("/")
                    at = at if empty else len(html)
            yield m, empty
        yield None, False


#: What reaches a container of a run's points, by the containers between.
_SHARES = (1, 2, 6, 9, 12, 15)


def _weigh(page: _Page, runs: list[tuple[int, str, int, int]]) -> tuple[list[float], list[int], list[int]]:
    """Score, characters and link characters of each element; from the leaves up, by level."""
    n = len(page.tag)
    chars, links, score = [0] * n, [0] * n, [0.0] * n
    fresh = [0.0] * n  # points that haven't left their paragraph
    levels: list[list[float] | None] = [None] * n  # points by the number of containers that they have passed
    for node, text, size, linked in runs:
        fresh[node] += (len(text) / 100 + text.count(",") + text.count("，") + text.count("、") + 0.2) * (1 - min(1.0, linked / size))
        chars[node] += size
        links[node] += linked
    for node in range(n - 1, -1, -1):
        if not chars[node]:
            continue
        kind, up, have = page.tag[node], page.parent[node], levels[node] or [0.0] * 6
        score[node] = sum(x / share for x, share in zip(have, _SHARES, strict=True))
        passed = [0.0, *have[:4], have[4] + have[5]]
        own = fresh[node]
        if kind in _INLINE:
            pass
        elif kind in _PARAGRAPH:
            passed[0] += own
            own = 0.0
        else:
            score[node] += own
            passed[1] += own
            own = 0.0
        if up >= 0:
            chars[up] += chars[node]
            links[up] += links[node]
            fresh[up] += own
            above = levels[up]
            levels[up] = passed if above is None else [x + y for x, y in zip(above, passed, strict=True)]
        levels[node] = None
    return score, chars, links


def _runs(page: _Page) -> list[tuple[int, str, int, int]]:
    texts = ((node, " ".join("".join(pieces).split()), size, linked) for node, pieces, size, linked in page.runs)
    return [(node, text, max(size, 1), linked) for node, text, size, linked in texts if text]


def extract(html: str | None) -> str:
    """The main text of a page: blocks in page order, each with single spaces, joined by newlines; empty if there is none."""
    if not html:
        return ""
    page = _Page(html)
    runs = _runs(page)
    if not runs:
        page = _Page(html, by_class=False)
        runs = _runs(page)
    if not runs:
        return ""
    parent, tag = page.parent, page.tag
    score, chars, links = _weigh(page, runs)
    density = lambda n: links[n] / max(chars[n], 1)
    worth = {n: (score[n] + page.bonus[n]) * (1 - density(n)) for n in range(len(tag)) if chars[n] and (tag[n] not in _PARAGRAPH and tag[n] not in _INLINE or score[n])}
    best = max(worth, key=lambda n: (worth[n], -n)) if worth else 0
    keep, floor = {best}, max(10.0, 0.2 * worth.get(best, 0.0))
    article = tag[best] in ("article", "main")
    if not article and tag[best] not in ("html", "body"):
        beside = [n for n in range(len(tag)) if chars[n] and parent[n] == parent[best]]
        keep |= {n for n in beside if worth.get(n, 0) >= floor or tag[n] == "p" and chars[n] > 80 and density(n) < 0.25 or tag[n] == "h1" and n < best}
        # Headings, lists and other short blocks between those that stay.
        low, high = min(keep), max(keep)
        keep |= {n for n in beside if low < n < high and density(n) <= 0.5}
    stays = [False] * len(tag)
    for n in range(len(tag)):
        up = parent[n]
        stays[n] = n in keep or up >= 0 and stays[up] and (article or not (tag[n] in _HOLDS and chars[n] and density(n) > 0.5))
    return "\n".join(text for node, text, _, _ in runs if stays[node])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    A null, empty or tagless html gives what text it has, else the empty text and 0.  Repeated rows and null ids are extracted each; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [extract(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_html_extraction over the whole of ``pages``."""
    return main_texts(table(spark, sf_dir, "pages"))
