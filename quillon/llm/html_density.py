"""Main text of a page by composite text density.

The page is read into a tree the way browsers do it (void elements, implied ends
of paragraphs, list items and table parts, raw text of scripts and styles).
Elements whose tag or role says that they are no article text fall out, and so do
forms and boxes of a class or id with such a word, but those that hold the
page's longest article or main or, on a page without one, most of the text.
For each node of the rest, with C characters and T tags under it, LC and LT of
them in links, and Cb, LCb of the body, the composite density is

    C/T * log(C/LC * T/LT) / log(ln(C/(C-LC) * LC + LCb/Cb * C + e))

(Sun, Song and Liao, 2011; quotients with a zero below count as over one, and one
is added under the last logarithm so that it isn't zero). The sum of the densities
of its children, its own runs of text among them, makes a node's density sum.

The node of the largest sum is content, and the least density on its path to the
body is the threshold. A node that reaches the threshold adds the node of the
largest sum under it, and so on down. The text is that of the smallest node which
holds SHARE of the characters found so (those in links aside), or of the article or main around it. Lists
of links below the threshold are left out of it; its text is taken block by block.

Defined cases: a null or empty page, or one without text, gives an empty string;
markup that doesn't end, or ends twice, is read as far as it goes; repeated rows
and null ids each give a row; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import gc
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A whole tag without attributes, as most are.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)>")
#: What follows a tag's name, up to its end.
_REST = re.compile(r"[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: White space of HTML and of Unicode, the joiners aside.
_SPACE = re.compile(r"\s+")

# Elements of HTML by what they do to the tree and to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table article section div body html td th main aside nav header footer form blockquote figure".split())
DROPPED = frozenset("nav footer aside button select input dialog menu script style noscript iframe template textarea title head object embed svg math".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments commentlist disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup paywall sidebar sidenav side-bar menu nav navbar navigation toolbar footer foot masthead header topbar related recommended recommendations share sharing social widget pagination pager skip".split()
)
#: Elements that only hold others; a listed class says nothing about a heading or paragraph.
BOXES = frozenset("div section ul ol dl table form fieldset figure center details iframe span p".split())
#: Of the words, those that an article's own paragraphs carry.
MILD_WORDS = frozenset("notice notices alert header footer foot related recommended share sharing social promo promotion banner widget skip overlay menu".split())
_KEPT_INSIDE = frozenset(("article", "main"))
#: Share of the found characters that the text's node holds at least.
SHARE = 0.8
#: Open elements that an end tag looks back over, as deep as browsers nest them.
DEPTH = 512


class _Node:
    __slots__ = ("tag", "parent", "parts", "chars", "links", "tags", "link_tags", "density", "total", "best", "doubtful", "inside")

    def __init__(self, tag: str, parent):
        self.tag, self.parent, self.parts, self.doubtful = tag, parent, [], False
        self.inside = parent is not None and (parent.inside or parent.tag in _KEPT_INSIDE)


def _is_dropped(tag: str, attributes: str, node: _Node) -> bool:
    if tag in DROPPED or tag == "header" and not (node.inside or node.tag in _KEPT_INSIDE):
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in DROPPED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _is_doubtful(tag: str, attributes: str) -> bool:
    """Whether the element falls out unless it wraps the article."""
    if tag not in BOXES or not attributes:
        return False
    listed = DROPPED_WORDS - MILD_WORDS if tag in ("p", "span") else DROPPED_WORDS
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id") and (not listed.isdisjoint(value.split()) or not listed.isdisjoint(re.split(r"[\s_\-]+", value))):
            return True
    return False


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, whether an end tag, name, attributes) of tags; markup without a name has an empty one.

    ``send(at)`` goes on from there. A tag whose quotes don't end is taken up to its
    first >, and from then on quotes aren't looked at, so a page is read once.
    """
    at, n, last, strict = 0, len(page), page.rfind(">"), True
    while (begin := page.find("<", at)) >= 0:
        if m := _PLAIN.match(page, begin):
            moved = yield begin, m.end(), m[1] == "/", m[2].lower(), ""
            at = m.end() if moved is None else moved
            continue
        after = page[begin + 1 : begin + 2]
        closing = after == "/"
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            found = (begin, n if end < 0 else end + 3, False, "", "")
        elif m := _NAME.match(page, begin + 1 + closing):
            if begin > last:
                found = (begin, n, False, "", "")
            else:
                rest = _REST.match(page, m.end()) if strict else None
                strict = rest is not None
                end = rest.end() if strict else page.find(">", m.end()) + 1
                found = (begin, end, closing, m[0].lower(), page[m.end() : end - 1])
        elif after and after in "!?/":
            end = page.find(">", begin)
            found = (begin, n if end < 0 else end + 1, False, "", "")
        else:
            at = begin + 1
            continue
        moved = yield found
        at = found[1] if moved is None else moved


def parse(page: str) -> _Node:
    """The tree without what is dropped. Parts of a node are nodes and decoded strings."""
    root = _Node("html", None)
    node = root
    dropped: list[str] = []  # open elements from a dropped one on
    open_in_dropped: Counter = Counter()
    at, tags, moved = 0, _tags(page), None
    while True:
        try:
            begin, end, closing, tag, attributes = tags.send(moved)
        except StopIteration:
            begin, tag, end = len(page), None, len(page)
        moved = None
        if begin > at and not dropped:
            node.parts.append(html.unescape(page[at:begin]))
        at = end
        if tag is None:
            break
        if not tag:
            continue
        if closing:
            if dropped:
                if open_in_dropped[tag]:
                    while (gone := dropped.pop()) != tag:
                        open_in_dropped[gone] -= 1
                    open_in_dropped[tag] -= 1
                continue
            up = node
            for _ in range(DEPTH):
                if up is root or up.tag == tag or tag in INLINE and up.tag in SCOPE:
                    break
                up = up.parent
            if up.tag == tag and up is not root:
                node = up.parent
            elif tag in ("br", "p"):
                node.parts.append(_Node(tag, node))
            continue
        if dropped:
            if tag in RAW:
                at = moved = _raw_end(page, at, tag)
            elif tag not in VOID and not attributes.endswith("/"):
                if tag in ENDS_P and open_in_dropped["p"] and dropped[0] != "p":
                    while (gone := dropped.pop()) != "p":
                        open_in_dropped[gone] -= 1
                    open_in_dropped["p"] -= 1
                elif dropped[-1] in SAME_ENDS.get(tag, ()) and len(dropped) > 1:
                    open_in_dropped[dropped.pop()] -= 1
                dropped.append(tag)
                open_in_dropped[tag] += 1
            continue
        if tag in ENDS_P:
            node = _ended(node, ("p",))
        elif tag in SAME_ENDS:
            node = _ended(node, SAME_ENDS[tag])
        if tag in ("html", "body"):
            if tag == "body" and node is root:
                body = _Node("body", root)
                root.parts.append(body)
                node = body
        elif tag in RAW:
            at = moved = _raw_end(page, at, tag)
        elif tag in VOID:
            if tag in ("br", "hr"):
                node.parts.append(_Node(tag, node))
        elif _is_dropped(tag, attributes, node):
            dropped, open_in_dropped = [tag], Counter((tag,))
        else:
            child = _Node(tag, node)
            if attributes or tag == "form":
                child.doubtful = tag == "form" or _is_doubtful(tag, attributes)
            node.parts.append(child)
            node = child
    _prune(root)
    return root


def _prune(root: _Node) -> None:
    """Cuts doubtful elements, but those that hold the page's longest article or main or, without one, most of the text."""
    nodes, stack, doubtful = [], [root], False
    while stack:
        node = stack.pop()
        nodes.append(node)
        doubtful = doubtful or node.doubtful
        if node.parts:
            stack += [p for p in reversed(node.parts) if type(p) is not str]
    if not doubtful:
        return
    for node in nodes:
        node.chars = sum([_text_size(p) for p in node.parts if type(p) is str]) if node.parts else 0
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
    up, holders = max((x for x in nodes if x.tag in _KEPT_INSIDE), key=lambda x: x.chars, default=None), set()
    marked = up is not None
    while up is not None:
        holders.add(up)
        up = up.parent
    cut = {x for x in nodes if x.doubtful and (x not in holders if marked else 2 * x.chars <= root.chars)}
    for node in nodes:
        if not cut.isdisjoint(node.parts):
            node.parts = [p for p in node.parts if type(p) is str or p not in cut]


def _raw_end(page: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
    return m.end() if m else len(page)


def _ended(node: _Node, tags: tuple[str, ...]) -> _Node:
    """The open element after an implied end of the innermost of ``tags`` in scope."""
    up = node
    for _ in range(DEPTH):
        if up is None or up.tag not in tags and up.tag in SCOPE:
            break
        if up.tag in tags:
            return up.parent
        up = up.parent
    return node


def density(chars: int, links: int, tags: int, link_tags: int, share: float) -> float:
    """Composite density; ``share``: of the body's characters those in links."""
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(links, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    return chars / t * math.log(max(chars / lc * t / lt, 1.0)) / math.log(base + 1.0)


def _text_size(part: str) -> int:
    return len(_SPACE.sub(" ", part).strip())


def _measure(root: _Node) -> tuple[list[_Node], _Node]:
    """All nodes in page order with counts, densities, sums and the best node under each, and the body."""
    nodes, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        nodes.append(node)
        node.chars = node.links = node.tags = node.link_tags = 0
        node.total = ()  # for the time being: the sizes of its own runs
        if not node.parts:
            continue
        in_link = in_link or node.tag == "a"
        node.total = [_text_size(p) for p in node.parts if type(p) is str]
        node.chars = sum(node.total)
        node.links = node.chars if in_link else 0
        stack += [(p, in_link) for p in reversed(node.parts) if type(p) is not str]
    for node in reversed(nodes):
        up = node.parent
        if up is not None:
            if node.chars:
                up.chars += node.chars
                up.links += node.links
            up.tags += node.tags + 1
            if node.link_tags or node.tag == "a":
                up.link_tags += node.link_tags + (node.tag == "a")
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.links / max(body.chars, 1)
    for node in reversed(nodes):  # children come before their parents
        if not node.chars:  # nothing under it has a density, and the first of the deepest is best
            node.density = node.total = 0.0
            node.best = next((p.best for p in node.parts if type(p) is not str), node) if node.parts else node
            continue
        in_link = node.tag == "a" or node.links == node.chars > 0
        children = [p for p in node.parts if type(p) is not str]
        node.density = density(node.chars, node.links, node.tags, node.link_tags, share)
        node.total = sum(p.density for p in children) + sum(density(c, c if in_link else 0, 0, 0, share) for c in node.total)
        node.best = max([*(p.best for p in children), node], key=lambda x: x.total)  # of equals the deeper one
    return nodes, body


def _found(body: _Node) -> tuple[set[_Node], float]:
    """The roots of the subtrees that are content, and the threshold."""
    path = [body.best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    found, stack = set(), [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold and node.chars:
            found.add(node.best)
            stack += [p for p in node.parts if type(p) is not str]
    return found, threshold


def main_node(root: _Node) -> tuple[_Node, float] | None:
    """The node whose subtree is the article, and the threshold."""
    nodes, body = _measure(root)
    if not body.chars:
        return None
    found, threshold = _found(body)
    held = dict.fromkeys(nodes, 0)  # found characters under each node, those in links aside
    for node in nodes:  # parents come first
        if node.parent is not None and node.parent in found:
            found.add(node)  # a part of a subtree that is content
        if node in found:
            held[node] = 0 if node.links == node.chars else sum(_text_size(p) for p in node.parts if type(p) is str)
    for node in reversed(nodes):
        if node.parent is not None:
            held[node.parent] += held[node]
    node = body
    while held[body]:
        heavy = [p for p in node.parts if type(p) is not str and p.tag not in INLINE and held[p] >= SHARE * held[body]]
        if not heavy:
            break
        node = heavy[0]
    around = node
    for _ in range(DEPTH):
        if around is None or around.tag in _KEPT_INSIDE:
            break
        around = around.parent
    return around if around is not None and around.tag in _KEPT_INSIDE else node, threshold


def _is_link_list(node: _Node, threshold: float) -> bool:
    """Whether a box under the text's node is but links below the threshold."""
    return node.tag in ("ul", "ol", "div", "section", "table", "dl", "p") and node.density < threshold and node.link_tags > 1 and 3 * node.links >= 2 * node.chars


def blocks(node: _Node, threshold: float = 0.0) -> list[str]:
    """The text of a subtree, one string for each block, without empty ones and lists of links below the threshold."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif type(x) is str:
            line.append(x)
        elif x.tag in INLINE:
            stack += reversed(x.parts)
        else:
            end()
            if x is node or not _is_link_list(x, threshold):
                stack.append(None)
                stack += reversed(x.parts)
    end()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    collects = gc.isenabled()
    gc.disable()  # no node is garbage before the text is out, so looking for some would only take time
    try:
        found = main_node(parse(page))
        return "\n".join(blocks(*found)) if found is not None else ""
    finally:
        if collects:
            gc.enable()


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
