"""Main text of web pages by composite text density.

A page is parsed into a tree of elements (implied ends as browsers have them; scripts, styles and other raw
text skipped; an unfinished tag at the end dropped). For every node: characters and tags below it, and the
characters and tags that are in links. Its composite density is

    C/T * log_b( C*T / (LC*LT) )   with   b = ln(C/nLC * LC + LCb/Cb * C + e)

(nLC: characters outside links; b: of the body; each of T, LC, LT and nLC is 1 at least). A node's density
sum is the sum of its children's densities, and its own where it has text of its own; a node without blocks
below it is one paragraph and has its own density only; what marks it up inside is no candidate. The least density on
the path from the node of greatest sum up to below the body is the threshold (the body holds the rest of the page too): every subtree at or above it yields
its node of greatest sum, and the search goes on below. All of this is measured on the whole page, before any
name is looked at. Several found nodes below one container give way to their least common parent (the body is none); what
stands beside a found node is not taken, but for headings before it and a parent that holds nothing else.

Names come after: inside the chosen subtrees, elements that say by tag, role, class or id that they are menus, adverts, forms
and the like are left out, unless they hold half of the chosen text or more. Menus, asides, footers, hidden elements and
comments of readers are no candidates; if nothing but them has text, names of classes count for nothing.

Null or blank html, or a page without text: empty text. Null url stays null. Rows repeat as they come.
Other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .util import map_arrow, texts_of

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|aria-hidden|hidden|type)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|\Z)""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "noframes", "xmp"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a name says of an element: nothing, a word in it hints at noise, it is noise, its class says it is by readers, its tag says it is noise.
CLEAN, HINT, NOISE, READERS, ASIDE = range(5)
#: Share of the threshold for what lies in one container with the node of greatest sum, and the least share of that sum for a
#: lone block elsewhere (a block without blocks has a density that no tags thin out).
WIDEN, LONE = 0.5, 0.25
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "frame"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_ASIDE = {"nav", "footer", "aside", "menu", "dialog", "head", "button", "select", "label"}
_SOFT = {"form", "fieldset", "header"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}
#: Words of class and id values that mark what is not the article.
_WORD = r"(?:ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-bar|aside|footer|masthead|header|topbar|toolbar|comments?|commentlist|disqus|respond|reply|replies|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget\w*|pagination|pager|copyright|legal|disclaimer|paywall|skip\w*)"
_NOISE = re.compile(rf"(?:^|[\s_-]){_WORD}(?:$|[\s_-])", re.I)
#: What may stand before and after such a word in a name that means the whole element.
_BEFORE = r"(?:(?:post|entry|article|page|site|story|single|main|inline|sticky|floating|top|bottom|left|right|google|fb|user|reader|jp|wp|block|btn|js)[_-])*"
_AFTER = r"(?:[_-](?:links?|buttons?|btns?|bar|box|lists?|icons?|posts?|articles?|stories|items?|content|body|title|containers?|wrap|wrapper|block|section|area|slots?|units?|thread|forms?|inner|outer|top|bottom|left|right|tools|module|group|panel|text|message|\d+))*"
_PLAIN = _WORD.replace(r"\w*", "[^\\W_]*")  # no word runs over a delimiter, so that a name is cut up in one way only
_KNOWN = re.compile(rf"{_BEFORE}{_PLAIN}(?:[_-]{_PLAIN})*{_AFTER}", re.I)
#: Names of what readers wrote, whatever elements it is made of.
_READERS = re.compile(rf"{_BEFORE}(?:comments?|commentlist|disqus|respond|reply|replies|(?:reader|user)[_-](?:responses?|reviews?|opinions?|letters?))(?:[_-](?:comments?|respond|reply|replies))*{_AFTER}", re.I)
#: Values that tell a state of an element or of the page, not what the element is.
_STATE = re.compile(r"(?:has|with|without|no|is|show|hide|hides)[_-].*|.*[_-](?:open|opened|closed|enabled|disabled|on|off|active|true|false)", re.I)
#: Inline elements that may be adverts, and their names; links also where they share or skip.
_CARRIERS = {"a", "span", "ins"}
_ADVERT = re.compile(r"ads?|adv|advert[^\W_]*|adsense|ad[_-].*|.*[_-]ads?|sponsor[^\W_]*|promo", re.I)
_SERVICE = re.compile(r"(?:share|skip|comments|reply)(?:[_-].*)?", re.I)
#: Names of heads: of the article if a heading is in them.
_TITLE = re.compile("header|masthead", re.I)
_SAME = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "mark", "head", "out", "nests", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        #: What names say of it, whether they say it is a head, and whether it is left out of the text.
        self.mark, self.head, self.out = CLEAN, False, 0
        #: Whether blocks lie in it.
        self.nests = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(node: Node, attrs: str) -> None:
    """What tag, role, class and id say of a node."""
    tag, mark = node.tag, CLEAN
    if tag in _ASIDE:
        mark = ASIDE
    elif tag in _SOFT:
        mark, node.head = NOISE, tag == "header"
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in _ROLES:
            mark = ASIDE
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            if name == "id" and (tag in _HEADINGS or tag == "section" and not _READERS.fullmatch(value)):
                continue  # an anchor made of the heading's words
            for one in value.split():
                if _STATE.fullmatch(one):
                    continue
                if tag not in _BLOCK:
                    if tag in _CARRIERS and (_ADVERT.fullmatch(one) or tag == "a" and _SERVICE.fullmatch(one)):
                        mark = max(mark, NOISE)
                elif _READERS.fullmatch(one):
                    mark = max(mark, READERS)
                elif tag == "article":
                    continue
                elif _KNOWN.fullmatch(one):
                    node.head = node.head or any(_TITLE.fullmatch(w[0].strip(" _-")) for w in _NOISE.finditer(one))
                    mark = max(mark, NOISE)
                elif _NOISE.search(one):
                    mark = max(mark, HINT)
    node.mark = mark


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = here = Node("body", None)
    at, low = 0, None
    opened: Counter = Counter()

    def leave(to: Node) -> None:
        nonlocal here
        while here is not to:
            opened[here.tag] -= 1
            here = here.parent

    def text(t: str) -> None:
        if t:
            here.kids.append(html.unescape(t))

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return root
        text(page[at : m.start()])
        at = m.end()
        close, tag, attrs, end = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if not tag or not end:
            if m[0].startswith("<![CDATA["):
                here.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag in ("html", "body"):
            continue
        if close:
            up = here if opened[tag] else root  # nothing to close
            while up is not root and up.tag != tag:
                if tag not in _BLOCK and up.tag in _BLOCK:
                    up = root
                    break
                up = up.parent
            if up is not root:
                leave(up.parent)
            elif tag == "p":
                here.kids.append(Node("p", here))
            continue
        if tag in _RAW and not attrs.endswith("/"):
            low = page.lower() if low is None else low
            stop = low.find(f"</{tag}", at) if len(low) == len(page) else _find(page, tag, at)
            at = len(page) if stop < 0 else max(page.find(">", stop) + 1, stop + 1) if page.find(">", stop) >= 0 else len(page)
            continue
        if tag in _BLOCK:  # a block ends an open paragraph, an item the one before it
            shut = _SAME.get(tag, {"p"}) | {"p"}
            stops = _STOPS.get(tag, set())
            up, last = here, None
            while up is not root and up.tag not in stops:
                if up.tag in shut:
                    last = up
                    if up.tag != "p" or tag in ("p",):
                        break
                elif up.tag in _BLOCK and tag not in _STOPS:
                    break
                up = up.parent
            if last is not None:
                leave(last.parent)
        node = Node(tag, here)
        _named(node, attrs)
        here.kids.append(node)
        if tag not in _VOID and not (attrs.endswith("/") and tag not in _BLOCK):
            here = node
            opened[tag] += 1


def _find(page: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.I).search(page, at)
    return m.start() if m else -1


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return order


def measure(root: Node) -> list[Node]:
    order = _nodes(root)
    for n in reversed(order):
        n.chars += sum(len("".join(k.split())) for k in n.kids if isinstance(k, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            p = n.parent
            p.nests = p.nests or n.nests or n.tag in _BLOCK
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags
    share = root.link_chars / max(1, root.chars)
    for n in order:
        if n.chars:
            c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
            base = math.log(c / max(1, c - n.link_chars) * lc + share * c + math.e)
            n.density = c / t * max(0.0, math.log(c / lc * t / lt) / math.log(base)) if c > n.link_chars else 0.0
    for n in order:
        if not n.nests:
            n.total = n.density if n.tag in _BLOCK or n.parent is None or n.parent.nests else 0.0
            continue
        n.total = sum(k.density for k in n.kids if isinstance(k, Node)) + (n.density if any(isinstance(k, str) and k.strip() for k in n.kids) else 0.0)
    return order


def found(order: list[Node], least_mark: int = READERS) -> tuple[Node | None, list[Node]]:
    """(node of greatest density sum, topmost nodes that pass the threshold), names apart but for those marked ``least_mark`` or above."""
    root = order[0]
    apart: set[int] = set()
    for n in order:
        if n.mark >= least_mark or n.parent is not None and id(n.parent) in apart:
            apart.add(id(n))
    total = {id(n): n.total for n in order}
    for p in {id(n.parent): n.parent for n in order if id(n) in apart and n.parent is not None and n.parent.nests}.values():
        rest = sum(k.density for k in p.kids if isinstance(k, Node) and id(k) not in apart)
        total[id(p)] = rest + (p.density if any(isinstance(k, str) and k.strip() for k in p.kids) else 0.0)
    place = {id(n): i for i, n in enumerate(order)}
    peak = {id(n): n for n in order}
    for n in reversed(order):  # children before parents
        if n.parent is not None and id(n) not in apart:
            a, b = peak[id(n)], peak[id(n.parent)]
            if (total[id(a)], place[id(a)]) > (total[id(b)], place[id(b)]):
                peak[id(n.parent)] = a
    best = peak[id(root)]
    if not total[id(best)]:
        return None, []
    trunk = _trunk(root)
    path = _path(best)
    below = path[path.index(trunk) + 1 :] if trunk in path else []
    least = min(n.density for n in below or [best])
    beside: set[int] = {id(below[0])} if below else set()  # what lies in the container of the best node, up to below the trunk
    got: dict[int, Node] = {}
    for n in order:  # below a node that passes the search goes on, for what its peak does not hold
        if n.parent is not None and id(n.parent) in beside:
            beside.add(id(n))
        top = peak[id(n)]
        if id(n) in apart or not total[id(top)]:
            continue
        if n.density >= least * (WIDEN if id(n) in beside else 1) and (top.nests or top is best or id(n) in beside or total[id(top)] >= LONE * total[id(best)]):
            got[id(top)] = top
    return best, _topmost(order, got)


def _trunk(root: Node) -> Node:
    """The body, or the wrapper inside it that has all its text, a menu (a block that is links for the most part) among it."""

    def full(n: Node) -> list:
        return [k for k in n.kids if (k.chars if isinstance(k, Node) else k.strip())]

    trunk = root
    while True:
        kids = full(root)
        if len(kids) != 1 or not isinstance(kids[0], Node):
            return trunk
        root = kids[0]
        if any(isinstance(k, Node) and k.tag in _BLOCK and 2 * k.link_chars >= k.chars for k in full(root)):
            trunk = root


def _path(n: Node) -> list[Node]:
    """From the body down to a node."""
    up = [n]
    while up[-1].parent is not None:
        up.append(up[-1].parent)
    return up[::-1]


def _joined(order: list[Node], top: list[Node], trunk: Node) -> list[Node]:
    """Found nodes, those in one child of the trunk by their least common parent."""
    holds = {id(n): 1 for n in top}
    for n in reversed(order):
        if n.parent is not None and id(n) in holds:
            holds[id(n.parent)] = holds.get(id(n.parent), 0) + holds[id(n)]
    above, found_, out = {id(n) for n in _path(trunk)}, {id(n) for n in top}, []
    stack = [order[0]]
    while stack:
        n = stack.pop()
        if id(n) in found_:
            out.append(n)
            continue
        kids = [k for k in n.kids if isinstance(k, Node) and id(k) in holds]
        if id(n) in above or len(kids) == 1:
            stack.extend(reversed(kids))
        elif kids:
            out.append(n)
    return out


def _heads(n: Node) -> list[Node]:
    """Headings of a block that is one or is the head of something."""
    if n.tag in _HEADINGS:
        return [n]
    if not n.head:
        return []
    return [k for k in _nodes(n) if k.tag in _HEADINGS]


def _before(order: list[Node], top: list[Node]) -> list[Node]:
    """The headings before chosen nodes on the way up to the body: first ones anywhere, others if nothing but headings stands between."""
    on_path = {id(n) for n in top}
    for n in reversed(order):
        if n.parent is not None and id(n) in on_path:
            on_path.add(id(n.parent))
    chosen, got = {id(n) for n in top}, []
    stack = [order[0]]
    while stack:
        n = stack.pop()
        line: list[Node] = []
        for k in n.kids if id(n) not in chosen else ():
            if not isinstance(k, Node) or not k.chars:
                continue
            if id(k) in on_path:
                got += line
                line = []
                stack.append(k)
            else:
                heads = _heads(k) if k.mark < READERS else []
                line = [*(line if heads else [x for x in line if x.tag == "h1"]), *heads]
    return got


def select(root: Node, names: bool = True) -> list[Node]:
    """The subtrees taken as the main text, in page order; what is left out inside them is marked. Without ``names`` density alone decides."""
    order = measure(root)
    best, top = found(order, READERS if names else ASIDE + 1)
    if best is None and names:
        best, top = found(order, ASIDE)
    if best is None:
        return [root] if root.chars and not any(n.mark == ASIDE and n.chars for n in order) else []
    top = _joined(order, top, _trunk(root))
    chosen = {id(n): n for n in top}
    for n in reversed(order):  # a parent that holds nothing beside what is chosen, but for headings and text of its own
        p = n.parent
        if p is not None and id(n) in chosen and all(k is n or not isinstance(k, Node) or not k.chars or id(k) in chosen or k.tag not in _BLOCK or k.tag in _HEADINGS for k in p.kids):
            chosen[id(p)] = p
    top = _topmost(order, chosen)
    chosen = {id(n): n for n in [*top, *_before(order, top)]}
    top = _topmost(order, chosen)
    if names:
        _leave_out(order, top, best)
    return [n for n in top if not n.out]


def _leave_out(order: list[Node], top: list[Node], best: Node) -> None:
    """Mark what names say is no part of the text, unless it holds half of the chosen text or more."""
    half = sum(n.chars for n in top) / 2
    main = {id(n) for n in _path(best)}
    region: dict[int, bool] = {}  # nodes in chosen subtrees; whether the subtree is the one of the best node
    chosen = {id(n) for n in top}
    headed: set[int] = set()
    for n in reversed(order):
        if n.parent is not None and (n.tag in _HEADINGS or id(n) in headed):
            headed.add(id(n.parent))
    for n in order:
        if id(n) in chosen:
            region[id(n)] = id(n) in main or best is n
        elif n.parent is not None and id(n.parent) in region:
            region[id(n)] = region[id(n.parent)]
        else:
            continue
        if n.mark == CLEAN or n.chars >= half and n.mark < READERS or id(n) in main:
            continue
        if n.mark == HINT and region[id(n)]:
            continue  # a word in a name is not enough inside the main text
        if n.head and region[id(n)] and n.mark < READERS and id(n) in headed:
            continue
        n.out = 1


def _topmost(order: list[Node], chosen: dict[int, Node]) -> list[Node]:
    """Of chosen nodes those that lie in no other, in page order."""
    under: set[int] = set()
    top = []
    for n in order:
        if n.parent is not None and (id(n.parent) in under or id(n.parent) in chosen):
            under.add(id(n))
        elif id(n) in chosen:
            top.append(n)
    return top


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, white space as one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        got = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if got:
            out.append(got)

    stack: list = [node]
    while stack:
        k = stack.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            line.append(k)
        elif not k.out:
            if k.tag in ("br", "hr"):
                line.append(" ")
            elif k.tag in _BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(k.kids))
    flush()
    return out


def main_text(page: str, names: bool = True) -> str:
    if not page.strip():
        return ""
    return "\n\n".join(b for n in select(parse(page), names) for b in blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [main_text(p) for p in texts_of(batch.column(2))]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return map_arrow(pages.select("page_id", "url", "html"), make, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
