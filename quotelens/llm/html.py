"""Main text of web pages by composite text density.

Each node of the page's tree has a composite density: its characters per tag, adjusted by how
much of its text is in links, and by how that compares with the page's body. A node's density sum
adds the densities of its children. The node below the body with the greatest sum is the core, and
the least density on the path from the body to it is the threshold: around the core, what reaches
the threshold belongs to the main text and what does not is left out. Lists of elements and names
(menus, adverts, forms, comments and the like) set parts aside before; a list of names that would
empty the page, or that holds the page's article, gives way.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from functools import cache
from html import unescape

from pyspark.sql import DataFrame

from quotelens.llm.common import map_texts

#: Elements whose content is never text.
SILENT = frozenset("script style noscript template svg math canvas iframe object audio video head title textarea select button".split())
#: Elements that are set aside.
ASIDE = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
#: Words of class and id names that mark what is set aside.
NOISE = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar aside header masthead footer comment comments disqus respond reply replies discussion "
    "cookie cookies consent notice notices popup modal newsletter subscribe signup login search share sharing social "
    "related recommended recommendations widget toolbar pagination pager skip gdpr paywall".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul br caption".split()
)
#: What an opening tag closes: the open element of the first set, up to one of the second.
_P_ENDERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: An end tag does not close elements beyond these.
SCOPE = frozenset("html body table td th article main section div".split())
RAW = frozenset("script style textarea title noscript template iframe".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    # quotes delimit a value right after = only
    r"|<([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*|))*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


#: Why a node is set aside: not at all, by its class or id, or by what it is.
STAYS, NAMED, ASIDE_ANYWAY, NO_TEXT = range(4)


class Node:
    __slots__ = ("tag", "parent", "kids", "off", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, off: int = STAYS):
        self.tag, self.parent, self.off = tag, parent, off
        self.kids: list = []  # nodes and strings
        self.clear()

    def clear(self) -> None:
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _set_aside(tag: str, attrs: str) -> int:
    """Whether and why an element is a part that is set aside."""
    if tag in SILENT:
        return NO_TEXT
    if tag in ASIDE:
        return ASIDE_ANYWAY
    if not attrs or tag in ("html", "body", "article", "main"):
        return STAYS
    off = STAYS
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return ASIDE_ANYWAY
        if name == "role" and value in ROLES:
            return ASIDE_ANYWAY
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return ASIDE_ANYWAY
        if name in ("class", "id") and not NOISE.isdisjoint(_NAME.findall(value)):
            off = NAMED
    return off


class _Open:
    """The elements that are open, with the places of each tag, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}
        self.scopes: list[int] = [0]
        self.ends_p: list[int] = [0]

    def push(self, x: Node) -> None:
        k = len(self.stack)
        self.stack.append(x)
        self.at.setdefault(x.tag, []).append(k)
        if x.tag in SCOPE:
            self.scopes.append(k)
        if x.tag in SCOPE or x.tag in _P_ENDERS:
            self.ends_p.append(k)

    def close(self, k: int) -> None:
        """Close the element at place k and all that it holds."""
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()
        for places in (self.scopes, self.ends_p):
            while places[-1] >= k:
                places.pop()

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0


def parse(page: str) -> Node:
    """The tree of a page, in time linear in its length. Unclosed elements end where HTML lets them;
    nothing is dropped."""
    root = Node("#page", None)
    opened = _Open(root)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        node = opened.stack[-1]
        if m is None:
            node.kids.append(page[at:])
            break
        if m.start() > at:
            node.kids.append(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in VOID:
                if tag == "br":
                    node.kids.append(Node("br", node))
                continue
            k = opened.last(tag)
            if k and (tag in SCOPE or opened.scopes[-1] < k):
                opened.close(k)
            elif tag == "p":
                node.kids.append(Node("br", node))
        elif m[2]:
            tag, attrs = m[2].lower(), m[3] or ""
            if tag in _P_ENDERS and opened.stack[opened.ends_p[-1]].tag == "p":
                opened.close(opened.ends_p[-1])
            if tag in IMPLIED:
                ended, stop = IMPLIED[tag]
                floor = max(map(opened.last, stop))
                found = [p[i] for t in ended if (p := opened.at.get(t)) and (i := bisect_right(p, floor)) < len(p)]
                if found:
                    opened.close(min(found))
            node = opened.stack[-1]
            child = Node(tag, node, _set_aside(tag, attrs))
            node.kids.append(child)
            if tag in VOID or attrs.rstrip().endswith("/") and tag in SILENT:
                continue
            if tag in RAW:  # the content of these is not markup
                end = _raw_end(tag).search(page, at)
                child.kids.append(page[at : end.start() if end else n])
                at = end.end() if end else n
                continue
            opened.push(child)
    return root


@cache
def _raw_end(tag: str):
    return re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I)


def measure(root: Node) -> list[Node]:
    """Fill in characters, tags and densities from the leaves up; returns the nodes that are text,
    parents first. What is set aside has no characters and is no node here.

    Where a text has no links, the published formula takes a logarithm to the base 1; 1 is added on both
    sides of the fraction to keep it finite, which leaves the order of densities alone."""
    order: list[tuple[Node, bool]] = [(root, False)]
    nodes = []
    for x, in_link in order:  # grows while it is walked: no recursion, however deep the page
        nodes.append(x)
        x.clear()
        for k in x.kids:
            if isinstance(k, Node):
                if not k.off:
                    order.append((k, in_link or k.tag == "a"))
            elif k:
                c = len(_SPACE.sub("", unescape(k) if "&" in k else k))
                x.chars += c
                if in_link:
                    x.link_chars += c
    for x in reversed(nodes):
        p = x.parent
        if p is not None:
            p.chars += x.chars
            p.link_chars += x.link_chars
            p.tags += x.tags + 1
            p.link_tags += x.link_tags + (x.tag == "a")
    body = next((x for x in nodes if x.tag == "body"), root)
    whole = max(body.chars, 1)
    for x in nodes:
        if not x.chars:
            continue
        tags, plain = max(x.tags, 1), max(x.chars - x.link_chars, 1)
        base = math.log(x.chars / plain * x.link_chars + body.link_chars / whole * x.chars + math.e)
        ratio = x.chars / max(x.link_chars, 1) * tags / max(x.link_tags, 1)
        x.density = x.chars / tags * (math.log(max(ratio, 1.0) + 1) / math.log(base + 1))
    for x in nodes:
        if x.parent is not None:
            x.parent.total += x.density
    return nodes


def core(nodes: list[Node]) -> tuple[Node, set[Node]]:
    """(the subtree of the main text, what is left out of it).

    The core is the node below the body with the greatest density sum. An article or main element
    around it is whole. Else the subtree grows from the core to the parent while anything beside it
    reaches the threshold, or is a heading or a paragraph of its own words; what is beside it and does
    not is left out.
    """
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    inside = [x for x in nodes if x.chars and x is not body and x.tag not in ("#page", "html")]
    if not inside:
        return body, set()
    best = max(inside, key=lambda x: (x.total, x.density))
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    for x in path:
        if x.tag in ("article", "main"):
            return x, set()
    left_out: set[Node] = set()
    found = best
    for p in path[1:]:
        beside = [k for k in p.kids if isinstance(k, Node) and k is not found and not k.off and k.chars]
        # an element's link share tells lists of links, whose density a long body path can make low
        low = {k for k in beside if k.tag not in HEADINGS and (k.link_chars * 2 > k.chars or k.density < threshold and k.tag not in PROSE)}
        if len(low) == len(beside) and not any(isinstance(k, str) and k.strip() for k in p.kids):
            if beside:
                break
        found = p
        left_out |= low
    return found, left_out


PROSE = frozenset("p blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def blocks(node: Node, left_out: set[Node] = frozenset()) -> list[str]:
    """Texts of the blocks below a node, in page order, without those left out."""
    out: list[str] = []
    now: list[str] = []

    def close():
        text = _SPACE.sub(" ", unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    stack: list = [(node, 0)]
    while stack:
        x, i = stack.pop()
        if i == 0 and x.tag in BLOCKS:
            close()
        if i < len(x.kids):
            stack.append((x, i + 1))
            k = x.kids[i]
            if isinstance(k, str):
                now.append(k)
            elif k.tag == "br":
                close()
            elif not k.off and k not in left_out:
                stack.append((k, 0))
        elif x.tag in BLOCKS:
            close()
    close()
    return out


def _release(root: Node, why: int) -> bool:
    """Let nodes set aside for `why` count again; whether there are any."""
    found, todo = False, [root]
    for x in todo:
        if x.off == why:
            x.off, found = STAYS, True
        todo += [k for k in x.kids if isinstance(k, Node) and k.off != NO_TEXT]
    return found


def _keep_articles(root: Node) -> None:
    """A node set aside by a name alone counts if it holds an article or main element."""
    todo = [root]
    for x in todo:
        if x.tag in ("article", "main"):
            p = x.parent
            while p is not None and p.off <= NAMED:
                p.off, p = STAYS, p.parent
        else:
            todo += [k for k in x.kids if isinstance(k, Node) and k.off <= NAMED]


def extract(page: str | None) -> str:
    """Main text: blocks joined by one newline; empty for a null or empty page. Where all text is
    set aside by names, the names do not count; where by what the elements are, that does not."""
    if not page:
        return ""
    root = parse(page)
    _keep_articles(root)
    for why in (STAYS, NAMED, ASIDE_ANYWAY):
        if why == STAYS or _release(root, why):
            found = "\n".join(blocks(*core(measure(root))))
            if found or why == ASIDE_ANYWAY:
                return found
    return ""


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of pages with text and n_chars (code points). Null html is an empty page;
    pages are parsed whole, one by one; repeated rows are extracted alike; an empty table gives no
    rows. Columns called like an output column give way."""

    def make():
        def run(values):
            texts = [extract(v) for v in values]
            return texts, [len(t) for t in texts]

        return run

    return map_texts(pages, make, "text string, n_chars long", [c for c in keep if c not in ("text", "n_chars")], column="html")
