"""Pages as trees of blocks, and what of them is article by their markup.

A page is read tag by tag into a tree of block elements. Inline elements dissolve into the text of
their block; a text leaf is a stretch of text between the tags of blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|itemprop|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")

# Element names of HTML by what they do here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript xmp template svg math".split())
#: Never article, whatever stands in them.
DROPPED = frozenset("nav footer aside form button select object canvas video audio dialog menu search head datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Class and id names that say the same, alone or with QUALIFIERS ("cookie-notice", "sidebar_left"), and those that also say it of an article element.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu sidebar footer masthead breadcrumb breadcrumbs cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription signup share sharing social comment comments disqus related recommended recommendations widget widgets toolbar pagination pager login".split())
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo comment comments related recommended teaser widget".split())
QUALIFIERS = frozenset("area banner bar block box button buttons container form inner item items left links list main outer panel right section site slot thread top bottom unit wrap wrapper".split())
#: Elements that a class name takes out: a paragraph or heading of the text is none.
BOXES = frozenset("div section ul ol dl table aside header footer figure span iframe ins fieldset article details center li".split())
HEADER_MARKS = frozenset("header topbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends: the open element of the first names, not beyond the second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("td th table caption button object html".split())


class Node:
    """A block element, or with text a leaf."""

    __slots__ = ("tag", "above", "children", "text", "linked", "kind", "place", "said", "rooted")

    def __init__(self, tag: str, above: Node | None, kind: str = ""):
        self.tag, self.above, self.kind = tag, above, kind
        self.children: list[Node] = []
        self.text, self.linked, self.place, self.said = "", 0, -1, (0, 0)
        self.rooted = kind == "root" or (above is not None and above.rooted)


def _says(names: set[str], marks: frozenset) -> bool:
    """Whether a name is one of marks, or made of them and qualifiers only."""
    for name in names:
        parts = _WORDS.findall(name)
        if any(x in marks for x in parts) and all(x in marks or x in QUALIFIERS for x in parts):
            return True
    return False


def _kind(tag: str, raw: str) -> str:
    """drop: no article; head: only its headings are; root: a likely article; else empty."""
    if tag in DROPPED:
        return "drop"
    kind = "root" if tag in ("article", "main") else "head" if tag == "header" else ""
    if raw:
        names: set[str] = set()
        for name, value in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                names.update(value.split())
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return "drop"
            elif name == "role":
                if value in ROLES:
                    return "drop"
                kind = "root" if value in ("main", "article") else kind
            elif name == "itemprop" and value == "articlebody":
                kind = "root"
        if tag in BOXES and _says(names, ARTICLE_MARKS if kind == "root" else MARKS):
            return "drop"
        if not kind and tag in BOXES and _says(names, HEADER_MARKS):
            kind = "head"
    return kind


def parse(html: str) -> Node:
    """The tree of a page; it never fails, whatever the markup, and nesting has no limit."""
    root = Node("#page", None)
    stack: list[tuple[str, Node]] = [("#page", root)]  # open elements; inline ones have their block's node
    opened: Counter[str] = Counter()  # names on the stack
    runs: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if runs:
            text = " ".join(unescape("".join(runs)).split())
            runs.clear()
            if text:
                leaf = Node("#text", stack[-1][1])
                leaf.text, leaf.linked = text, linked
                stack[-1][1].children.append(leaf)
        linked = 0

    def close(k: int) -> None:
        """End the elements from place k of the stack on."""
        nonlocal in_link
        if any(n in BLOCKS or m is not stack[k - 1][1] for n, m in stack[k:]):
            flush()
        opened.subtract(n for n, _ in stack[k:])
        in_link = opened["a"]
        del stack[k:]

    def ended(names: frozenset | set, stops: frozenset | set) -> None:
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                close(k)
                return
            if stack[k][0] in stops:
                return

    at, lower = 0, None
    while (m := _TAG.search(html, at)) is not None:
        if m.start() > at:
            runs.append(html[at : m.start()])
            linked += (m.start() - at) if in_link else 0
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending = name.lower(), bool(m[1] or m[4])
        if ending:
            if tag == "br":
                runs.append(" ")
            elif tag in BLOCKS or tag in DROPPED:
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[k][0] == tag:
                        close(k)
                        break
                else:
                    flush()
            elif opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
            continue
        if tag in RAW:
            lower = html.lower() if lower is None else lower
            if not (m[3] or m[6] or "").endswith("/") or tag not in ("svg", "math"):
                end = lower.find(f"</{tag}", at)
                at = len(html) if end < 0 else end
                shut = html.find(">", at)
                at = len(html) if shut < 0 else shut + 1
            continue
        if tag in VOID:
            if tag == "br":
                runs.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in ENDS:
            ended(*ENDS[tag])
        raw = m[3] or m[6] or ""
        block = tag in BLOCKS
        if block:
            ended({"p"}, SCOPE)
            if tag in HEADINGS and stack[-1][0] in HEADINGS:
                close(len(stack) - 1)
        kind = _kind(tag, raw) if block or raw or tag in DROPPED else ""
        if block or kind == "drop":
            flush()
            node = Node(tag, stack[-1][1], kind)
            stack[-1][1].children.append(node)
            stack.append((tag, node))
        else:
            stack.append((tag, stack[-1][1]))
        opened[tag] += 1
        in_link = opened["a"]
    if at < len(html):
        runs.append(html[at:])
    flush()
    return root


def ordered(root: Node) -> list[Node]:
    """All nodes in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


def weighed(nodes: list[Node], mass: dict[int, float]) -> dict[int, float]:
    """The mass of each node with all below it; nodes in page order."""
    total = {id(x): mass.get(id(x), 0.0) for x in nodes}
    for x in reversed(nodes):
        if x.above is not None and id(x.above) in total:
            total[id(x.above)] += total[id(x)]
    return total


def said_to_go(nodes: list[Node]) -> set[int]:
    """Leaves that the markup says are no article: below an element to drop, or below a header and in no heading.

    What holds more than half of the page's text outside links is not dropped, whatever the markup says.
    """
    plain = {id(x): float(len(x.text)) if x.linked <= len(x.text) / 2 else 0.0 for x in nodes if x.tag == "#text"}
    total = weighed(nodes, plain)
    half = total[id(nodes[0])] / 2
    state: dict[int, int] = {}  # of an element: 0 nothing, 1 head, 2 drop
    gone = set()
    for x in nodes:
        above = state.get(id(x.above), 0) if x.above is not None else 0
        if x.tag == "#text":
            if above == 2 or (above == 1 and x.above.tag not in HEADINGS):
                gone.add(id(x))
            continue
        own = 0
        if x.kind in ("drop", "head") and not (half and total[id(x)] > half):
            own = 2 if x.kind == "drop" or (x.above.tag in ("body", "html", "#page")) else 1
        state[id(x)] = max(above, own)
    return gone


#: What may hold an article, and the share of the text that has to be in one of the elements below for it to be looked for there.
HOLDERS = frozenset("#page html body center main article section div table tbody tr td form fieldset".split())
MOST = 0.6
#: What text in a likely article weighs against other text.
ROOTED = 25.0


def region(nodes: list[Node], mass: dict[int, float]) -> tuple[list[tuple[int, int]], bool]:
    """Where the article is: spans [first, last] of places in page order, and whether in them only likely articles count.

    mass: of each element the text of its own that counts. From the page down, the element is taken
    that holds most of it; then markup refines: the likely article around it is taken whole, or, if
    likely articles below hold half of it, those alone. A main heading before it belongs to it.
    """
    place = {id(x): k for k, x in enumerate(nodes)}
    total = weighed(nodes, mass)
    last = {id(x): k for k, x in enumerate(nodes)}
    for x in reversed(nodes):
        if x.above is not None and id(x.above) in last:
            last[id(x.above)] = max(last[id(x.above)], last[id(x)])
    at = nodes[0]
    while True:
        below = [c for c in at.children if c.tag in HOLDERS]
        best = max(below, key=lambda c: total[id(c)], default=None)
        if best is None or total[id(best)] <= 0 or total[id(best)] < MOST * total[id(at)]:
            break
        at = best
    up, top = at, None
    while up is not None:
        top = up if up.kind == "root" and (top is None or up.tag != "main" or top.tag == "main") else top
        up = up.above
    if top is not None:
        return [(place[id(top)], last[id(top)])], False
    inside = nodes[place[id(at)] : last[id(at)] + 1]
    roots = [x for x in inside if x.kind == "root" and not x.above.rooted]
    spans = [(place[id(at)], last[id(at)])]
    if roots and sum(total[id(x)] for x in roots) * 2 >= total[id(at)]:
        return spans, True
    if not any(x.tag == "h1" for x in inside):
        title = next((x for x in reversed(nodes[: place[id(at)]]) if x.tag == "h1"), None)
        spans += [(place[id(title)], last[id(title)])] if title is not None else []
    return spans, False


def articles(nodes: list[Node], mass: dict[int, float]) -> set[int]:
    """Leaves in likely articles, the outermost ones (within a main element its articles), that hold at least a quarter of the text of the longest."""
    of: dict[int, Node | None] = {}
    size: dict[int, float] = {}
    for x in nodes:
        own = of.get(id(x.above)) if x.above is not None else None
        of[id(x)] = own = x if x.kind == "root" and (own is None or (own.tag == "main" and x.tag != "main")) else own
        if own is not None:
            size[id(own)] = size.get(id(own), 0.0) + mass.get(id(x), 0.0)
    enough = max(size.values(), default=0.0) / 4
    return {id(x) for x in nodes if x.tag == "#text" and of[id(x)] is not None and size[id(of[id(x)])] >= enough}


def own_mass(nodes: list[Node], gone: set[int]) -> dict[int, float]:
    """Of each element the text of its own that counts: not in links, not dropped; in a likely article it counts more."""
    mass: dict[int, float] = {}
    for x in nodes:
        if x.tag == "#text" and id(x) not in gone and x.linked <= len(x.text) / 2:
            mass[id(x.above)] = mass.get(id(x.above), 0.0) + len(x.text) * (ROOTED if x.above.rooted else 1.0)
    return mass


def listed(x: Node) -> bool:
    """Whether a leaf is a link of a list of links: outside of paragraphs and headings."""
    return x.linked > len(x.text) / 2 and x.above.tag not in ("p", "pre", "blockquote", "td", *HEADINGS)


def article(root: Node) -> list[Node]:
    """The leaves of the article of one page by itself."""
    nodes = ordered(root)
    gone = said_to_go(nodes)
    mass = own_mass(nodes, gone)
    spans, roots = region(nodes, mass)
    ours = articles(nodes, mass) if roots else None
    found = [x for a, b in sorted(spans) for x in nodes[a : b + 1] if x.tag == "#text" and id(x) not in gone]
    return [x for x in found if (ours is None or id(x) in ours) and (x.above.rooted or not listed(x))]
