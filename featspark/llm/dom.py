"""A small DOM for text extraction: block elements and text blocks as nodes, with features of each node."""

from __future__ import annotations

import re
from html import unescape

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
ATTR = re.compile(r"(class|id|role|style|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style title noscript iframe textarea svg math canvas object select template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
GROUPS = ["#text", "p", "h", "li", "ul", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "control", "html", "other"]
GROUP = {"ol": "ul", "dl": "ul", "menu": "ul", "dt": "li", "dd": "li", "tr": "table", "thead": "table", "tbody": "table", "th": "td", "figcaption": "figure", "button": "control", "label": "control", "input": "control", "fieldset": "form", "body": "html",
         **{f"h{i}": "h" for i in range(1, 7)}}
CODE = {g: i for i, g in enumerate(GROUPS)}
GOOD = set("article articlebody content entry main post story text body page blog prose".split())
BAD = set("ad ads advert advertisement adsense aside banner bar breadcrumb breadcrumbs caption cookie cookies comment comments consent copyright disqus foot footer footnote head header login menu masthead modal nav navbar navigation newsletter notice notices pager pagination popup popular promo promotion recommended related reply respond search share sharing sidebar sidebox signup site skip social sponsor sponsored subscribe tags toolbar tools top topbar widget".split())
KIND = {**CODE, **{tag: CODE[g] for tag, g in GROUP.items()}}
STOPS = set(".!?")
OTHER, SIDE, ARTICLE, ENDS, FORMS, LISTS = CODE["other"], {CODE["nav"], CODE["aside"]}, {CODE["article"], CODE["main"]}, {CODE["footer"], CODE["header"]}, {CODE["form"], CODE["control"]}, {CODE["ul"], CODE["li"]}


class Node:
    __slots__ = ("tag", "parent", "kids", "attr", "text", "good", "bad", "hidden", "chars", "words", "links", "blocks", "stops", "paras", "before", "depth", "at", "own", "code", "same", "gain")

    def __init__(self, tag, parent, attr=""):
        self.tag, self.parent, self.kids, self.attr, self.text = tag, parent, [], attr, ""
        self.good = self.bad = self.hidden = self.chars = self.words = self.links = self.blocks = self.stops = self.paras = self.before = 0
        self.depth = parent.depth + 1 if parent is not None else 0
        self.at, self.code, self.same = 0, KIND.get(tag, OTHER), None
        if parent is not None:
            self.at = len(parent.kids)
            parent.kids.append(self)
        if attr:
            low = attr.lower()
            for name, *values in ATTR.findall(low):
                value = "".join(values)
                if name == "style":
                    self.hidden |= "none" in value or "hidden" in value
                else:
                    tokens = set(TOKEN.findall(value))
                    self.good += len(tokens & GOOD)
                    self.bad += len(tokens & BAD)
            self.hidden |= " hidden" in low or "aria-hidden=\"true\"" in low


def parse(html: str) -> Node:
    """The tree of block elements; text blocks are nodes with tag ``#text`` in page order."""
    root = node = Node("html", None)
    parts: list[str] = []
    linked, in_link, pos, n = 0, 0, 0, len(html)

    def flush():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                leaf = Node("#text", node)
                leaf.text, leaf.chars, leaf.links, leaf.words, leaf.blocks = text, len(text), min(linked, len(text)), text.count(" ") + 1, 1
                leaf.stops = text.count(".") + text.count(",") + text.count("!") + text.count("?")
            parts.clear()
        linked = 0

    def close(until: Node):
        """Leave ``until``; everything open inside it ends as well."""
        nonlocal node
        flush()
        node = until.parent if until.parent is not None else until

    while pos < n:
        m = TAG.search(html, pos)
        end = m.start() if m else n
        if end > pos:
            parts.append(html[pos:end])
            if in_link:
                linked += end - pos
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                if tag == "a":
                    in_link = 0
                continue
            at = node
            while at is not None and at.tag != tag:
                at = at.parent
            if at is not None and at.parent is not None:
                close(at)
            elif tag in ("body", "html"):
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            continue
        if tag in DROPPED:
            flush()
            low = html.find("</" + tag, pos)
            if low < 0:
                found = re.compile("</" + tag, re.I).search(html, pos)
                low = found.start() if found else n
            pos = low
            stop = html.find(">", pos)
            pos = n if stop < 0 else stop + 1
            continue
        flush()
        if tag in CLOSES_P:
            at = node
            while at.tag not in ("p", "html", "td", "th", "button"):
                if at.parent is None:
                    break
                at = at.parent
            if at.tag == "p":
                close(at)
        if tag in SAME:
            at, found = node, None
            while at.parent is not None and at.tag not in FENCE[tag]:
                if at.tag in SAME[tag]:
                    found = at
                at = at.parent
            if found is not None:
                close(found)
        in_link = in_link if tag not in CLOSES_P or tag.startswith("h") or tag in ("div", "p") else 0
        if tag in VOID:
            if tag in ("input", "img", "hr"):
                Node(tag, node, m[3])
            continue
        if tag in ("html", "body", "head") and tag != "head":
            node.attr = node.attr or m[3]
            continue
        node = Node(tag, node, m[3])
    flush()
    return root


def ordered(root: Node) -> list[Node]:
    """All nodes in page order, parents before children; an explicit stack allows any depth."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed(x.kids))
    return out


def summarize(root: Node) -> list[Node]:
    """Subtree sums and the characters that stand before each node."""
    nodes, seen = ordered(root), 0
    for x in nodes:
        x.before = seen
        seen += x.chars if x.tag == "#text" else 0
    for x in reversed(nodes):
        p = x.parent
        if p is not None:
            p.chars += x.chars
            p.words += x.words
            p.links += x.links
            p.blocks += x.blocks
            p.stops += x.stops
            p.paras += x.paras + (x.tag == "p")
    return nodes


def features(nodes: list[Node]) -> list[tuple]:
    """One row of numbers per node: kind, attributes, ancestors, density, position, siblings."""
    total, rows = max(1, nodes[0].chars), []
    outside = Node("html", None)
    outside.own, outside.kids, outside.code = (0, 0, False, False, False, False, False, False), [nodes[0]], -1
    none = Node("#text", None)
    none.chars, none.links, none.bad = -1, 0, -1
    for x in nodes:
        p = x.parent or outside
        good, bad, side, art, ends, form, hide, lst = p.own
        kind, kids, at, chars = x.code, p.kids, x.at, x.chars or 1
        x.own = (good + x.good, bad + x.bad, side or kind in SIDE, art or kind in ARTICLE, ends or kind in ENDS, form or kind in FORMS, hide or x.hidden, lst or kind in LISTS)
        if p.same is None:
            p.same = {}
            for k in kids:
                p.same[k.tag] = p.same.get(k.tag, 0) + 1
        n, blocks = len(kids), x.blocks or 1
        prev = kids[at - 1] if at else none
        nxt = kids[at + 1] if at + 1 < n else none
        rows.append((
            kind, p.code, x.depth, x.good, x.bad, *x.own, x.chars, x.words, x.links / chars, x.blocks, x.stops / chars, x.chars / blocks, x.paras, x.chars / total, x.before / total,
            (total - x.before - x.chars) / total, len(x.kids), n, at / n, p.same[x.tag] / n, prev.chars, nxt.chars, prev.links / (prev.chars or 1), nxt.links / (nxt.chars or 1), prev.bad, nxt.bad,
            x.words / blocks, x.text[-1:] in STOPS, "©" in x.text, p.chars, p.links / (p.chars or 1), x.hidden, p.paras))
    return rows


def decode(nodes: list[Node], odds: list[float]) -> list[Node]:
    """The best consistent choice: a node is content only inside content ancestors; text blocks in page order.

    ``gain`` of a node is its log-odds and the positive gains of its children; a node is chosen if its parent is
    and its gain is positive. This maximises the summed log-odds over all choices without contradiction.
    """
    for x, s in zip(nodes, odds):
        x.gain = s
    for x in reversed(nodes[1:]):
        if x.gain > 0:
            x.parent.gain += x.gain
    out, nodes[0].gain = [], 1.0
    for x in nodes[1:]:
        if x.gain > 0:
            if x.parent.gain <= 0:
                x.gain = 0
            elif x.tag == "#text":
                out.append(x)
    return out
