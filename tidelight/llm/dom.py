"""A small DOM of a page: nodes in page order with what the extraction needs to know of each."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter

# How HTML treats elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button select option label legend head".split())
CLOSED_BY = {  # an open element here ends where one of these begins
    "p": frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"]),
}
CLOSES = {tag: [k for k, v in CLOSED_BY.items() if tag in v] for tag in frozenset().union(*CLOSED_BY.values())}
SCOPES = frozenset("html body table td th ul ol dl article section main div aside nav header footer form blockquote".split())

_MARKUP = re.compile(r"<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>)", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|aria-label|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Tags:
    """Finds the markup of a page from left to right, in time linear in the page.

    A tag ends at the first `>` outside of quotes. One that never ends is text. After the first such
    tag, ends are looked up in the places of quotes and `>`, and places from which no end can be
    reached are remembered, so that pages of unclosed tags are not read again for each of them.
    """

    def __init__(self, page: str):
        self.page, self.last, self.places, self.dead = page, page.rfind(">"), None, set()

    def find(self, at: int) -> tuple[int, int, str | None, str, str] | None:
        """Start, end, name (None of comments and the like), slash and attributes of the next markup."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if self.places is None or page[at + 1 : at + 2] in ("!", "?"):
                if m := _MARKUP.match(page, at):
                    return at, m.end(), m[2], m[1] or "", m[3] or ""
            elif m := _NAME.match(page, at):
                if (end := self._end(m.end())) is not None:
                    return at, end + 1, m[2], m[1], page[m.end() : end]
            if self.places is None and _NAME.match(page, at):
                self.places = [x.start() for x in _SPECIAL.finditer(page)]
            at += 1
        return None

    def _end(self, at: int) -> int | None:
        seen, i = [], bisect_left(self.places, at)
        while i < len(self.places) and i not in self.dead:
            seen.append(i)
            place = self.places[i]
            if self.page[place] == ">":
                return place
            close = self.page.find(self.page[place], place + 1)
            if close < 0:
                break
            i = bisect_left(self.places, close + 1)
        self.dead.update(seen)
        return None


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "children", "text", "block", "links", "all_text", "all_tags", "inner_links")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[str] = frozenset()):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.text = 0
        self.all_text = self.all_tags = self.inner_links = 0


def attribute_tokens(raw: str) -> frozenset[str]:
    """Words of the attributes that name a node's part."""
    if "=" not in raw and "hidden" not in raw.lower():
        return frozenset()
    out = set()
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            out.add("hidden")
        elif name != "style":
            out.update(_TOKEN.findall(_CAMEL.sub(" ", html.unescape(value)).lower()))
    return frozenset(out)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, bool]]]:
    """The nodes in page order, and the text pieces in page order: (node, text, whether a block edge lies before it).

    Open elements end as HTML says where that matters for text; stray end tags are ignored. The
    contents of scripts, styles and their like are no text, character references are decoded.
    Text that lies in no element is in a body that is implied.
    """
    root = Node("#root", None)
    nodes, pieces, stack = [root], [], [root]
    edge, at, n = True, 0, len(page)
    tags, open_ = Tags(page), Counter()
    body = None
    while at < n:
        m = tags.find(at)
        stop = m[0] if m else n
        if stop > at:
            text = html.unescape(page[at:stop])
            if len(stack) == 1 and text.strip():
                if body is None:
                    body = Node("body", root)
                    root.children.append(body)
                    nodes.append(body)
                pieces.append((body, text, edge))
                edge = False
            elif len(stack) > 1:
                pieces.append((stack[-1], text, edge))
                edge = False
        if not m:
            break
        _, at, name, slash, attributes = m
        if not name:
            continue
        tag = name.lower()
        if slash:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    if any(x.tag in BLOCKS for x in stack[i:]):
                        edge = True
                    open_.subtract(x.tag for x in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES and tag not in SCOPES:  # an inline end tag doesn't close blocks around it
                    break
            if tag == "p":
                edge = True
            continue
        if tag == "br":
            pieces.append((stack[-1] if len(stack) > 1 or body is None else body, " ", edge))
            edge = False
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at, tags.last + 1)
            at = end.end() if end else n
            continue
        for i in range(len(stack) - 1, 0, -1) if any(open_[x] for x in CLOSES.get(tag, ())) else ():
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                open_.subtract(x.tag for x in stack[i:])
                del stack[i:]
                break
            if stack[i].tag in SCOPES and stack[i].tag not in CLOSED_BY:
                break
        if tag in BLOCKS:
            edge = True
        if tag in VOID:
            continue
        node = Node(tag, stack[-1], attribute_tokens(attributes))
        stack[-1].children.append(node)
        nodes.append(node)
        stack.append(node)
        open_[tag] += 1
    return nodes, pieces
