"""Leaf blocks of a page: runs of text that no block element divides, with what encloses them.

The reader follows HTML's rules where they decide which text belongs together: elements without an end, ends that are implied, raw text of scripts and styles, quoted
attributes, comments, declarations. What is left open at the end of a page counts as closed there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

#: HTML's element names by kind.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
UNSEEN = frozenset("audio canvas datalist math object svg template video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starts that leave an open paragraph open: those of elements that may stand in one, or that can't hold one.
IN_PARAGRAPH = frozenset("body button caption dd dt html label legend li optgroup option select tbody td tfoot th thead tr".split())
#: A start closes what is named first, up to the nearest of what is named second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
}
SCOPES = frozenset("table td th caption".split())

_token = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z",
    re.S,
)
_attribute = re.compile(r"([^\s\"'=<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_ends = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Element:
    """An open element; ``seen`` is what ``describe`` made of it and of what encloses it, ``own`` the nearest block around it."""

    __slots__ = ("tag", "block", "link", "hidden", "seen", "own")

    def __init__(self, tag: str, block: bool, link: bool, hidden: bool, seen, own):
        self.tag, self.block, self.link, self.hidden, self.seen, self.own = tag, block, link, hidden, seen, own


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _attribute.findall(source):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def leaf_blocks(html: str, describe: Callable[[str, str, object], object]) -> list[tuple[Element, str, int]]:
    """``(element, text, characters in links)`` of each block that has text, in page order.

    ``describe(tag, attributes' source, what it gave for the element around)`` says what is to be known of an element; None around the outermost.
    """
    blocks: list[tuple[Element, str, int]] = []
    pieces: list[str] = []
    linked = 0
    root = Element("", True, False, False, describe("", "", None), None)
    stack, open_tags, holder = [root], {}, root
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append((holder, text, linked))
        pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal holder
        holder = stack[depth].own
        for e in stack[depth:]:
            open_tags[e.tag] -= 1
        del stack[depth:]

    def say(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if not top.hidden:
            if "&" in text:
                text = unescape(text)
            pieces.append(text)
            if top.link:
                linked += len(text)

    while at < n:
        m = _token.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if not open_tags.get(tag):
                if tag in BLOCKS or tag == "br":
                    pieces.append("\n") if tag == "br" else flush()
                continue
            if tag in ("body", "html"):
                continue
            block = tag in BLOCKS
            for k in range(len(stack) - 1, 0, -1):
                e = stack[k]
                if e.tag == tag:
                    if block:
                        flush()
                    pop_to(k)
                    break
                if e.block and not block or e.tag in SCOPES and (tag not in SCOPES and tag not in ("tr", "tbody", "thead", "tfoot") or e.tag == "table"):
                    break
            continue
        if tag in RAW:
            end = _ends[tag].search(html, at)
            if end is None:
                at = n
            else:
                close = html.find(">", end.end())
                at = close + 1 if close >= 0 else n
            pieces.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
            if open_tags.get("p") and tag not in IN_PARAGRAPH:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        pop_to(k)
                        break
                    if stack[k].tag in SCOPES or stack[k].tag == "button":
                        break
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                pop_to(len(stack) - 1)
            if tag in CLOSES:
                ended, within = CLOSES[tag]
                if any(open_tags.get(t) for t in ended):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in ended:
                            pop_to(k)
                            break
                        if stack[k].tag in within:
                            break
        elif tag == "br":
            pieces.append("\n")
        if tag in VOID:
            continue
        top = stack[-1]
        seen = describe(tag, m[3], top.seen) if block else top.seen
        e = Element(tag, block, top.link or tag == "a", top.hidden or tag in UNSEEN, seen, holder)
        stack.append(e)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if block:
            holder = e
    flush()
    return blocks
