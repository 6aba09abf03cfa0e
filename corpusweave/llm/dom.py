"""Leaf blocks of HTML pages: runs of text between the tags that start or end a block."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Element names of the HTML standard by how they affect the text around them.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul "
    "caption button".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset(
    "head script style template noscript noembed noframes iframe object svg math canvas audio video "
    "textarea title datalist".split()
)
RAW = frozenset("script style textarea title noscript noembed noframes iframe template".split())
#: Start tags that end an open element of the given kind, up to the given container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
CLOSES_P = BLOCK - {"button", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html"}

#: A comment, a declaration, or a tag; an open quotation mark or tag runs to the end.
_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"(?:^|[\s\"'/])(class|id|role|aria-label|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
    re.I,
)
_NAME = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")


@dataclass(eq=False)
class Element:
    """An open element; the blocks inside share it, however deep they lie."""

    tag: str
    names: tuple[str, ...] = ()
    parent: Element | None = None
    depth: int = 1
    #: What features its blocks have in common; filled in when it is first asked for.
    shared: tuple | None = None


@dataclass
class Block:
    """A leaf block: its text, the innermost element around it, and how much of it is links."""

    text: str
    inside: Element | None
    linked: int

    @property
    def path(self) -> tuple[Element, ...]:
        """The elements around it, from the outermost on."""
        out, element = [], self.inside
        while element:
            out.append(element)
            element = element.parent
        return tuple(reversed(out))


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _names(attributes: str) -> tuple[str, ...]:
    """Lower-case words of an element's class, id and role."""
    if "=" not in attributes and "hidden" not in attributes:
        return ()
    found: list[str] = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == "hidden":
            found.append("hidden")
        value = m[2] or m[3] or m[4] or ""
        found += [w.lower() for w in _NAME.findall(value)]
    return tuple(dict.fromkeys(found))


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page in order; white space inside a block is one space."""
    blocks: list[Block] = []
    stack: list[Element] = []
    now = _Open()
    silent = links = 0
    opened: Counter[str] = Counter()
    at, end = 0, len(html)

    def finish() -> None:
        nonlocal now
        if now.parts:
            text = " ".join("".join(now.parts).split())
            if text:
                blocks.append(Block(text, stack[-1] if stack else None, now.linked))
            now = _Open()

    def text(chunk: str) -> None:
        if chunk and not silent:
            chunk = unescape(chunk) if "&" in chunk else chunk
            now.parts.append(chunk)
            if links:
                now.linked += len(chunk)

    def close(k: int) -> None:
        """Close all open elements from place ``k`` on."""
        nonlocal silent, links
        if any(e.tag in BLOCK for e in stack[k:]):
            finish()
        silent -= sum(e.tag in SILENT for e in stack[k:])
        links -= sum(e.tag == "a" for e in stack[k:])
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def last(tag: str) -> int:
        """Place of the innermost open element of a kind, or -1."""
        if not opened[tag]:
            return -1
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag)

    while at < end:
        m = _MARKUP.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = last(tag)
            if k >= 0:
                close(k)
            elif tag in BLOCK:
                finish()
            continue
        if tag in CLOSES_P:
            k = last("p")
            if k > max(map(last, ("button", "td", "th", "body"))) and not silent:
                close(k)
        if opened["head"] and (tag == "body" or tag in CLOSES_P):
            close(last("head"))
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            inner = max(map(last, stop))
            first = [k for k in range(inner + 1, len(stack)) if stack[k].tag in ends]
            if first and any(opened[t] for t in ends):
                close(first[0])
        if tag in BLOCK:
            finish()
        if tag in VOID:
            if tag == "br":
                text("\n")
            continue
        if tag in RAW:
            # What stands inside is not read as markup.
            stop_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = stop_at.end() if stop_at else end
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        stack.append(Element(tag, _names(m[3]), stack[-1] if stack else None, len(stack) + 1))
        opened[tag] += 1
        silent += tag in SILENT
        links += tag == "a"
    finish()
    return blocks
