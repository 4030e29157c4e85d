"""HTML to a page's leaf blocks: text runs between block-level tags, with their tag paths.

Only scripts, styles, titles and the controls of forms are left out here; all other
text, such as that of formulas, drawings, noscript and iframe elements, is in a block.
"""

import html
import re
from typing import NamedTuple

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)", re.S
)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPLIT, HUMP = re.compile(r"[^a-z0-9]+"), re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Elements whose content is no page text: scripts, styles, titles, controls of forms, sources of formulas that are not shown.
RAW = frozenset("script style title textarea select option button datalist head annotation annotation-xml".split())
#: Of those, the elements whose content holds no tags.
RAW_TEXT = frozenset("script style title textarea".split())
#: The elements that may stand in a head; any other tag ends it.
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements whose content is part of the line of text around, with all tags in it.
FOREIGN = frozenset("math svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym annotation annotation-xml b bdi bdo big cite code data del dfn em font i img ins kbd label mark math object q rb rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split()
)
#: A start tag of the key closes an open element of the values up to the nearest block around.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    link_chars: int


class Node(NamedTuple):
    tag: str
    names: tuple[str, ...]


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role, and ``hidden`` for elements that are not shown."""
    found: list[str] = []
    for name, value in NAMED.findall(attributes):
        shown = value.strip("\"'")
        name, value = name.lower(), shown.lower()
        if name in ("class", "id", "role"):
            found += [w for w in SPLIT.split(HUMP.sub(" ", shown).lower()) if w]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found.append("hidden")
    return tuple(found)


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in page order; nothing is dropped but markup and RAW content."""
    out: list[Block] = []
    stack: list[Node] = []
    pieces: list[str] = []
    path: tuple[str, ...] = ()
    link_chars, links, at, raw_depth = 0, 0, 0, 0
    foreign = in_head = False

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(path, text, link_chars))
            pieces.clear()
        link_chars = 0

    def say(raw: str) -> None:
        nonlocal link_chars
        if raw and not raw_depth:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if links:
                link_chars += len(text)

    def retrace() -> None:
        nonlocal path, links, raw_depth, foreign, in_head
        path = tuple(t for n in stack if n.tag not in INLINE for t in (n.tag, *("." + w for w in n.names)))
        links = sum(n.tag == "a" for n in stack)
        raw_depth = sum(n.tag in RAW for n in stack)
        foreign = any(n.tag in FOREIGN for n in stack)
        in_head = any(n.tag == "head" for n in stack)

    position = 0
    while m := TOKEN.search(page, position):
        say(page[at : m.start()])
        at = position = m.end()
        close, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            say(" ")
            continue
        if in_head and not close and tag not in IN_HEAD:
            stack.clear()
            retrace()
        inline = tag in INLINE or foreign
        if not inline and tag not in RAW_TEXT:
            flush()
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if inline and not foreign and stack[i].tag not in INLINE:
                    break
            retrace()
            continue
        if tag in VOID:
            continue
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = position = end.end() if end else len(page)
            continue
        if not inline:
            while stack and stack[-1].tag in INLINE and any(n.tag == "p" for n in stack):
                stack.pop()
            if stack and stack[-1].tag == "p":
                stack.pop()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in CLOSES.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE and stack[i].tag != "p":
                    break
        stack.append(Node(tag, names_of(m[3]) if m[3].strip(" /") else ()))
        retrace()
    say(page[at:])
    flush()
    return out
