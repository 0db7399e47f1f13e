"""Leaf blocks of HTML pages: runs of text between block-level tags, with what stands above them."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

#: Names of HTML elements.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = RAW | frozenset("head noscript template select option button svg math canvas object audio video datalist".split())
ENDS_P = BLOCKS - frozenset("td th tr tbody thead tfoot body html head li dd dt".split())
SELF_CLOSING = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")


#: Parts of names that say something about what they hold: a fixed list, so that a site's own names don't count.
HINTS = tuple("nav menu head foot side bar ad ads advert sponsor promo banner cookie consent notice alert popup modal comment repl respon discuss share social related recommend more widget form login search subscribe newsletter signup bread crumb tag meta byline author date copyright legal content article post entry main body story text page title pagination skip disclaimer".split())
KNOWN = BLOCKS | VOID | DROPPED | frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark output q s samp small span strike strong sub sup time tt u var".split())


@lru_cache(maxsize=50_000)
def hints(part: str) -> frozenset[str]:
    """What a part of a name hints at."""
    return frozenset(f"hint:{h}" for h in HINTS if part in (h, h + "s") or len(h) > 3 and h in part)


class Element:
    """An open element: its tag, the parts of its names, what its tags and names and those above
    say (`tag:` of known elements, `hint:`; both sets are bounded), and the innermost block-level
    tag."""

    __slots__ = ("above", "block", "dropped", "names", "parent", "tag")

    def __init__(self, tag: str, names: tuple[str, ...] = (), parent: Element | None = None):
        self.tag, self.names, self.parent = tag, names, parent
        before = parent.above if parent else frozenset()
        own = set().union({"tag:" + (tag if tag in KNOWN else "?")} if tag else (), *map(hints, names))
        self.above = before if own <= before else before | own
        self.block = tag if tag in BLOCKS else parent.block if parent else ""
        self.dropped = bool(parent and parent.dropped) or tag in DROPPED


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked

    @property
    def tag(self) -> str:
        return self.element.block

    @property
    def path(self) -> frozenset[str]:
        """All tags (`tag:`) and parts of names (`name:`) above the text."""
        out: set[str] = set()
        at: Element | None = self.element
        while at:
            out.update(("tag:" + at.tag,) if at.tag else (), ("name:" + part for part in at.names))
            at = at.parent
        return frozenset(out)


def blocks(html: str | None) -> list[Block]:
    """The blocks in page order. Each has its text (references decoded in each run of text between
    tags, white space made one space), the innermost block-level tag, the tags and names above it
    and the characters inside links.

    Text in scripts, styles, titles and controls is left out. A null page has no blocks; markup
    that never ends is taken to reach to the page's end.
    """
    source = html or ""
    out: list[Block] = []
    stack = [Element("")]
    open_tags: dict[str, int] = {}
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack[-1], linked))
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        while True:
            tag = stack.pop().tag
            open_tags[tag] -= 1
            if tag == name:
                return

    while at < len(source):
        found = TAG.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text and not stack[-1].dropped:
            text = unescape(text)
            parts.append(text)
            if open_tags.get("a"):
                linked += len(text)
        if not found:
            break
        at = found.end()
        if (name := found[2]) is None:
            continue
        name = name.lower()
        if found[1]:
            if name in BLOCKS:
                flush()
            if open_tags.get(name):
                close(name)
            continue
        if name in BLOCKS:
            flush()
            if name in ENDS_P and open_tags.get("p"):
                close("p")
        elif name == "br":
            parts.append(" ")
        if (same := SELF_CLOSING.get(name)) and stack[-1].tag == same:
            close(same)
        if name in VOID or found[3].endswith("/>") and name not in BLOCKS:
            continue
        names = [part for m in ATTRIBUTE.finditer(found[3]) for part in NAME_PART.findall((m[2] or m[3] or m[4] or "").lower())] if "=" in found[3] else ()
        stack.append(Element(name, tuple(names), stack[-1]))
        open_tags[name] = open_tags.get(name, 0) + 1
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, at)
            at = end.start() if end else len(source)
    flush()
    return out
