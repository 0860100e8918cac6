"""Text blocks of an HTML page, in page order, with their way of tags.

A block is text between block-level tags; inline tags and line breaks stay inside it. Scripts,
styles, comments, titles, templates and other unrendered content are no text. Unclosed and
misnested tags are tolerated: a block-level tag ends an open paragraph, a list item the item
before it, an end tag all that is open inside its element. Character references are decoded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# fixed values: HTML's element kinds
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNRENDERED = frozenset("script style textarea title template noscript iframe object svg math canvas audio video noembed noframes xmp".split())
#: elements that end an open one of their kind, and those between which they do not look
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "a": ({"a"}, {"table"}),
}

_TAG = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|(!--)|[!?/][^>]*+>)"""
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_COMMENT_END = re.compile(r"--!?>")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in UNRENDERED}


@dataclass(slots=True)
class Block:
    text: str
    way: int  # number of its element's way in the Ways it was read with
    linked: int  # code points inside links


class Ways:
    """Numbers for ways of elements: each is its parent's number, a tag, and its names (class, id, role)."""

    def __init__(self):
        self.known: dict[tuple[int, str, str], int] = {}
        self.made: list[tuple[int, str, str]] = [(-1, "", "")]

    def child(self, parent: int, tag: str, names: str) -> int:
        key = (parent, tag, names)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.made)
            self.made.append(key)
        return found


def read_blocks(html: str, ways: Ways) -> list[Block]:
    """Blocks with text, white space made single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    way = linked = 0
    end = html.rfind(">") + 1
    at = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append(Block(text, way, min(linked, len(text))))
        linked = 0

    def say(text: str) -> None:
        nonlocal way, linked
        if "&" in text:
            text = unescape(text)
        if not text or text.isspace():
            if pieces:
                pieces.append(text)
            return
        if not pieces:
            way = stack[-1][1]
        pieces.append(text)
        if opened.get("a"):
            linked += len(text.strip())

    def leave(depth: int) -> None:
        while len(stack) > depth:
            tag, _ = stack.pop()
            opened[tag] -= 1
            if tag in BLOCK:
                flush()

    while at < end:
        m = _TAG.search(html, at, end)
        if m is None:
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        if m[7]:
            close = _COMMENT_END.search(html, m.start() + 2)
            at = close.end() if close else len(html)
            end = max(end, at)
            continue
        name = m[2] or m[5]
        if name is None:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if opened.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                leave(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in UNRENDERED:
            close = _ENDS[tag].search(html, at)
            at = close.end() if close else len(html)
            continue
        if tag == "br":
            pieces and pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if opened.get("p"):
                depth = len(stack) - 1
                while stack[depth][0] != "p":
                    depth -= 1
                leave(depth)
        if tag in VOID:
            continue
        own = SIBLINGS.get(tag)
        if own and any(opened.get(t) for t in own[0]):
            depth = len(stack) - 1
            while depth and stack[depth][0] not in own[0] and stack[depth][0] not in own[1]:
                depth -= 1
            if stack[depth][0] in own[0]:
                leave(depth)
        attributes = m[3] or m[6] or ""
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
        stack.append((tag, ways.child(stack[-1][1], tag, names)))
        opened[tag] = opened.get(tag, 0) + 1
    rest = html[at:]
    opens = _OPEN.search(rest)  # a tag that does not end
    say(rest[: opens.start()] if opens else rest)
    flush()
    return out
