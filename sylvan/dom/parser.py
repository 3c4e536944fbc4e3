"""A permissive HTML parser: bytes to a preorder table of nodes. Pure Python over bytes; it knows nothing of Spark.

No input fails. Only documents, elements and text become nodes; comments, doctypes and processing instructions vanish. The
tree follows the source: nothing is synthesised, and a handful of rules close elements whose end tags were left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from sylvan.dom.entities import decode

# White space, and the tags with rules of their own.
WS = b" \n\r\t\f"
VOID = frozenset(b"area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(b"script style title textarea".split())
CLOSES_P = b"p hr h1 h2 h3 h4 h5 h6 dl ol ul div nav pre form main aside table footer header address article section fieldset blockquote"
#: For an open element, the tags whose start ends it.
ENDED_BY = {
    b"p": frozenset(CLOSES_P.split()),
    b"li": frozenset([b"li"]),
    b"dt": frozenset([b"dt", b"dd"]),
    b"dd": frozenset([b"dt", b"dd"]),
    b"tr": frozenset([b"tr"]),
    b"td": frozenset([b"td", b"th"]),
    b"th": frozenset([b"td", b"th"]),
    b"head": frozenset([b"body"]),
    b"option": frozenset([b"option"]),
}

_OPEN = re.compile(rb"<[ \n\r\t\f]*+([^ \n\r\t\f/>\x00]*+)")
_CLOSE = re.compile(rb"</[ \n\r\t\f]*+([^ \n\r\t\f/>\x00]*+)")
#: Up to the `>` that ends a tag; a quote anywhere hides what is up to the next of its kind.
_TAG_END = re.compile(rb"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_RAW_END = {t: re.compile(rb"</" + t + rb"[ \n\r\t\f]*>", re.I) for t in RAW_TEXT}
_SELF_CLOSED = re.compile(rb"/[ \n\r\t\f]*+>\Z")
_SVG_STEP = re.compile(rb"<[ \n\r\t\f]*+(?:(!--)|([!?])|(/)[ \n\r\t\f]*+)?([^ \n\r\t\f/>\x00]*+)")

_NAME = re.compile(rb"[A-Za-z0-9_:.\-]+")
_BARE = re.compile(rb"[^ \n\r\t\f>/]*+")
_SPACE = re.compile(rb"[ \n\r\t\f]*+")

DOCUMENT, ELEMENT, TEXT = 0, 1, 2


@dataclass(slots=True)
class Node:
    kind: int
    parent: int
    name: bytes = b""  # raw tag, or raw text
    attrs: bytes = b""
    prev_sibling: int = -1
    last_child: int = -1
    subtree_end: int = 0
    sib_pos: int = 0
    depth: int = 0


@dataclass(slots=True)
class Attr:
    name: bytes
    raw: bytes  # the value as it stands in the source, from the name on
    value: bytes
    bare: bool = False  # without a value, or with an empty assignment


def _svg_end(src: bytes, at: int) -> int | None:
    """Past the end tag that matches an open svg, or None. Tags in quoted values, comments and declarations don't count."""
    depth = 1
    while (lt := src.find(b"<", at)) >= 0:
        m = _SVG_STEP.match(src, lt)
        comment, declared, closing, name = m.groups()
        if comment:
            end = src.find(b"-->", m.start(1) + 3)
            if end < 0:
                return None
            at = end + 3
            continue
        if declared or closing:
            end = src.find(b">", m.start(2) + 1 if declared else m.end())
            if end < 0:
                return None
            at = end + 1
            if closing and name.lower() == b"svg":
                depth -= 1
                if not depth:
                    return at
            continue
        if not name:
            if m.end() >= len(src):
                return None
            at = lt + 1
            continue
        tag = _TAG_END.match(src, m.end())
        if tag is None:
            return None
        if name.lower() == b"svg" and not _SELF_CLOSED.search(tag[0]):
            depth += 1
        at = tag.end()
    return None


@dataclass(slots=True)
class _Builder:
    nodes: list[Node] = field(default_factory=lambda: [Node(DOCUMENT, -1)])
    stack: list[int] = field(default_factory=lambda: [0])
    tags: list[bytes] = field(default_factory=lambda: [b""])  # of the stack's elements, in lower case

    def text(self, raw: bytes, parent: int) -> None:
        i = len(self.nodes)
        self.nodes.append(Node(TEXT, parent, raw, subtree_end=i, depth=self.nodes[parent].depth + 1))

    def element(self, name: bytes, attrs: bytes) -> int:
        i, parent = len(self.nodes), self.stack[-1]
        above = self.nodes[parent]
        before = above.last_child
        self.nodes.append(Node(ELEMENT, parent, name, attrs, before, -1, i, self.nodes[before].sib_pos + 1 if before >= 0 else 1, above.depth + 1))
        above.last_child = i
        return i

    def close(self, down_to: int) -> None:
        """Takes elements off the stack until `down_to` of its entries are left."""
        end = len(self.nodes) - 1
        for i in self.stack[down_to:]:
            self.nodes[i].subtree_end = end
        del self.stack[down_to:], self.tags[down_to:]


def parse(src: bytes, drop_ws: bool = True) -> list[Node]:
    """All nodes in preorder; node 0 is the document. `drop_ws` leaves out text runs of nothing but white space."""
    b, at, size = _Builder(), 0, len(src)
    stack, tags = b.stack, b.tags
    while at < size:
        lt = src.find(b"<", at)
        if lt != at:
            end = size if lt < 0 else lt
            run = src[at:end]
            if not drop_ws or run.strip(WS):
                b.text(run, stack[-1])
            at = end
            continue
        mark = src[at + 1 : at + 2]
        if not mark:
            break
        if mark == b"/":
            m = _CLOSE.match(src, at)
            gt = src.find(b">", m.end())
            at = size if gt < 0 else gt + 1
            if name := m[1].lower():
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] == name:
                        b.close(k)
                        break
        elif mark == b"?":
            end = src.find(b"?>", at + 2)
            at = size if end < 0 else end + 2
        elif mark == b"!":
            if src.startswith(b"--", at + 2):
                if src.startswith(b">", at + 4):
                    at += 5
                else:
                    end = src.find(b"-->", at + 4)
                    at = size if end < 0 else end + 3
            else:
                gt = src.find(b">", at + 2)
                at = size if gt < 0 else gt + 1
        else:
            m = _OPEN.match(src, at)
            if not m[1]:
                at = min(m.end() + 1, size)
                continue
            at = _start_tag(b, src, m)
    b.close(1)
    b.nodes[0].subtree_end = len(b.nodes) - 1
    return b.nodes


def _start_tag(b: _Builder, src: bytes, m: re.Match[bytes]) -> int:
    """Adds the element that a start tag opens, with its text if that is taken as it stands; where to go on."""
    name = m[1]
    tag, size = name.lower(), len(src)
    if name != tag:
        name = tag[:8] + name[8:]  # only the first eight bytes of a name are folded
    nodes, stack, tags = b.nodes, b.stack, b.tags
    while tags[-1] in ENDED_BY and tag in ENDED_BY[tags[-1]]:
        b.close(len(stack) - 1)
    end = _TAG_END.match(src, m.end())
    at = end.end() if end else size
    i = b.element(name, src[m.end() : at - 1 if end else size])
    if tag in VOID:
        return at
    if tag == b"svg":
        if end and len(end[0]) > 1 and _SELF_CLOSED.search(end[0]):
            return at
        past = _svg_end(src, at)
        inner = (at, src.rfind(b"<", at, past), past) if past else (at, size, size)
        has_text = past is not None or at < size
    elif tag == b"plaintext":
        inner, has_text = (at, size, size), at < size
    elif tag in RAW_TEXT:
        close = _RAW_END[tag].search(src, at)
        inner = (at, close.start(), close.end()) if close else (at, size, size)
        has_text = inner[1] > at
    else:
        stack.append(i)
        tags.append(tag)
        return at
    if has_text:
        b.text(src[inner[0] : inner[1]], i)
        nodes[i].subtree_end = i + 1
    return inner[2]


def attributes(span: bytes) -> list[Attr]:
    """The attributes between a tag's name and its end, in order, with repeated names.

    Names are made of letters, digits and _:.- ; other bytes are skipped. A `/` or `>` outside a quoted value ends the list,
    and ends an unquoted value. White space before `=` makes an attribute without value.
    """
    found, i, size = [], 0, len(span)
    while True:
        i = _SPACE.match(span, i).end()
        if i >= size or span[i] in b">/":
            return found
        m = _NAME.match(span, i)
        if m is None:
            i += 1
            continue
        i = m.end()
        if span[i : i + 1] != b"=":
            found.append(Attr(m[0], m[0], b"", True))
            if i >= size or span[i] in b">/":
                return found
            i += 1
            continue
        i = _SPACE.match(span, i + 1).end()
        quote = span[i : i + 1]
        if quote in (b'"', b"'"):
            end = span.find(quote, i + 1)
            raw, i = (span[i + 1 :], size) if end < 0 else (span[i + 1 : end], end + 1)
            found.append(Attr(m[0], span[m.start() : i], decode(raw)))
        else:
            raw = _BARE.match(span, i)
            i = raw.end()
            found.append(Attr(m[0], span[m.start() : i], decode(raw[0]), not raw[0]))
