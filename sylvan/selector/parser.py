"""CSS selectors: text to a small tree. Plain Python on the driver; compiled selectors are remembered."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

WS = " \n\r\t\f"
#: Attribute operators by their spelling.
OPERATORS = {"=": "eq", "^=": "prefix", "$=": "suffix", "*=": "contains", "~=": "includes", "|=": "dash"}
COMBINATORS = {">": "child", "+": "adjacent", "~": "sibling"}


class InvalidSelector(ValueError):
    """A selector outside the supported grammar; `report` tells where debug queries put it."""

    def __init__(self, source: str):
        super().__init__(f"invalid selector: {source!r}")
        self.report = {"selector_source": source, "runtime_parse_error": True, "visited_elements": 0}


@dataclass(frozen=True)
class Attribute:
    name: str
    op: str = "exists"
    value: str = ""


@dataclass(frozen=True)
class Pseudo:
    kind: str
    a: int = 0
    b: int = 0


@dataclass(frozen=True)
class Compound:
    combinator: str | None = None  # to what stands before, or to the scope if it is the first
    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[Attribute, ...] = ()
    pseudos: tuple[Pseudo, ...] = ()
    nots: tuple[tuple[str, str | Attribute], ...] = ()


@dataclass(frozen=True)
class Selector:
    source: str
    groups: tuple[tuple[Compound, ...], ...] = field(default=())

    def __repr__(self) -> str:
        return f"Selector({self.source!r}, groups={len(self.groups)})"


_IDENT = re.compile(r"[A-Za-z_:][A-Za-z0-9_-]*")
_NTH = re.compile(r"(?:([+-]?[0-9]*)[ \n\r\t\f]*[nN][ \n\r\t\f]*([+-]?[0-9]+)?|([+-]?[0-9]+))\Z")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(s: str) -> str:
    return s.translate(_LOWER)


def nth(text: str) -> tuple[int, int] | None:
    """(A, B) of An+B, odd, even or a number; None if it is none of these. No space inside the B part's sign."""
    word = ascii_lower(text)
    if word in ("odd", "even"):
        return 2, int(word == "odd")
    m = _NTH.match(text)
    if not m:
        return None
    if m[3]:
        pair = 0, int(m[3])
    else:
        pair = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    return pair if all(-(2**31) <= x < 2**31 for x in pair) else None


class _Reader:
    def __init__(self, source: str):
        self.source, self.at = source, 0

    def fail(self):
        raise InvalidSelector(self.source)

    @property
    def here(self) -> str:
        return self.source[self.at : self.at + 1]

    def space(self) -> bool:
        start = self.at
        while self.here and self.here in WS:
            self.at += 1
        return self.at > start

    def take(self, token: str) -> bool:
        hit = self.source.startswith(token, self.at)
        self.at += len(token) * hit
        return hit

    def need(self, token: str) -> None:
        if not self.take(token):
            self.fail()

    def ident(self) -> str:
        m = _IDENT.match(self.source, self.at)
        if not m:
            self.fail()
        self.at = m.end()
        return m[0]

    def combinator(self) -> str | None:
        kind = COMBINATORS.get(self.here)
        if kind:
            self.at += 1
            self.space()
        return kind

    def selector(self) -> Selector:
        self.space()
        groups = [self.group()]
        while self.take(","):
            self.space()
            groups.append(self.group())
        return Selector(self.source, tuple(groups))

    def group(self) -> tuple[Compound, ...]:
        """Compounds up to a comma or the end."""
        chain = [self.compound(self.combinator())]
        while True:
            gap = self.space()
            if self.here in ("", ","):
                return tuple(chain)
            kind = self.combinator() or ("descendant" if gap else self.fail())
            chain.append(self.compound(kind))

    def compound(self, combinator: str | None) -> Compound:
        start, tag = self.at, None
        if not self.take("*") and self.here and (self.here.isascii() and self.here.isalpha() or self.here == "_"):
            tag = ascii_lower(self.ident())
        ids, classes, attrs, pseudos, nots = [], [], [], [], []
        while True:
            if self.take("#"):
                ids.append(self.ident())
                if len(ids) > 1:
                    self.fail()
            elif self.take("."):
                classes.append(self.ident())
            elif self.take("["):
                attrs.append(self.attribute())
            elif self.take(":"):
                found = self.pseudo()
                (pseudos if isinstance(found, Pseudo) else nots).append(found)
            else:
                break
        if self.at == start:
            self.fail()
        return Compound(combinator, tag, ids[0] if ids else None, tuple(classes), tuple(attrs), tuple(pseudos), tuple(nots))

    def attribute(self) -> Attribute:
        self.space()
        name = ascii_lower(self.ident())
        self.space()
        if self.take("]"):
            return Attribute(name)
        op = next((k for k in OPERATORS if self.take(k)), None) or self.fail()
        self.space()
        value = self.value()
        self.space()
        self.need("]")
        return Attribute(name, OPERATORS[op], value)

    def value(self) -> str:
        quote = self.here
        if quote in ('"', "'") and quote:
            end = self.source.find(quote, self.at + 1)
            if end < 0:
                self.fail()
            text = self.source[self.at + 1 : end]
            self.at = end + 1
            return text
        start = self.at
        while self.here and self.here not in "]" + WS:
            self.at += 1
        return self.source[start : self.at] or self.fail()

    def pseudo(self):
        name = ascii_lower(self.ident())
        if name in ("first-child", "last-child"):
            return Pseudo(name)
        if name not in ("nth-child", "not"):
            self.fail()
        self.space()
        self.need("(")
        self.space()
        if name == "nth-child":
            end = self.source.find(")", self.at)
            pair = nth(self.source[self.at : end].strip(WS)) if end >= 0 else None
            if pair is None:
                self.fail()
            self.at = end + 1
            return Pseudo(name, *pair)
        if self.take("#"):
            item = ("id", self.ident())
        elif self.take("."):
            item = ("class", self.ident())
        elif self.take("["):
            item = ("attr", self.attribute())
        else:
            item = ("tag", ascii_lower(self.ident()))
        self.space()
        self.need(")")
        return item


def parse(source: str) -> Selector:
    reader = _Reader(source)
    selector = reader.selector()
    if reader.at < len(source):
        reader.fail()
    return selector


@functools.lru_cache(1024)
def compiled(source: str) -> Selector:
    """`parse`, remembered."""
    return parse(source)
