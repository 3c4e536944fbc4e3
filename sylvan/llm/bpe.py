"""Byte-pair encoding of single pre-tokens, and the offline proof of which vocabulary strings stay whole.

Merging runs in tiktoken's core, which joins two neighbours when their *concatenation* is in the vocabulary, while the
tokenizers library asks for the listed *pair*. The two agree wherever the strings that come out are proven whole: were a
string t first made from an unlisted pair (a, b), then t alone would stop at (a, b) in the library and not be whole. So
`pieces` hands any result that holds an unproven string to a plain merge of listed pairs.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

#: Ends a word in vocabularies with word ends; no UTF-8 text holds this byte.
WORD_END = b"\xff"


def byte_of_char() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies spell bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The merges of one tokenizer file, over bytes; `suffix` is WORD_END where the vocabulary has word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole_file = json.load(f)
        model, self.path = whole_file["model"], path
        end = model.get("end_of_word_suffix") or ""
        spelled = byte_of_char()

        def raw(symbol: str) -> bytes:
            tail = WORD_END if end and symbol.endswith(end) else b""
            return bytes(spelled[c] for c in (symbol[: -len(end)] if tail else symbol)) + tail

        self.suffix = WORD_END if end else b""
        self.special = {t["content"]: t["id"] for t in whole_file["added_tokens"]}
        self.vocab = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        order = [self.vocab[raw(a) + raw(b)] for a, b in pairs]
        assert order == sorted(order), "token ids must follow the order of merges"
        self._core = None

    def merge(self, piece: bytes) -> list[bytes]:
        """Joins the listed pair of lowest rank, leftmost first, until none is left."""
        tail = self.suffix if self.suffix and piece.endswith(self.suffix) else b""
        parts = [piece[i : i + 1] for i in range(len(piece) - len(tail))]
        if tail and parts:
            parts[-1] += tail
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                r = self.rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    at, best = i, r
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @functools.cached_property
    def whole(self) -> set[bytes]:
        """The vocabulary strings that merging alone brings back to one token."""
        return {s for s in self.vocab if len(s) == 1 or len(self.merge(s)) == 1}

    @functools.cached_property
    def _unproven(self) -> set[int]:
        return set(self.vocab.values()) - {self.vocab[s] for s in self.whole}

    @property
    def core(self):
        if self._core is None:
            import tiktoken

            extra = {WORD_END: max(self.vocab.values()) + len(self.special) + 1} if self.suffix else {}
            self._core = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=self.vocab | extra, special_tokens={})._core_bpe
        return self._core

    def pieces(self, piece: bytes) -> list[int]:
        """The ids of one pre-token (without its word end)."""
        out = self.core.encode_single_piece(piece + self.suffix)
        if self._unproven and not self._unproven.isdisjoint(out):
            return [self.vocab[s] for s in self.merge(piece + self.suffix)]
        return out

    def __getstate__(self):
        self.whole  # proven once, on the driver
        return self.__dict__ | {"_core": None}


@functools.lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(path)


#: The byte-level pre-tokenizer's published pattern, and that of the vocabulary with word ends.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Recent(dict):
    """A memo of `make(key)` that forgets the older half of its entries when it holds `most`; lookups are those of dict. Keys
    over LONGEST characters (runs of text without spaces) are not remembered, so `most` bounds its bytes too."""

    LONGEST = 64

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


#: The last of the Latin letters, which have long been assigned without gaps.
_SETTLED = "\u024f"


def unsettled(text: str) -> bool:
    """True for text with code points that were unassigned until lately: Unicode tables differ on their classes."""
    return not text.isascii() and max(text) > _SETTLED and any(unicodedata.category(c) == "Cn" for c in text)


@functools.lru_cache(4)
def library(path: str):
    """The tokenizers library itself, for unsettled text."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_LOCAL: dict = {}


def local(make, merger: Merger):
    """One `make(merger)` for all tasks that a Python worker runs, so that what it remembers serves them all."""
    key = (make, merger.path)
    if key not in _LOCAL:
        _LOCAL[key] = make(merger)
    return _LOCAL[key]


def split_special(text: str, special) -> tuple[list[str], int]:
    """The parts between special strings, and how many of those there are."""
    if not any(s in text for s in special):
        return [text], 0
    parts = re.split("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)), text)
    return parts, len(parts) - 1
