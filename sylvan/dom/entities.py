"""Character references: five named ones and numeric ones; everything else stays as it is."""

from __future__ import annotations

import re

#: The only named references that are decoded.
NAMED = {b"amp": b"&", b"lt": b"<", b"gt": b">", b"quot": b'"', b"apos": b"'"}

_REFERENCE = re.compile(rb"&(?:(amp|lt|gt|quot|apos)|#(?:[xX]([0-9A-Fa-f]+)|([0-9]+)));")


def _decoded(m: re.Match[bytes]) -> bytes:
    if m[1]:
        return NAMED[m[1]]
    code = int(m[2], 16) if m[2] else int(m[3][-4000:]) if len(m[3].lstrip(b"0")) < 8 else 0x110000
    # surrogates and numbers past Unicode are no characters
    return m[0] if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code).encode()


def decode(raw: bytes) -> bytes:
    """One pass: what a reference stands for is not decoded again."""
    return _REFERENCE.sub(_decoded, raw) if b"&" in raw else raw
