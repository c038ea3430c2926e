"""Words of a text as bytes: A-Z lower-cased, maximal runs of ASCII letters, digits and non-ASCII characters.

In UTF-8 every byte of a non-ASCII character is 0x80 or more, so a byte table splits exactly as a character
class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` does after lower-casing A-Z.
"""

from __future__ import annotations

import re


def _table() -> bytes:
    kept = bytearray(b" " * 256)
    for c in range(256):
        if c >= 0x80 or chr(c).isalnum():
            kept[c] = c + 32 if 0x41 <= c <= 0x5A else c
    return bytes(kept)


TABLE = _table()
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """The words of a text; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of :func:`words` lie in the text: (start, end) in code points."""
    return [m.span() for m in _WORD.finditer(text)]
