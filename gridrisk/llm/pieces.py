"""Cuts at which byte-level BPE's pre-tokenisation always has a boundary.

The pattern of the byte-level tokenizers takes a single space together with what follows it, and a
line feed between two signs alone.  So a text may be cut before a space and around a line feed that
have no white space beside them, and between a Latin letter and closing signs.
"""

from __future__ import annotations

import re

_LINES = re.compile(r"(?<=\S)\n(?=\S)")
_SPACES = re.compile(r"(?<=\S) (?=\S)")
TAIL = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"  # no apostrophe: it may begin a contraction


def pieces(text: str) -> list[str]:
    """The pieces in order; joined they are the text."""
    if "\0" not in text and text.split() == text.replace("\n", " ").split(" "):
        # all white space is single spaces and line feeds between signs
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    out = []
    for line in _LINES.split(text):
        first, *rest = _SPACES.split(line)
        out.append(first)
        out += [" " + x for x in rest]
        out.append("\n")
    out.pop()
    return out


def part_tail(piece: str) -> tuple[str, str]:
    """A piece without its closing signs, and those; no closing signs if the cut isn't certain."""
    core = piece.rstrip(TAIL)
    if len(core) < len(piece) and core and core[-1] < "ɐ" and core[-1].isalpha():
        return core, piece[len(core):]
    return piece, ""
