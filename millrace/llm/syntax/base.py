"""What the parsers share: errors, and recovery in panic mode."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from contextlib import contextmanager
from dataclasses import dataclass


@dataclass(frozen=True)
class Problem:
    line: int
    message: str


class Bad(Exception):
    """An error at a place; caught where a statement begins, where the parser then looks for the next safe token."""

    def __init__(self, pos: int, message: str):
        super().__init__(message)
        self.pos, self.message = pos, message


def at_lines(text: str, found: list[tuple[int, str]]) -> list[Problem]:
    """All errors (position, message) of a text with their lines; the text is read for line ends once."""
    ends = [m.start() for m in re.finditer("\n", text)] if found else []
    return [Problem(bisect_left(ends, pos) + 1, message) for pos, message in found]


#: Nesting beyond which a file is refused: the limit of Go's own parser. JavaScript and TypeScript set none; for them it only
#: keeps a text from taking all memory.
MOST_NESTED = 100_000
#: Frames a level of nesting may take. Python code calling Python code takes no machine stack, so this is bounded by memory only.
FRAMES = 30


@contextmanager
def deep():
    """Room for as deep a descent as MOST_NESTED asks for."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, MOST_NESTED * FRAMES))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)
