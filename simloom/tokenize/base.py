"""What tokenisers return."""

from __future__ import annotations

from typing import NamedTuple


class ParseError(ValueError):
    """A file that its tokeniser can't read."""


class Tok(NamedTuple):
    """Type and place; lines and columns count from 1, and -1 is no place."""

    type: str
    line: int
    column: int
    length: int


FILE_END = "EOF"
END = Tok(FILE_END, -1, -1, -1)
