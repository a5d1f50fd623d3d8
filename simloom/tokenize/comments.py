"""Comments of source texts.

One regular expression is built from a language's delimiters; it consumes escapes and strings as well, so that what
looks like a comment inside them isn't one.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Delimiters of strings, line comments and block comments, and escape characters."""

    strings: tuple[tuple[str, str], ...] = ()
    lines: tuple[str, ...] = ()
    blocks: tuple[tuple[str, str], ...] = ()
    escapes: tuple[str, ...] = ()


C_LIKE = Settings((('"""', '"""'), ('"', '"'), ("'", "'")), ("//",), (("/*", "*/"),), ("\\",))
PYTHON = Settings((('"""', '"""'), ("'''", "'''"), ('"', '"'), ("'", "'")), ("#",), (), ("\\",))
LISP = Settings((('"', '"'),), (";",), (("#|", "|#"),), ("\\",))
HTML = Settings(blocks=(("<!--", "-->"),))


@lru_cache
def _pattern(s: Settings) -> re.Pattern[str]:
    escape = "|".join(f"{re.escape(e)}." for e in s.escapes)
    inside = lambda end: f"(?:{escape + '|' if escape else ''}(?!{re.escape(end)}).)*"
    parts = [escape] if escape else []
    parts += [f"{re.escape(a)}{inside(b)}(?:{re.escape(b)})?" for a, b in s.strings]
    parts += [f"{re.escape(x)}(?P<line{k}>[^\n]*)" for k, x in enumerate(s.lines)]
    parts += [f"{re.escape(a)}(?P<block{k}>{inside(b)})(?:{re.escape(b)})?" for k, (a, b) in enumerate(s.blocks)]
    return re.compile("|".join(parts), re.S)


def scan(text: str, settings: Settings) -> list[tuple[str, int, int, str]]:
    """``(content, line, column, type)`` of each comment, both positions from 1, of the first character inside."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out = []
    for m in _pattern(settings).finditer(text):
        if m.lastgroup:
            at = m.start(m.lastgroup)
            line = bisect.bisect_right(starts, at)
            out.append((m[m.lastgroup], line, at - starts[line - 1] + 1, m.lastgroup.rstrip("0123456789").upper()))
    return out


def extract(df: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """One row for each comment: the key, content, line, column and type. Null texts have none."""
    schema = pa.schema([("content", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("type", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, c) for k, x in enumerate(batch.column(1).to_pylist()) for c in scan(x or "", settings)]
            keys = batch.column(0).take(pa.array([k for k, _ in found], pa.int64()))
            cols = [pa.array([c[j] for _, c in found], f.type) for j, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([keys, *cols], names=[key, *schema.names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, content string, line int, column int, type string")
