"""Columns over texts, names and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ends_with_any(name: Column, suffixes: tuple[str, ...], ignore_case: bool) -> Column:
    """Whether ``name`` ends with one of ``suffixes``; with none given, true."""
    if not suffixes:
        return F.lit(True)
    name = F.lower(name) if ignore_case else name
    hits = [F.endswith(name, F.lit(s.lower() if ignore_case else s)) for s in suffixes]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def sanitized(name: Column) -> Column:
    """Path separators as underscores."""
    return F.translate(name, "/\\", "__")


def all_caps(name: Column) -> Column:
    """CamelCase as ALL_CAPS."""
    return F.upper(F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2"))


def csv_cell(value: Column) -> Column:
    """Quoted, with quotes doubled, only if it holds a quote."""
    return F.when(F.contains(value, F.lit('"')), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def version(text: Column) -> Column:
    """``struct(major, minor, patch)`` that orders like versions; a leading v and a -SNAPSHOT end don't count."""
    part = lambda k: F.regexp_extract(text, r"^v?(\d+)\.(\d+)\.(\d+)(?:-SNAPSHOT)?$", k).try_cast("int")
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def common_prefix(names: Column) -> Column:
    """The longest common prefix of an array of strings: that of its least and greatest."""
    low, high = F.array_min(names), F.array_max(names)
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))),
        F.lit(0),
        lambda acc, k: F.when((acc == k - 1) & (F.substr(low, k, F.lit(1)) == F.substr(high, k, F.lit(1))) & (k <= F.length(low)), k).otherwise(acc),
    )
    return F.substr(low, F.lit(1), n)
