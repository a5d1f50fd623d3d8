"""Numbers whose sums and roundings don't depend on the order of rows or on binary fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Similarities have six decimals; sums are taken in millionths.
MILLION = 1_000_000


def millionths(share: Column) -> Column:
    """A number of six decimals as a whole number of millionths."""
    return F.rint(share * MILLION).cast("long")


def rounded(x: Column, places: int = 6) -> Column:
    """``x`` to some decimals as SQL engines round doubles: scaled as a double, then half away from zero.

    Spark's own ``round`` takes the shortest decimal text of a double for its value, and so puts 0.0640625 up where
    the scaled double is just below the half; it also makes a text and a decimal of each number.
    """
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled)
    return F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / 10.0**places


def mean_of(total: Column, n: Column) -> Column:
    """The mean of ``n`` numbers whose millionths, none negative, add up to ``total``: six decimals, half up; null for none."""
    return F.when(n > 0, F.floor((2 * total.cast("decimal(38,0)") + n) / (2 * n.cast("decimal(20,0)"))).cast("long") / MILLION)


def percent(share: Column) -> Column:
    """A share as text in percent: two decimals, half up."""
    hundredths = F.floor((millionths(share) + 50) / 100).cast("long")
    return F.concat(F.floor(hundredths / 100).cast("long").cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("%"))


def day(timestamp: Column) -> Column:
    """A date as day, month and year, as reports write it."""
    return F.date_format(timestamp, "dd/MM/yy")


def duration(milliseconds: Column) -> Column:
    """Milliseconds as hours, minutes, seconds and milliseconds, such as ``1h 02min 03s 004ms``."""
    whole = lambda size: F.floor(milliseconds / size).cast("long")
    return F.format_string("%dh %02dmin %02ds %03dms", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, milliseconds.cast("long") % 1000)
