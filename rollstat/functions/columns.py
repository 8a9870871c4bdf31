"""Column helpers used across the operators. All stay on the JVM side."""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters a plain strip removes.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: str | Column) -> Column:
    """Every Unicode blank on both ends removed."""
    return F.btrim(col(c), F.lit(BLANKS))


def blank_to_null(c: str | Column) -> Column:
    text = strip(c)
    return F.when(text != "", text)


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def collapse_ws(c: str | Column) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def word_count(c: str | Column) -> Column:
    """Default token counter: runs of non-blank characters."""
    return F.regexp_count(col(c), F.lit(r"(?U)\S+"))


def sha(*parts: str | Column) -> Column:
    """sha256 of the parts joined by a colon; literals go in as F.lit."""
    return F.sha2(F.concat_ws(":", *[col(p).cast("string") for p in parts]), 256)


def hash_unit(key: Column) -> Column:
    """A uniform number in [0, 1) from the first 12 hex digits of a hash."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def any_contains(text: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(text, F.lit(needle))
    return out


def last(items: Column) -> Column:
    """Last element of an array, null when the array is empty."""
    return F.try_element_at(items, F.lit(-1))


def r8(c: str | Column) -> Column:
    """Round to eight digits for stable reports.

    The small shift keeps exact ties (short decimals) off the rounding edge; adding
    zero turns minus zero into zero.
    """
    return F.round(col(c).cast("double") + F.lit(3e-11), 8) + F.lit(0.0)


def clamp(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(c)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
