"""Column functions for keys, names and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_key(code: Column, length: int = 8) -> Column:
    """The first digits of a code, whatever separates them."""
    return F.substring(F.regexp_replace(code, r"\D", ""), 1, length)


def name_key(name: Column) -> Column:
    """Runs of white space as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def decimal_comma(number: Column) -> Column:
    """'1 234,5' as a double; null where it isn't a number."""
    return F.replace(F.regexp_replace(number, r"[\s ]", ""), F.lit(","), F.lit(".")).try_cast("double")


def padded(code: Column, length: int) -> Column:
    return F.lpad(code.cast("string"), length, "0")


def signed_percent(x: Column, digits: int = 0) -> Column:
    """+12%, and −3% with a true minus sign; halves go to the even digit and -0.0 keeps its sign, as in printf. Null stays null."""
    sign = F.when(F.format_string("%+f", x).startswith("-"), "−").otherwise("+")
    text = F.concat(sign, F.format_string(f"%.{digits}f%%", F.abs(F.bround(x * 100, digits))))
    return F.when(x.isNotNull(), text)


def month_of(stamp: Column) -> Column:
    """YYYY-MM."""
    return F.substring(stamp.cast("string"), 1, 7)


def bin_of(x: Column, edges: list[float]) -> Column:
    """How many of the edges x has reached."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out
