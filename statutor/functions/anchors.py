"""Places of all matches of a pattern, from built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statutor.functions import fixed


_MARK = "\x01"


def anchors(text: Column, pattern: str) -> Column:
    """``array<struct<st, en>>``: begin and end (0-based, exclusive) of each match, in order; empty for null.

    Each match is set between marks in one pass of the pattern, and the text is split at the marks: gaps and matches
    alternate, so a running sum of their lengths gives the places. The pattern must not match the empty text.
    """
    t = F.translate(F.coalesce(text, F.lit("")), _MARK, " ")  # as long as before
    sizes = F.transform(F.split(F.regexp_replace(t, fixed.FLAGS + pattern, f"{_MARK}$0{_MARK}"), _MARK, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<st:int,en:int>>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        en = acc["at"] + n
        return F.struct(en.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("st"), en.alias("en"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def before(text: Column, at: Column, chars: int) -> Column:
    """The ``chars`` characters before the place, fewer at the beginning."""
    low = F.greatest(at - F.lit(chars), F.lit(0))
    return F.substring(text, low + 1, at - low)


def after(text: Column, at: Column, chars: int) -> Column:
    return F.substring(text, at + 1, F.lit(chars))
