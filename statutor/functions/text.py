"""Text helpers with Unicode white space, and formats of the reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from statutor.functions import fixed


def raw(s: str) -> str:
    """A SQL literal of ``s``."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Every character that is white space in Unicode.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def n_words(c: Column) -> Column:
    """Words between white space; 0 for an empty text."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def plausible(year: Column) -> Column:
    return let(year.try_cast("int"), lambda y: F.when(y.between(*fixed.PLAUSIBLE_YEARS), y))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where nothing matches."""
    return F.get(F.regexp_extract_all(text, F.lit(fixed.FLAGS + pattern), F.lit(group)), F.lit(0))


def only_first(text: Column, pattern: str, group: int = 1) -> Column:
    """As ``first_group`` for a long text: no further match is sought. The group must not be empty where it matches."""
    return let(F.regexp_extract(text, fixed.FLAGS + pattern, group), lambda x: F.when(x != "", x))


def percent(part: Column, whole: Column) -> Column:
    """``12.5%``; ``0.0%`` of nothing."""
    return F.format_string("%.1f%%", F.when(whole > 0, 100.0 * part / whole).otherwise(0.0))


def year_or_dash(year: Column) -> Column:
    return F.coalesce(year.cast("string"), F.lit("-"))


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens; "untitled" where none are left."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\x00-\x7F]", "")), "[^a-z0-9]+", "-")
    t = F.regexp_replace(t, "^-+|-+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "untitled").otherwise(t)


def quoted(c: Column) -> Column:
    """A text as a YAML scalar in double quotes, with JSON's escapes."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\\"])", r"\\$1")
    for seen, written in (("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t")):
        t = F.regexp_replace(t, seen, written)
    return F.concat(F.lit('"'), t, F.lit('"'))


def thousands(c: Column) -> Column:
    return F.format_number(c.cast("long"), 0)
