"""The independent year signals of a document, as columns over its raw text and file name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions.anchors import after, anchors, before
from statutor.functions.text import first_group, let, only_first, plausible


def suffix_year(token: Column) -> Column:
    """Year of a number's suffix: four digits as they are, two digits around the pivot; else null."""
    pivot = X.PLAUSIBLE_YEARS[1] % 100

    def year(t: Column) -> Column:
        n, digits = t.try_cast("int"), t.rlike(r"(?U)^\d+$")
        return F.when(digits & (F.length(t) == 4), n).when(digits & (F.length(t) == 2), F.when(n <= pivot, n + 2000).otherwise(n + 1900))

    return plausible(let(token, year))


def stem(filename: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]*$", "")


def filename_number(filename: Column) -> tuple[Column, Column]:
    """(number, year) that the file's name states."""
    a, b = (first_group(stem(filename), X.FILENAME_NUMBER, k) for k in (1, 2))
    return F.concat(a, F.lit("-"), b), suffix_year(b)


def ends_in_cue(prefix: Column) -> Column:
    return prefix.rlike(X.FLAGS + X.CITATION_CUE)


def is_cited(text: Column, at: Column) -> Column:
    """Whether a place lies in a reference to another instrument: a cue right before it and an instrument nearby."""
    return let(before(text, at, X.LOOK_BACK), lambda p: p.rlike(X.FLAGS + X.INSTRUMENT) & (ends_in_cue(p) | p.rlike(X.FLAGS + X.RECITED_ACT)))


def header(text: Column) -> Column:
    return F.substring(text, 1, X.HEADER_CHARS)


def header_number(text: Column) -> Column:
    """``struct<number, year, rejected>``: the first number of the header that isn't cited; how many were, before it."""

    def found(h: Column) -> Column:
        return F.transform(anchors(h, X.HEADER_NUMBER), lambda a: F.struct(ends_in_cue(before(h, a["st"], X.NUMBER_LOOK_BACK)).alias("cited"), F.substring(h, a["st"] + 1, a["en"] - a["st"]).alias("hit")))

    def result(hits: Column) -> Column:
        place = F.array_position(F.transform(hits, lambda x: x["cited"]), F.lit(False))
        own = F.get(F.filter(hits, lambda x: ~x["cited"]), F.lit(0))["hit"]
        rejected = let(place, lambda k: F.when(k > 0, k - 1).otherwise(F.size(hits))).cast("int")
        parts = let(own, lambda x: F.struct(first_group(x, X.HEADER_NUMBER, 1).alias("a"), first_group(x, X.HEADER_NUMBER, 2).alias("b")))
        return let(parts, lambda p: F.struct(F.concat(p["a"], F.lit("-"), p["b"]).alias("number"), suffix_year(p["b"]).alias("year"), rejected.alias("rejected")))

    return let(let(header(text), found), result)


def series_year(text: Column) -> Column:
    """Year of the header's first series that isn't cited; null if that one is implausible."""

    def year(h: Column) -> Column:
        own = F.filter(anchors(h, X.SERIES), lambda a: ~ends_in_cue(before(h, a["st"], X.LOOK_BACK)))
        return F.substring(h, F.get(own, F.lit(0))["en"] - 3, F.lit(4))

    return plausible(let(header(text), year))


def council_year(text: Column) -> Column:
    """First year of the council term that the header names."""
    term, year, length = X.COUNCIL_ANCHOR
    n = only_first(header(text), X.COUNCIL).try_cast("int")
    return plausible(let(n, lambda n: F.when(n > 0, year + (n - term) * length)))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda year: F.when(year.isNotNull(), F.struct(year.alias("year"), F.lit(kind).alias("kind")))


def year_near(segment: Column, bare: bool = True) -> Column:
    """``struct<year, kind>`` of a date: full dates in the order of their patterns, then a bare year of the first half."""

    def kinds(seg: Column) -> Column:
        full = [plausible(only_first(seg, p, g)) for p, g in ((X.MONTH_FIRST, 2), (X.DAY_FIRST, 2), (X.NUMERIC_DATE, 1))]
        found = [(y, "full_date") for y in full]
        if bare:
            found.append((plausible(only_first(F.substring(seg, 1, X.DATE_WINDOW // 2), X.BARE_YEAR)), "bare_year"))
        return F.coalesce(*(let(y, _of_kind(k)) for y, k in found))

    return let(segment, kinds)


def own_places(text: Column, pattern: str) -> Column:
    """The places of a pattern's matches that stand in no reference to another instrument."""
    return F.filter(anchors(text, pattern), lambda a: ~is_cited(text, a["st"]))


def marks(text: Column) -> Column:
    """``struct<enacted, approved>``: the places that enactment, approval and their dates are read from, found once."""
    return F.struct(own_places(text, X.ENACTED).alias("enacted"), own_places(text, X.APPROVED).alias("approved"))


def first_of(places: Column, read: Callable[[Column], Column], kind: str) -> Column:
    """What ``read`` gives for the first place where it gives anything; later places aren't read."""
    return F.aggregate(places, F.lit(None).cast(kind), lambda seen, a: F.coalesce(seen, read(a)))


_YEAR = "struct<year:int,kind:string>"


def _dated(text: Column, own: Column) -> Column:
    return first_of(own, lambda a: year_near(after(text, a["en"], X.DATE_WINDOW)), _YEAR)


def _or_none(found: Column) -> Column:
    return F.coalesce(found, F.struct(F.lit(None).cast("int").alias("year"), F.lit("none").alias("kind")))


def enactment(text: Column, own: Column | None = None) -> Column:
    """``struct<year, kind>``, reading forward over the anchors of enactment (``own``, if they are known)."""
    return _or_none(_dated(text, own_places(text, X.ENACTED) if own is None else own))


def approval(text: Column, own: Column | None = None) -> Column:
    """``struct<year, kind>``, reading backward: after the last approvals (``own``) first, else around the signatures."""
    around = lambda a: year_near(after(text, F.greatest(a["st"] - X.DATE_WINDOW, F.lit(0)), 2 * X.DATE_WINDOW), bare=False)
    signed = first_of(F.reverse(anchors(text, X.SIGNATURE)), around, _YEAR)
    return _or_none(F.coalesce(_dated(text, F.reverse(own_places(text, X.APPROVED) if own is None else own)), signed))


def iso_date(segment: Column) -> Column:
    """The ISO date of the first pattern that gives day, month and year; null where it is no date of the calendar."""
    months = F.create_map(*(F.lit(x) for pair in X.MONTHS.items() for x in pair))

    def parts(pattern: str) -> Callable[[Column], Column]:
        return lambda hit: _parts(hit, pattern)

    def _parts(hit: Column, pattern: str) -> Column:
        day = F.get(F.filter(F.regexp_extract_all(hit, F.lit(r"(?U)\d{1,4}"), F.lit(0)), lambda d: (F.length(d) <= 2) & d.try_cast("int").between(1, 31)), F.lit(0))
        p = F.struct(months[F.lower(first_group(hit, f"({X.MONTH})"))].alias("m"), day.try_cast("int").alias("d"), plausible(only_first(hit, pattern, 2)).alias("y"))
        return let(p, lambda p: F.when(p["m"].isNotNull() & p["d"].isNotNull() & p["y"].isNotNull(), p))

    def date(seg: Column) -> Column:
        p = F.coalesce(*(let(only_first(seg, pattern, 0), parts(pattern)) for pattern in (X.MONTH_FIRST, X.DAY_FIRST)))
        return let(p, lambda p: F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"]), "yyyy-MM-dd"), "yyyy-MM-dd"))

    return let(segment, date)


def full_dates(text: Column, known: Column | None = None) -> tuple[Column, Column]:
    """ISO dates of enactment and approval, from ``marks``."""
    dated = lambda own: first_of(own, lambda a: iso_date(after(text, a["en"], X.DATE_WINDOW)), "string")
    own = marks(text) if known is None else known
    return dated(own["enacted"]), dated(F.reverse(own["approved"]))


def year_signals(text: Column, filename: Column, known: Column | None = None) -> Column:
    """All signals with where they come from, as one struct; ``known`` are the text's ``marks``, if there are. Null texts and
    names give no signal."""
    t = F.coalesce(text, F.lit(""))
    enacted, approved = (None, None) if known is None else (known["enacted"], known["approved"])
    file_no, file_year = filename_number(filename)
    found = F.struct(file_no.alias("no"), file_year.alias("year"), header_number(t).alias("head"), enactment(t, enacted).alias("en"), approval(t, approved).alias("ap"), series_year(t).alias("series"), council_year(t).alias("council"))

    def flat(f: Column) -> Column:
        head = f["head"]
        source = F.when(f["no"].isNotNull(), "filename").when(head["number"].isNotNull(), "header").otherwise("none")
        return F.struct(
            F.coalesce(f["no"], head["number"]).alias("ordinance_number"), source.alias("ordinance_number_source"),
            F.coalesce(f["no"] == head["number"], F.lit(False)).alias("filename_header_number_match"), head["rejected"].alias("citation_candidates_rejected"),
            f["series"].alias("detected_series_year"), F.coalesce(f["year"], head["year"]).alias("detected_ordinance_no_year"),
            f["en"]["year"].alias("detected_enactment_year"), f["ap"]["year"].alias("detected_approval_year"),
            f["en"]["kind"].alias("enactment_date_kind"), f["ap"]["kind"].alias("approval_date_kind"), f["council"].alias("council_term_year"),
        )

    return let(found, flat)
