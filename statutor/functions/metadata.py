"""Bibliographic metadata of a document, as columns over its raw and its clean text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions.signals import full_dates, header
from statutor.functions.text import let, only_first, strip

LISTED = 12
KEYWORDS = 6


def title(text: Column) -> Column:
    """From "AN ORDINANCE" to the first sign that the title is over, on one line, at most 400 characters; '' if none."""
    t = strip(F.regexp_replace(F.regexp_replace(only_first(text, X.TITLE), "\n", " "), "[ \t ]{2,}", " "))
    return F.coalesce(F.substring(F.regexp_replace(t, r"(?Ud)\s*[.,;]\s*$", ""), 1, 400), F.lit(""))


def cited_numbers(text: Column, own: Column) -> Column:
    """The distinct ordinance numbers that the whole text names, in order, without its own."""
    p = F.lit(X.FLAGS + X.HEADER_NUMBER)
    named = F.zip_with(F.regexp_extract_all(text, p, F.lit(1)), F.regexp_extract_all(text, p, F.lit(2)), lambda a, b: F.concat(a, F.lit("-"), b))
    return F.array_distinct(F.filter(named, lambda x: ~x.eqNullSafe(own)))


def keywords(title_: Column) -> Column:
    """The first six distinct words of four or more letters of the title that are no stop words."""
    topical = F.lower(F.regexp_replace(title_, X.FLAGS + X.TITLE_NOISE, ""))
    words = F.regexp_extract_all(topical, F.lit("[a-z]{4,}"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*X.STOP_WORDS))), 1, KEYWORDS)


def metadata(text: Column, clean_text: Column, own_number: Column, known: Column | None = None) -> Column:
    """All fields of the bibliographic record, texts being '' where they are missing; ``known`` are the text's ``marks``."""
    t = F.coalesce(text, F.lit(""))
    given = lambda c: F.coalesce(strip(c), F.lit(""))
    enacted, approved = full_dates(t, known)
    signed = lambda name, office: F.when(t.rlike(X.FLAGS + r"\n\s*" + office), only_first(t, name))
    found = F.struct(title(t).alias("name"), cited_numbers(t, own_number).alias("cited"))

    def flat(f: Column) -> Column:
        return F.struct(
            f["name"].alias("title"), F.array_join(F.slice(f["cited"], 1, LISTED), "; ").alias("cited_ordinances"), F.size(f["cited"]).alias("cited_ordinance_count"),
            f["name"].rlike(X.FLAGS + X.AMENDATORY).alias("is_amendatory"), only_first(header(t), X.COUNCIL).try_cast("int").alias("council_term"),
            given(only_first(header(t), X.SESSION, 0)).alias("session_label"), given(only_first(t, X.SPONSOR)).alias("sponsor"),
            given(signed(X.MAYOR, X.MAYOR_OFFICE)).alias("approving_mayor"), given(signed(X.PRESIDING, X.PRESIDING_OFFICE)).alias("presiding_officer"),
            F.regexp_count(clean_text, F.lit(X.FLAGS + X.SECTION)).alias("section_count"), F.regexp_count(clean_text, F.lit(X.FLAGS + X.WHEREAS)).alias("whereas_count"),
            F.array_join(keywords(f["name"]), "; ").alias("subject_keywords"), enacted.alias("enactment_date"), approved.alias("approval_date"),
        )

    return let(found, flat)
