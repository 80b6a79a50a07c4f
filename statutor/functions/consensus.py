"""The weighted vote of the year signals, and the status that follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions.text import let

#: Signal columns in the order of their priority.
SIGNALS = {"enactment": "detected_enactment_year", "number": "detected_ordinance_no_year", "series": "detected_series_year", "approval": "detected_approval_year"}


def hundredths(c: Column) -> Column:
    """Rounded to two places as the exact binary value rounds: of the scores that can occur, 0.625 and 0.175 lie below
    their decimal form and round down."""
    return F.when(F.abs(c - 0.625) < 1e-9, 0.62).when(F.abs(c - 0.175) < 1e-9, 0.17).otherwise(F.round(c, 2))


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def resolve(signals: Column, folder_year: Column, has_text: Column, window: tuple[int, int] = X.STUDY_WINDOW) -> Column:
    """Resolved year, confidence, status, flags and notes, as one struct.

    Each signal votes for its year with its weight; the heaviest year wins, of equals the one with the signal of the
    highest priority. The score is the agreeing weight less half the disagreeing one. Without votes the council's term
    decides, at a score of 0. Null folder years match nothing.
    """
    return let(signals, lambda s: let(_winner(s), lambda year: let(_weighed(s, year), lambda w: _judged(s, year, w, folder_year, has_text, window))))


def _years(signals: Column) -> dict[str, Column]:
    return {k: signals[c] for k, c in SIGNALS.items()}


def _weight(cond: Column, signal: str) -> Column:
    return F.when(cond, X.WEIGHTS[signal]).otherwise(0.0)


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def _winner(signals: Column) -> Column:
    years = _years(signals)
    votes = [F.when(y.isNotNull(), F.struct(_sum([_weight(_same(z, y), k) for k, z in years.items()]).alias("votes"), F.lit(-i).alias("order"), y.alias("year"))) for i, y in enumerate(years.values())]
    return F.coalesce(F.array_max(F.array(*votes))["year"], signals["council_term_year"])


def _weighed(signals: Column, year: Column) -> Column:
    years = _years(signals)
    against = [_weight(y.isNotNull() & ~_same(y, year), k) for k, y in years.items()]
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _sum([_weight(_same(y, year), k) for k, y in years.items()]) - 0.5 * _sum(against)))
    return F.struct(raw.alias("raw"), _sum([_same(y, year).cast("int") for y in years.values()]).alias("agree"), _sum([y.isNotNull().cast("int") for y in years.values()]).alias("given"))


def _judged(signals: Column, resolved: Column, weighed: Column, folder_year: Column, has_text: Column, window: tuple[int, int]) -> Column:
    years, raw = _years(signals), weighed["raw"]
    mismatch = F.coalesce(resolved != folder_year, F.lit(False))
    backed = (weighed["agree"] >= 2) | _same(years["enactment"], resolved)
    outside = F.coalesce(~resolved.between(*window), F.lit(False))
    status = (
        F.when(~has_text | resolved.isNull(), "unresolved")
        .when(mismatch & (raw >= X.MISFILE_BAR) & backed, F.when(outside, "out_of_scope").otherwise("misfiled"))
        .when(mismatch, "review").when(outside, "out_of_scope").otherwise("valid")
    )
    e, n, s, a = (years[k] for k in ("enactment", "number", "series", "approval"))
    notes = F.concat_ws(
        "; ",
        F.when(e != a, F.format_string(X.NOTE_ENACTED_APPROVED, e, a)),
        F.when(s != n, F.format_string(X.NOTE_SERIES_NUMBER, s, n)),
        F.when(signals["ordinance_number_source"] == "header", F.lit(X.NOTE_HEADER_NUMBER)),
        F.when(~has_text, F.lit(X.NOTE_NO_TEXT)),
    )
    return let(status, lambda status: F.struct(
        resolved.alias("resolved_year"), hundredths(raw).alias("confidence_score"), weighed["agree"].alias("agreeing_signals"), weighed["given"].alias("available_signals"),
        status.alias("temporal_status"), (status.isin("misfiled", "out_of_scope") & mismatch).alias("is_misfiled"), outside.alias("is_out_of_scope"),
        status.isin("review", "unresolved").alias("needs_review"), notes.alias("conflict_notes"),
    ))
