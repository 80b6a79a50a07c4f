"""From documents to audit records, with human verdicts laid over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions.cleaning import clean
from statutor.functions.consensus import resolve
from statutor.functions.metadata import metadata
from statutor.functions.signals import marks, year_signals
from statutor.functions.text import n_words, strip
from statutor.sources.overrides import merged

#: The record's columns after those of the document itself.
SUMMARY = (
    "filename file_path file_hash folder_year extraction_method page_count ocr_page_count ordinance_number ordinance_number_source filename_header_number_match "
    "citation_candidates_rejected detected_series_year detected_ordinance_no_year detected_enactment_year detected_approval_year enactment_date_kind approval_date_kind "
    "council_term_year resolved_year confidence_score agreeing_signals available_signals temporal_status is_misfiled is_out_of_scope needs_review conflict_notes char_count "
    "word_count chars_per_page is_sparse resolution_source manually_verified clean_char_count clean_word_count removed_chars dropped_lines rejoined_words noise_line_ratio "
    "title cited_ordinances cited_ordinance_count is_amendatory council_term session_label sponsor approving_mayor presiding_officer section_count whereas_count "
    "subject_keywords enactment_date approval_date clean_text_path"
).split()


def audit(documents: DataFrame, window: tuple[int, int] = X.STUDY_WINDOW, clean_root: str = "", keep_text: bool = False) -> DataFrame:
    """One record of 54 columns per document (and ``clean_text`` if wanted): one narrow pass, no shuffle.

    Signals come from the raw text, so that cleaning never moves a year. A null text is an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    d = documents.withColumns({"_marks": marks(text), "_stripped": F.length(strip(text)), "_clean": clean(text)})
    d = d.withColumn("_signals", year_signals(text, F.col("filename"), F.col("_marks")))
    d = d.withColumns({"_resolution": resolve(F.col("_signals"), F.col("folder_year"), F.col("_stripped") >= X.TEXT_CHARS, window), "_meta": metadata(text, F.col("_clean.clean"), F.col("_signals.ordinance_number"), F.col("_marks"))})
    d = d.withColumns({
        "char_count": F.length(text), "word_count": n_words(text), "is_sparse": F.col("_stripped") < X.SPARSE_CHARS,
        "chars_per_page": F.when(F.col("page_count") > 0, F.round(F.length(text) / F.col("page_count"), 1)).otherwise(0.0),
        "resolution_source": F.lit("consensus"), "manually_verified": F.lit(False),
        "clean_text_path": F.when(F.lit(clean_root) == "", "").otherwise(F.concat(F.lit(clean_root + "/"), F.col("folder_year"), F.lit("/"), F.regexp_replace("filename", r"\.[^.]*$", ""), F.lit(".txt"))),
    })
    flat = d.select("*", "_signals.*", "_resolution.*", "_clean.*", "_meta.*")
    return flat.select(*SUMMARY, *([F.col("clean").alias("clean_text")] if keep_text else []))


def apply_overrides(records: DataFrame, overrides: DataFrame, window: tuple[int, int] = X.STUDY_WINDOW) -> DataFrame:
    """Records with the verdict on them, if there is one: by file name, for their folder year or for all years.

    A blank name or evidence leaves its part of the note out. Verdicts are joined one per key, so nothing fans out.
    """
    best = merged(overrides)
    fields = [F.col(c) for c in ("rank", "correct_year", "verified_by", "evidence")]
    shared = best.filter("folder_year IS NULL").select("filename", F.struct(*fields).alias("_all"))
    yearly = best.filter("folder_year IS NOT NULL").select("filename", "folder_year", F.struct(*fields).alias("_own"))
    d = records.join(shared, "filename", "left").join(yearly, ["filename", "folder_year"], "left")
    d = d.withColumn("_v", F.greatest("_all", "_own"))
    year, hit = F.col("_v.correct_year"), F.col("_v").isNotNull()
    said = lambda lead, c: F.when(strip(F.col(f"_v.{c}")) != "", F.concat(F.lit(lead), strip(F.col(f"_v.{c}"))))
    note = F.concat(F.lit(X.NOTE_VERIFIED), F.coalesce(said(X.NOTE_VERIFIED_BY, "verified_by"), F.lit("")), F.coalesce(said(X.NOTE_EVIDENCE, "evidence"), F.lit("")))
    outside = ~year.between(*window)
    over = {
        "resolved_year": year, "confidence_score": F.lit(1.0), "resolution_source": F.lit("manual_override"), "manually_verified": F.lit(True),
        "agreeing_signals": F.col("available_signals"), "temporal_status": F.when(outside, "out_of_scope").when(~year.eqNullSafe(F.col("folder_year")), "misfiled").otherwise("valid"),
        "is_misfiled": ~year.eqNullSafe(F.col("folder_year")), "is_out_of_scope": outside, "needs_review": F.lit(False), "conflict_notes": note,
    }
    return d.select(*(F.when(hit, over[c]).otherwise(F.col(c)).cast(t).alias(c) if c in over else F.col(c) for c, t in records.dtypes))


def override_template(records: DataFrame) -> DataFrame:
    """A sheet row for each record that isn't valid, by folder year, for people to give their verdict on."""
    from statutor.functions.text import year_or_dash

    signals = F.concat_ws("/", *(year_or_dash(F.col(f"detected_{s}_year")) for s in ("enactment", "ordinance_no", "series", "approval")))
    note = F.concat(F.lit("pipeline said "), F.col("temporal_status"), F.lit(", folder "), F.col("folder_year"), F.lit(", conf "), F.round("confidence_score", 2).cast("string"), F.lit(", signals E/O/S/A = "), signals)
    return records.filter("temporal_status != 'valid'").select("folder_year", "filename", F.col("resolved_year").alias("correct_year"), F.lit("").alias("verified_by"), F.lit("").alias("evidence"), note.alias("note"))


def debug_headers(documents: DataFrame, sample: int = 8) -> DataFrame:
    """The first ``sample`` documents by path: their header, what follows the first anchor, and their signals."""
    from statutor.functions.anchors import after, anchors

    t = F.coalesce("text", F.lit(""))
    first = F.get(anchors(t, X.ENACTED + "|" + X.APPROVED), F.lit(0))["st"]
    return documents.orderBy("file_path").limit(sample).select("filename", F.substring(t, 1, 600).alias("head"), after(t, first, 220).alias("around_anchor"), year_signals(t, F.col("filename")).alias("signals"))
