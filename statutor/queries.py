"""The audit's queries, each over its whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions import signals as S
from statutor.functions.consensus import resolve
from statutor.functions.metadata import keywords
from statutor.functions.text import percent, quoted, slug, thousands, year_or_dash
from statutor.operators import curate, duplicates, report, vault
from statutor.operators.audit import apply_overrides, audit, debug_headers, override_template
from statutor.plans.views import live
from statutor import text_queries as TQ
from statutor.sources import documents as D
from statutor.sources import overrides as O
from statutor.sources.tables import shared_folder, table
from statutor.streaming.intake import audit_stream, stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ordinances_eda_summary_all")


def index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_index")


T = "ordinances_eda_summary_all"
LOSERS = f"""(SELECT s.*, file_hash IS NOT NULL AND row_number() OVER (PARTITION BY file_hash ORDER BY folder_year NULLS FIRST, filename NULLS FIRST, scan_seq) > 1 loses_hash,
 ordinance_number IS NOT NULL AND row_number() OVER (PARTITION BY ordinance_number ORDER BY NOT coalesce(folder_year = resolved_year, false), confidence_score DESC NULLS LAST, char_count DESC NULLS LAST, scan_seq) > 1 loses_number FROM {T} s)"""
FLAGGED = f"""(SELECT * EXCLUDE (removal_reason), CASE WHEN coalesce(manually_verified, false) AND temporal_status IS DISTINCT FROM 'out_of_scope' THEN '' WHEN loses_hash OR loses_number THEN 'duplicate'
 WHEN temporal_status = 'out_of_scope' THEN 'out_of_scope' WHEN coalesce(is_sparse, false) THEN 'sparse_or_unreadable' ELSE '' END removal_reason FROM {LOSERS})"""
TRUSTED = "coalesce(confidence_score >= 0.45::DOUBLE AND resolved_year IS NOT NULL, false)"
INDEXED = f"(SELECT *, CASE WHEN {TRUSTED} THEN resolved_year ELSE folder_year END corpus_year, removal_reason = '' AND NOT coalesce(is_sparse, false) included_in_corpus FROM {FLAGGED})"
VERDICTS = "(SELECT override_id, trim(filename) filename, correct_year, verified_by, evidence, note, folder_year, coalesce(priority, -1) priority FROM overrides_in WHERE correct_year BETWEEN 1900 AND 2035 AND filename IS NOT NULL)"


# Sources.


@query("SELECT DISTINCT folder_year FROM pages_in")
def folder_years(spark: SparkSession, d: str) -> DataFrame:
    return D.folder_years(table(spark, d, "pages_in"))


@query(f"""WITH p AS (SELECT file_path, page_index, max(by_ocr) o FROM {TQ.PAGE_TEXT} GROUP BY ALL)
SELECT file_path, count(*)::INT page_count, sum(o)::INT ocr_page_count, CASE WHEN sum(o) = 0 THEN 'Digital' WHEN sum(o) = count(*) THEN 'OCR' ELSE 'Hybrid' END extraction_method FROM p GROUP BY file_path""")
def extraction_method(spark: SparkSession, d: str) -> DataFrame:
    return D.page_counts(table(spark, d, "pages_in"))


@query(f"SELECT * FROM {TQ.DOCUMENTS}")
def documents(spark: SparkSession, d: str) -> DataFrame:
    return TQ.spark_documents(spark, d)


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("SELECT filename, corpus_year, included_in_corpus FROM corpus_index")
def pruned_index(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).select("filename", "corpus_year", "included_in_corpus")


@query("SELECT DISTINCT quarantine_path AS source, original_path AS target FROM manifest WHERE lower(trim(action_taken)) = 'quarantine'")
def restore_plan(spark: SparkSession, d: str) -> DataFrame:
    return curate.restore_plan(table(spark, d, "manifest"))


# Verdicts.


@query(f"SELECT filename, folder_year, correct_year, verified_by, evidence, note FROM {VERDICTS} QUALIFY row_number() OVER (PARTITION BY filename, folder_year ORDER BY priority DESC, override_id DESC) = 1")
def override_merge(spark: SparkSession, d: str) -> DataFrame:
    return O.merged(table(spark, d, "overrides_in")).drop("rank")


@query(f"SELECT filename, override_id, earlier_year, correct_year FROM (SELECT *, lag(correct_year) OVER (PARTITION BY filename ORDER BY priority, override_id) earlier_year FROM {VERDICTS}) WHERE earlier_year <> correct_year")
def override_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return O.conflicts(table(spark, d, "overrides_in"))


@query(f"""WITH v AS (SELECT s.scan_seq, o.* FROM {T} s JOIN {VERDICTS} o ON s.filename = o.filename AND (o.folder_year IS NULL OR o.folder_year = s.folder_year)
 QUALIFY row_number() OVER (PARTITION BY s.scan_seq ORDER BY o.priority DESC, o.override_id DESC) = 1)
SELECT s.scan_seq, s.filename, coalesce(v.correct_year, s.resolved_year) resolved_year, CASE WHEN v.scan_seq IS NULL THEN s.confidence_score ELSE 1.0 END confidence_score,
 CASE WHEN v.scan_seq IS NULL THEN s.temporal_status WHEN v.correct_year NOT BETWEEN 2016 AND 2024 THEN 'out_of_scope' WHEN v.correct_year IS DISTINCT FROM s.folder_year THEN 'misfiled' ELSE 'valid' END temporal_status,
 CASE WHEN v.scan_seq IS NULL THEN s.conflict_notes ELSE 'manually verified' || CASE WHEN trim(coalesce(v.verified_by, '')) <> '' THEN ' by ' || trim(v.verified_by) ELSE '' END || CASE WHEN trim(coalesce(v.evidence, '')) <> '' THEN '; evidence: ' || trim(v.evidence) ELSE '' END END conflict_notes,
 CASE WHEN v.scan_seq IS NULL THEN s.manually_verified ELSE true END manually_verified FROM {T} s LEFT JOIN v USING (scan_seq)""")
def override_apply(spark: SparkSession, d: str) -> DataFrame:
    out = apply_overrides(summary(spark, d), table(spark, d, "overrides_in"))
    return out.select("scan_seq", "filename", "resolved_year", "confidence_score", "temporal_status", "conflict_notes", "manually_verified")


@query(f"""SELECT folder_year, filename, resolved_year AS correct_year, '' AS verified_by, '' AS evidence,
 'pipeline said ' || temporal_status || ', folder ' || folder_year || ', conf ' || round(confidence_score, 2)::DOUBLE || ', signals E/O/S/A = ' || coalesce(detected_enactment_year::VARCHAR, '-') || '/' || coalesce(detected_ordinance_no_year::VARCHAR, '-') || '/' || coalesce(detected_series_year::VARCHAR, '-') || '/' || coalesce(detected_approval_year::VARCHAR, '-') AS note
FROM {T} WHERE temporal_status <> 'valid'""", "override_template")
def override_template_(spark: SparkSession, d: str) -> DataFrame:
    return override_template(summary(spark, d))


# Signals.


@query("""SELECT o_orderkey, token, CASE WHEN length(token) = 4 AND token::INT BETWEEN 1900 AND 2035 THEN token::INT WHEN length(token) = 2 THEN CASE WHEN token::INT <= 35 THEN 2000 + token::INT ELSE 1900 + token::INT END END::INT AS suffix_year
FROM (SELECT o_orderkey, (o_orderkey % 10000)::VARCHAR token FROM orders)""")
def suffix_year(spark: SparkSession, d: str) -> DataFrame:
    t = (F.col("o_orderkey") % 10000).cast("string")
    return table(spark, d, "orders").select("o_orderkey", t.alias("token"), S.suffix_year(t).alias("suffix_year"))


_STEM = r"regexp_replace(filename, '(.)\.[^.]*$', '\1')"
_NAME = r"(?i)(?:ordinance|ord)\.?\s*(?:no\.?|number|#)?\s*(\d{1,5})\s*[-–—_\s]\s*(\d{2,4})\b"


@query(f"""SELECT scan_seq, filename, CASE WHEN a <> '' THEN a || '-' || b END AS number, CASE WHEN length(b) = 4 AND b::INT BETWEEN 1900 AND 2035 THEN b::INT WHEN length(b) = 2 THEN CASE WHEN b::INT <= 35 THEN 2000 + b::INT ELSE 1900 + b::INT END END::INT AS year
FROM (SELECT scan_seq, filename, regexp_extract({_STEM}, '{_NAME}', 1) a, regexp_extract({_STEM}, '{_NAME}', 2) b FROM {T})""")
def filename_number(spark: SparkSession, d: str) -> DataFrame:
    number, year = S.filename_number(F.col("filename"))
    return summary(spark, d).select("scan_seq", "filename", number.alias("number"), year.alias("year"))


TQ.add_to(query)


@query(f"""WITH c AS (SELECT resolved_year r, folder_year f, detected_enactment_year enacted, detected_ordinance_no_year y, detected_series_year series, detected_approval_year approved, scan_seq FROM {T}),
 u AS (SELECT scan_seq, unnest([enacted, y, series, approved]) yr, unnest([0.45::DOUBLE, 0.25::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE]) w, unnest([0, 1, 2, 3]) p FROM c),
 g AS (SELECT scan_seq, yr, sum(w) s, min(p) p FROM u WHERE yr IS NOT NULL GROUP BY ALL), b AS (SELECT scan_seq, yr FROM g QUALIFY row_number() OVER (PARTITION BY scan_seq ORDER BY round(s, 6) DESC, p) = 1)
SELECT t.scan_seq, coalesce(b.yr, t.council_term_year) AS resolved_year FROM {T} t LEFT JOIN b USING (scan_seq)""")
def vote(spark: SparkSession, d: str) -> DataFrame:
    """The weighted vote over the signals that the summary holds."""
    s = summary(spark, d)
    r = resolve(F.struct(*s.columns), F.col("folder_year"), F.lit(True))
    return s.select("scan_seq", r["resolved_year"].alias("resolved_year"))


# Cleaning and metadata.


@query(r"""SELECT text_id, len(regexp_extract_all(clean_text, '(?im)^\s*sec(?:tion|\.)?\s*\d+'))::INT AS section_count, len(regexp_extract_all(clean_text, '(?i)\bwhereas\b'))::INT AS whereas_count, length(clean_text)::INT AS char_count FROM clean_text""")
def structure_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("clean_text")
    return table(spark, d, "clean_text").select("text_id", F.regexp_count(c, F.lit(X.FLAGS + X.SECTION)).alias("section_count"), F.regexp_count(c, F.lit(X.FLAGS + X.WHEREAS)).alias("whereas_count"), F.length(c).alias("char_count"))


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(rf"""WITH w AS (SELECT scan_seq, list_filter(regexp_extract_all(lower(regexp_replace(coalesce(title, ''), '(?i),?\s*(?:series\s+of\s+(?:19|20)\d{{2}}|as\s+amended|and\s+for\s+other\s+purposes)', '', 'g')), '[a-z]{{4,}}'), lambda x: NOT list_contains([{_STOPS}], x)) l FROM {T})
SELECT scan_seq, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:6], '; ') AS subject_keywords FROM w""", "keywords")
def keywords_(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d).select("scan_seq", F.array_join(keywords(F.coalesce("title", F.lit(""))), "; ").alias("subject_keywords"))


@query(rf"SELECT scan_seq, regexp_matches(coalesce(title, ''), '(?i)\bamend(?:ing|ed|atory)\b') AS is_amendatory FROM {T}")
def amendatory(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d).select("scan_seq", F.coalesce("title", F.lit("")).rlike(X.FLAGS + X.AMENDATORY).alias("is_amendatory"))


@query(rf"""SELECT scan_seq, CASE WHEN trim(s, '-') = '' THEN 'untitled' ELSE trim(s, '-') END AS slug, format('{{:,}}', char_count) AS chars, coalesce(resolved_year::VARCHAR, '-') AS year, '"' || replace(replace(coalesce(title, ''), '\', '\\'), '"', '\"') || '"' AS quoted FROM (SELECT *, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g') s FROM {T})""")
def formats(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d).select("scan_seq", slug(F.coalesce("title", F.lit(""))).alias("slug"), thousands(F.col("char_count")).alias("chars"), year_or_dash(F.col("resolved_year")).alias("year"), quoted(F.col("title")).alias("quoted"))


@query(TQ.RECORDS)
def audit_records(spark: SparkSession, d: str) -> DataFrame:
    return audit(TQ.spark_documents(spark, d))


@query(TQ.RECORDS)
def stream_intake(spark: SparkSession, d: str) -> DataFrame:
    """Documents as they come in, read as a stream and audited into a table of the shared folder, each exactly once."""
    out = shared_folder(spark, "intake")
    docs = TQ.spark_documents(spark, d)
    docs.write.parquet(f"{out}/arriving")
    audit_stream(stream(spark, f"{out}/arriving", docs.schema), f"{out}/records", f"{out}/progress").awaitTermination()
    return spark.read.parquet(f"{out}/records")


@query(f"""WITH first AS (SELECT * FROM {TQ.DOCUMENTS} ORDER BY file_path LIMIT 8), texts AS MATERIALIZED (SELECT file_path doc, filename, folder_year, coalesce("text", '') t FROM first), {TQ.VOTE},
 here AS (SELECT doc, arg_min(st, k) st FROM {TQ.places('texts', X.ENACTED + '|' + X.APPROVED)} GROUP BY doc)
SELECT filename, substring(t, 1, 600) AS head, substring(t, st + 1, 220) AS around_anchor, number AS ordinance_number, number_source AS ordinance_number_source, numbers_match AS filename_header_number_match, rejected AS citation_candidates_rejected, series AS detected_series_year, numbered AS detected_ordinance_no_year, enacted AS detected_enactment_year, approved AS detected_approval_year, enacted_kind AS enactment_date_kind, approved_kind AS approval_date_kind, council_year AS council_term_year FROM texts JOIN judged USING (doc) LEFT JOIN here USING (doc)""")
def header_sample(spark: SparkSession, d: str) -> DataFrame:
    return debug_headers(TQ.spark_documents(spark, d)).select("filename", "head", "around_anchor", "signals.*")


# The report's aggregates.


def _domain(column: str, domain: tuple[str, ...]) -> str:
    values = ", ".join(f"({i}, '{v}')" for i, v in enumerate(domain))
    return f"SELECT place, v AS {column}, count({column})::BIGINT AS n, printf('%.1f%%', 100.0 * count({column}) / greatest(1, (SELECT count(*) FROM {T}))) AS share FROM (VALUES {values}) t(place, v) LEFT JOIN {T} s ON s.{column} = t.v GROUP BY place, v"


@query(_domain("temporal_status", X.STATUSES))
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.status_counts(summary(spark, d))


@query(_domain("extraction_method", X.METHODS))
def method_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.method_counts(summary(spark, d))


@query(f"""SELECT folder_year, count(*) AS documents, coalesce(sum(ocr_page_count), 0)::BIGINT AS ocr_pages, round(avg(confidence_score), 9) AS mean_confidence, median(confidence_score) AS median_confidence, count(*) FILTER (agreeing_signals <= 1) AS single_signal,
 count(*) FILTER (ordinance_number IS NULL) AS unnumbered, count(*) FILTER (ordinance_number_source = 'filename') AS numbered_by_filename, count(*) FILTER (filename_header_number_match) AS numbers_agree,
 coalesce(sum(citation_candidates_rejected), 0)::BIGINT AS citations_rejected, count(*) FILTER (manually_verified) AS manually_verified FROM {T} GROUP BY folder_year""")
def confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    return report.inventory(summary(spark, d), ["folder_year"]).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(f"SELECT folder_year, (CASE WHEN grouping(folder_year) = 1 THEN 1 ELSE 0 END)::INT AS is_corpus, count(*) AS documents, round(avg(confidence_score), 9) AS mean_confidence, coalesce(sum(ocr_page_count), 0)::BIGINT AS ocr_pages FROM {T} GROUP BY GROUPING SETS ((folder_year), ())")
def two_levels(spark: SparkSession, d: str) -> DataFrame:
    return report.two_levels(summary(spark, d)).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("SELECT place, signal, extracted, documents, round(coalesce(100.0 * extracted / nullif(documents, 0), 0), 9)::DOUBLE AS coverage FROM (" + " UNION ALL ".join(f"SELECT {i} AS place, '{k}' AS signal, count({c}) AS extracted, count(*) AS documents FROM {T}" for i, (k, c) in enumerate(report.SIGNALS.items())) + ")")
def signal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return report.signal_coverage(summary(spark, d)).withColumn("coverage", F.round("coverage", 9))


@query(f"SELECT folder_year, count(detected_enactment_year) AS enacted, count(*) AS documents, count(detected_enactment_year) / count(*) < 0.5 AS warning FROM {T} GROUP BY folder_year")
def parser_health(spark: SparkSession, d: str) -> DataFrame:
    return report.parser_health(summary(spark, d))


@query(f"""SELECT folder_year, trunc(avg(char_count))::BIGINT AS mean_chars, trunc(median(char_count))::BIGINT AS median_chars, trunc(avg(word_count))::BIGINT AS mean_words, min(char_count)::BIGINT AS min_chars, max(char_count)::BIGINT AS max_chars,
 round(avg(page_count), 9) AS mean_pages, round(avg(chars_per_page), 6) AS mean_chars_per_page, count(*) FILTER (is_sparse) AS sparse, count(*) FILTER (chars_per_page < 100) AS low_density FROM {T} GROUP BY folder_year""")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    return report.text_statistics(summary(spark, d), ["folder_year"]).withColumns({"mean_pages": F.round("mean_pages", 9), "mean_chars_per_page": F.round("mean_chars_per_page", 6)})


@query(f"SELECT resolved_year, count(*) AS n FROM {T} WHERE resolved_year IS NOT NULL GROUP BY resolved_year")
def year_histogram(spark: SparkSession, d: str) -> DataFrame:
    return report.year_histogram(summary(spark, d))


_CROSS = ", ".join(f"count(*) FILTER (temporal_status = '{s}') AS {s}" for s in X.STATUSES)


@query(f"SELECT folder_year, {_CROSS}, count(*) AS total, round(avg(confidence_score), 9) AS mean_confidence FROM {T} GROUP BY folder_year")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    return report.crosstab(summary(spark, d)).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query(f"SELECT coalesce(corpus_year, folder_year) AS year, {_CROSS}, count(*) AS total FROM corpus_index GROUP BY 1")
def year_index(spark: SparkSession, d: str) -> DataFrame:
    return report.corpus_year_counts(index(spark, d))


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS files FROM (SELECT count(*) n FROM {T} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)" for k, c in (("hash", "file_hash"), ("number", "ordinance_number"))))
def duplicate_totals(spark: SparkSession, d: str) -> DataFrame:
    return report.duplicate_totals(summary(spark, d))


@query(f"SELECT folder_year, count(*) AS groups, sum(n)::BIGINT AS files FROM (SELECT folder_year, file_hash, count(*) n FROM {T} WHERE file_hash IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY folder_year")
def hash_dups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.group_totals(summary(spark, d), "file_hash", ["folder_year"])


@query(f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY ordinance_number) n, ((row_number() OVER (PARTITION BY ordinance_number ORDER BY scan_seq, filename NULLS FIRST) - 1) // 50)::INT part FROM {T} WHERE ordinance_number IS NOT NULL),
 y AS (SELECT ordinance_number, coalesce(string_agg(DISTINCT resolved_year::VARCHAR, ', ' ORDER BY resolved_year::VARCHAR), 'n/a') resolved_years FROM r GROUP BY ordinance_number)
SELECT ordinance_number, part, any_value(n) AS n_files, string_agg(filename, ', ' ORDER BY scan_seq, filename) AS files, any_value(resolved_years) AS resolved_years FROM r JOIN y USING (ordinance_number) WHERE n > 1 GROUP BY ordinance_number, part""")
def dup_listing(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.listing(summary(spark, d))


@query(f"SELECT * FROM (SELECT ordinance_number, scan_seq, filename, resolved_year, count(*) OVER (PARTITION BY ordinance_number) AS n_files FROM {T} WHERE ordinance_number IS NOT NULL) WHERE n_files > 1")
def dup_files(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.listed_files(summary(spark, d))


@query(f"SELECT scan_seq, loses_hash, loses_number, loses_hash OR loses_number AS is_loser FROM {LOSERS}")
def dup_losers(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_losers(summary(spark, d)).select("scan_seq", "loses_hash", "loses_number", "is_loser")


@query(f"SELECT scan_seq, removal_reason FROM {FLAGGED}")
def removal_reasons(spark: SparkSession, d: str) -> DataFrame:
    return curate.flag_removals(summary(spark, d)).select("scan_seq", "removal_reason")


@query(f"""SELECT scan_seq, CASE WHEN coalesce(manually_verified, false) AND temporal_status IS DISTINCT FROM 'out_of_scope' THEN '' WHEN loses_hash OR loses_number THEN 'duplicate' WHEN temporal_status = 'out_of_scope' THEN 'out_of_scope' WHEN temporal_status = 'misfiled' THEN 'misfiled'
 WHEN temporal_status = 'review' THEN 'low_confidence_review' WHEN temporal_status = 'unresolved' THEN 'unresolved' WHEN coalesce(is_sparse, false) THEN 'sparse_or_unreadable' ELSE '' END AS removal_reason FROM {LOSERS}""")
def removal_reasons_all(spark: SparkSession, d: str) -> DataFrame:
    """With every category switched on."""
    return curate.flag_removals(summary(spark, d), X.CATEGORIES).select("scan_seq", "removal_reason")


@query(f"SELECT scan_seq, CASE WHEN removal_reason <> '' THEN concat_ws('/', 'data/quarantine', removal_reason, folder_year::VARCHAR, filename) ELSE file_path END AS file_path FROM {FLAGGED}")
def paths_after_removal(spark: SparkSession, d: str) -> DataFrame:
    return curate.after_removal(curate.flag_removals(summary(spark, d))).select("scan_seq", "file_path")


@query(f"SELECT filename, file_path AS original_path, '' AS quarantine_path, 'purge' AS action, removal_reason, folder_year, resolved_year, confidence_score, ordinance_number FROM {FLAGGED} WHERE removal_reason <> ''")
def purge_plan(spark: SparkSession, d: str) -> DataFrame:
    return curate.purge_plan(curate.flag_removals(summary(spark, d)))


@query(f"SELECT removal_reason, count(*) AS n FROM {FLAGGED} WHERE removal_reason <> '' GROUP BY removal_reason")
def removal_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.removal_counts(curate.flag_removals(summary(spark, d)))


@query(f"SELECT filename, file_path AS original_path, concat_ws('/', 'data/quarantine', removal_reason, folder_year::VARCHAR, filename) AS quarantine_path, 'quarantine' AS action, removal_reason, folder_year, resolved_year, confidence_score, ordinance_number FROM {FLAGGED} WHERE removal_reason <> ''")
def quarantine_plan(spark: SparkSession, d: str) -> DataFrame:
    return curate.removal_plan(curate.flag_removals(summary(spark, d)))


@query(f"SELECT filename, file_path, folder_year, resolved_year, confidence_score, 'data/raw/' || resolved_year || '/' || filename AS target, coalesce(confidence_score >= 0.6::DOUBLE, false) AS eligible FROM {T} WHERE temporal_status = 'misfiled' AND resolved_year IS NOT NULL")
def relocation_plan(spark: SparkSession, d: str) -> DataFrame:
    return curate.relocation_plan(summary(spark, d))


@query(f"SELECT {', '.join(curate.INDEX)} FROM {INDEXED}")
def corpus_index(spark: SparkSession, d: str) -> DataFrame:
    return curate.corpus_index(curate.flag_removals(summary(spark, d)))


@query("SELECT * FROM corpus_index WHERE coalesce(included_in_corpus, true)")
def corpus_only(spark: SparkSession, d: str) -> DataFrame:
    return curate.corpus_only(index(spark, d))


@query(f"SELECT count(*) FILTER (included_in_corpus) AS kept, count(*) FILTER ({TRUSTED} AND resolved_year <> folder_year) AS redated, count(DISTINCT folder_year) AS folder_years FROM {INDEXED}")
def kept_redated(spark: SparkSession, d: str) -> DataFrame:
    return report.kept_and_redated(curate.corpus_index(curate.flag_removals(summary(spark, d))))


@query(f"""SELECT filename, coalesce(nullif(ordinance_number, ''), 'n/a') AS number, temporal_status, folder_year, resolved_year, confidence_score, concat_ws('/', agreeing_signals::VARCHAR, available_signals::VARCHAR) AS agree, coalesce(detected_enactment_year::VARCHAR, '-') AS enacted_shown,
 coalesce(detected_ordinance_no_year::VARCHAR, '-') AS number_shown, coalesce(detected_series_year::VARCHAR, '-') AS series_shown, coalesce(detected_approval_year::VARCHAR, '-') AS approved_shown, CASE WHEN resolved_year IS NULL THEN 'Manual review' ELSE 'data/raw/' || resolved_year || '/' END AS suggested_path FROM {T} WHERE temporal_status IN ('misfiled', 'out_of_scope')""")
def discrepancies(spark: SparkSession, d: str) -> DataFrame:
    return report.discrepancies(summary(spark, d))


@query(f"SELECT filename, coalesce(resolved_year::VARCHAR, '-') AS resolved, confidence_score, agreeing_signals, available_signals, CASE WHEN coalesce(conflict_notes, '') <> '' THEN conflict_notes WHEN resolved_year IS NULL THEN 'no year signal recovered' ELSE 'mismatch below confidence bar' END AS reason FROM {T} WHERE temporal_status IN ('review', 'unresolved')")
def review_reasons(spark: SparkSession, d: str) -> DataFrame:
    return report.for_review(summary(spark, d))


@query(f"SELECT folder_year, printf('%.1f%%', 100.0 * count(*) FILTER (is_sparse) / count(*)) AS sparse_share FROM {T} GROUP BY folder_year")
def sparse_share(spark: SparkSession, d: str) -> DataFrame:
    s = F.sum(F.coalesce("is_sparse", F.lit(False)).cast("int"))
    return summary(spark, d).groupBy("folder_year").agg(percent(s, F.count("*")).alias("sparse_share"))


# The vault and its live queries.


@query()
def notes(spark: SparkSession, d: str) -> DataFrame:
    i = vault.named(curate.with_corpus_year(curate.flag_removals(summary(spark, d))))
    return vault.notes(i.join(table(spark, d, "clean_text").select("clean_text_path", "clean_text"), "clean_text_path", "left"))


_NOTED = f"""(SELECT *, CASE WHEN scan_seq IS NOT DISTINCT FROM max(scan_seq) OVER (PARTITION BY yr, stem) THEN stem ELSE stem || ' (' || coalesce(scan_seq::VARCHAR, '-') || ')' END note FROM (SELECT *, coalesce(coalesce(corpus_year, folder_year)::VARCHAR, 'undated') yr, CASE WHEN coalesce(ordinance_number, '') <> '' THEN 'Ordinance No. ' || ordinance_number ELSE coalesce(nullif({_STEM}, ''), 'untitled') END stem FROM corpus_index))"""
_LINES = f"(SELECT coalesce(corpus_year, folder_year) AS year, note, substring(coalesce(title, ''), 1, 80) AS title, temporal_status, printf('%.2f', coalesce(confidence_score, 0)) AS confidence, coalesce(nullif(enactment_date, ''), '-') AS enacted, filename FROM {_NOTED})"


@query(f"SELECT * FROM {_LINES}")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    return vault.index_rows(index(spark, d))


_NL = " || chr(10) || "
_INDEX_HEAD = _NL.join(["'---'", "'title: \"Ordinance index ' || y || '\"'", "'corpus_year: ' || y", "'document_count: ' || n", "'tags: [index, ordinance, davao, year/' || y || ']'", "'---'", "''", "'# Ordinance index ' || y", "''", "n || ' document(s) indexed under corpus year ' || y || '.'", "''", *(f"'{x}'" for x in X.INDEX_COUNTS), *(f"'| {s} | ' || {s} || ' |'" for s in X.STATUSES), "''", *(f"'{x}'" for x in X.INDEX_DOCUMENTS)])
_INDEX_FOOT = _NL.join(f"'{x}'" for x in ("", *X.INDEX_QUERY, "", X.BACK_LINK, ""))


@query(f"""WITH c AS (SELECT coalesce(coalesce(corpus_year, folder_year)::VARCHAR, 'undated') y, count(*) n, {', '.join(f"count(*) FILTER (temporal_status = '{s}') AS {s}" for s in X.STATUSES)} FROM corpus_index GROUP BY 1),
 l AS (SELECT coalesce(year::VARCHAR, 'undated') y, filename, '| [[' || note || ']] | ' || title || ' | ' || coalesce(temporal_status, 'None') || ' | ' || confidence || ' | ' || enacted || ' |' row FROM {_LINES}),
 r AS (SELECT y, row, row_number() OVER (PARTITION BY y ORDER BY filename NULLS FIRST, row) - 1 place FROM l)
SELECT y || '/_Index ' || y || '.md' AS path, part, content FROM (SELECT y, -1 part, {_INDEX_HEAD} AS content FROM c UNION ALL SELECT y, (place // 10000)::INT, string_agg(row, chr(10) ORDER BY place) FROM r GROUP BY y, place // 10000 UNION ALL SELECT y, ((n + 9999) // 10000)::INT, {_INDEX_FOOT} FROM c)""")
def year_indices(spark: SparkSession, d: str) -> DataFrame:
    return vault.year_indices(index(spark, d))


@query(f"SELECT folder_year, {_CROSS}, count(*) AS total, '[[_Index ' || folder_year || ']]' AS link FROM {T} GROUP BY folder_year")
def corpus_map(spark: SparkSession, d: str) -> DataFrame:
    return vault.corpus_map(summary(spark, d))


@query(f"""WITH e AS (SELECT DISTINCT scan_seq, ordinance_number AS source_number, trim(c) cited FROM (SELECT scan_seq, ordinance_number, unnest(string_split(coalesce(cited_ordinances, ''), ';')) c FROM {T}) WHERE trim(c) <> '')
SELECT scan_seq, source_number, cited, EXISTS (SELECT 1 FROM {T} s WHERE s.ordinance_number = e.cited) AS resolved FROM e""")
def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    return vault.citation_edges(summary(spark, d))


@query(f"SELECT filename, folder_year, resolved_year, confidence_score, conflict_notes FROM {T} WHERE temporal_status <> 'valid'")
def needs_attention(spark: SparkSession, d: str) -> DataFrame:
    return live(summary(spark, d), "needs_attention")


@query(f"SELECT filename, ordinance_number, confidence_score, resolution_source FROM {T} WHERE confidence_score < 0.5")
def thin_evidence(spark: SparkSession, d: str) -> DataFrame:
    return live(summary(spark, d), "thin_evidence")


@query("SELECT corpus_year, ordinance_number, temporal_status, confidence_score, enactment_date FROM corpus_index")
def year_listing(spark: SparkSession, d: str) -> DataFrame:
    return live(index(spark, d), "year_index")


@query(f"SELECT filename, ordinance_number, corpus_year, cited_ordinances FROM {INDEXED} WHERE is_amendatory")
def amendment_network(spark: SparkSession, d: str) -> DataFrame:
    s = curate.flag_removals(summary(spark, d))
    return live(s.withColumn("corpus_year", F.when(curate.trusted(), F.col("resolved_year")).otherwise(F.col("folder_year"))), "amendment_network")
