"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutor.llm.common import table
from statutor.llm.distinctive import index_terms
from statutor.llm.leakage import find_leaks
from statutor.llm.mixture import check_mix, mix, mix_texts
from statutor.llm.neardup import NearDuplicates, all_groups
from statutor.llm.ocr import RepairedPages
from statutor.llm.pieces import section_audit, split_oversized
from statutor.llm.repetition import measure_repetition
from statutor.llm.repetitive import score_repetition
from statutor.llm.survivor import NO_TITLE, ordinance_groups, ordinance_survivors

LIMIT, OVERLAP = 6000, 200


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "clean_text"), "text_id", "clean_text", LIMIT, OVERLAP)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(table(spark, sf_dir, "clean_text"), "text_id", "clean_text", LIMIT, OVERLAP, with_text=False)
    return pieces.filter("n_pieces > 1").select("text_id", F.explode("section_starts").alias("start_at"))


def p1_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each text promise: put together they are the text again, none exceeds the limit, each repeats what it must."""
    pieces = split_oversized(table(spark, sf_dir, "clean_text"), "text_id", "clean_text", LIMIT, OVERLAP)
    own = F.expr("substring(piece_text, start_at - piece_start + 1)")
    repeats = F.col("start_at") - F.col("piece_start") == F.when(F.col("piece_no") == 0, F.lit(0)).otherwise(F.least(F.lit(OVERLAP), F.col("start_at")))
    fits = (F.length("piece_text") <= LIMIT) & (F.length("piece_text") == F.col("end_at") - F.col("piece_start"))
    d = pieces.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda x: x["own"]), "").alias("whole"), F.min(repeats & fits).alias("kept"), F.count("*").alias("n"), F.max("n_pieces").alias("said"))
    least = F.greatest(F.lit(1), F.ceil((F.length("whole") - OVERLAP) / (LIMIT - OVERLAP)))
    return d.select("text_id", F.length("whole").alias("n_chars"), F.sha2("whole", 256).alias("whole_hash"), F.col("kept").alias("within_limit_and_overlap"), ((F.col("n") == F.col("said")) & (F.col("n") >= least) & ((F.length("whole") > LIMIT) | (F.col("n") == 1))).alias("enough_pieces"))


def p1_section_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "clean_text")
    pieces = split_oversized(texts, "text_id", "clean_text", LIMIT, OVERLAP, with_text=False)
    return section_audit(table(spark, sf_dir, "corpus_index"), texts, pieces)


def repaired(spark: SparkSession, sf_dir: str) -> RepairedPages:
    return RepairedPages(*(table(spark, sf_dir, t) for t in ("pages_in", "ordinances_eda_summary_all", "clean_text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark, sf_dir).found.select("page_id", F.col("line_no").cast("long").alias("line_no"), "kind", "word").distinct()


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark, sf_dir).paragraphs()


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to nine places, so that engines whose logarithms differ in the last bit agree."""
    return index_terms(table(spark, sf_dir, "corpus_index")).withColumns({c: F.round(c, 9) for c in ("log_odds", "z")})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms whose z-score is that of a term which few records share, where counting confirms it."""
    return index_terms(table(spark, sf_dir, "corpus_index"), most_records=5).filter("n_records BETWEEN 2 AND 5").select("scan_seq", "term")


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinance_survivors(table(spark, sf_dir, "ordinances_eda_summary_all"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinance_groups(table(spark, sf_dir, "ordinances_eda_summary_all")).select("scan_seq", "group_seq")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ordinance_survivors(table(spark, sf_dir, "ordinances_eda_summary_all"))
    return best.filter("n_records >= 2").select("group_seq", "best_seq", "title_seq", F.col("approval_date_seq").alias("approval_seq"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "clean_text"), "text_id", "clean_text", words=3, threshold=0.7, min_words=40)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, sf_dir).pairs()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_groups(table(spark, sf_dir, "clean_text"), "text_id", "clean_text", words=3, threshold=0.7)


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each item a document holds, without the places in its text."""
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id", "n_runs", "longest_run", F.round("item_share", 9).alias("item_share"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_texts(p7_mix(spark, sf_dir))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_mix(*mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure_repetition(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_repetition(table(spark, sf_dir, "documents"), "doc_id", "text", share=0.4)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier holds possible or likely, where their exact share confirms it."""
    return p8_scores(spark, sf_dir).filter("verdict != 'clean' AND n_words >= 12 AND share_repeated >= 0.4").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p1_section_audit, p2_found, p2_paragraphs, p3_found, p3_terms, p4_found, p4_groups, p4_survivors, p5_found, p5_groups, p6_found, p6_leaks, p6_runs, p7_mix, p7_check, p7_shares, p7_texts, p8_found, p8_repetition, p8_scores)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_STAND_INS = ", ".join(f"'{t}'" for t in NO_TITLE)
_REAL = rf"regexp_replace(lower(title), '[^\p{{L}}]+', '', 'g') NOT IN ({_STAND_INS})"
_TERMS = rf"""(SELECT DISTINCT scan_seq, unnest(regexp_extract_all(CASE WHEN {_REAL} THEN lower(title) ELSE '' END || ' ' || lower(coalesce(subject_keywords, '')), '[a-z]{{4,}}')) term FROM corpus_index)"""
# Numbers as in number_key: words away, dashes alike, letters for digits, number and year as integers.
_NUMBER = r"""(SELECT *, regexp_extract(t, '^\D*?([0-9OolI|]{1,6})-+([0-9OolI|]{2}|[0-9OolI|]{4})\W*$', 1) a, regexp_extract(t, '^\D*?([0-9OolI|]{1,6})-+([0-9OolI|]{2}|[0-9OolI|]{4})\W*$', 2) b
 FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(translate(translate(coalesce(ordinance_number, ''), '０１２３４５６７８９－', '0123456789-'), '–—‐‑_/', '------'), '(?i)ordinances?|\bord\b\.?|\bnos?\b\.?|\bnumber\b|series|\bof\b|[#,]', ' ', 'g'), '\s*-\s*', '-', 'g'), '([0-9OolI|])\s+([0-9OolI|])', '\1-\2', 'g') t FROM ordinances_eda_summary_all))"""
_KEYED = rf"""(SELECT *, CASE WHEN a <> '' THEN 'n' || translate(a, 'OolI|', '00111')::INT || '-' || (CASE WHEN length(b) = 4 THEN 0 WHEN translate(b, 'OolI|', '00111')::INT <= 35 THEN 2000 ELSE 1900 END + translate(b, 'OolI|', '00111')::INT) END num,
 CASE WHEN trim(coalesce(file_hash, '')) <> '' AND coalesce(char_count, 1) <> 0 THEN 'h' || lower(trim(file_hash)) END hash FROM {_NUMBER})"""
#: The summary's records with their groups and their places in them.
_GROUPED = f"""k AS MATERIALIZED {_KEYED}, e AS MATERIALIZED (SELECT scan_seq s, num key FROM k WHERE num IS NOT NULL UNION SELECT scan_seq, hash FROM k WHERE hash IS NOT NULL UNION SELECT scan_seq, 's' || scan_seq FROM k),
 near AS MATERIALIZED (SELECT DISTINCT x.s a, y.s b FROM e x JOIN e y USING (key)), reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
 g AS (SELECT a s, min(b) group_seq FROM reach GROUP BY a), r AS (SELECT k.*, group_seq, CASE WHEN confidence_score BETWEEN 0 AND 1 THEN confidence_score END c, CASE WHEN page_count >= 1 THEN page_count END p FROM k JOIN g ON g.s = k.scan_seq),
 o AS (SELECT *, row_number() OVER (PARTITION BY group_seq ORDER BY c DESC NULLS LAST, p DESC NULLS LAST, run_at DESC NULLS LAST, scan_seq) place FROM r)"""
_TEXT_FIELDS = "filename file_path file_hash extraction_method ordinance_number ordinance_number_source enactment_date_kind approval_date_kind temporal_status conflict_notes resolution_source title cited_ordinances session_label sponsor approving_mayor presiding_officer subject_keywords enactment_date approval_date clean_text_path removal_reason".split()
_OTHER_FIELDS = (
    "run_at folder_year page_count ocr_page_count filename_header_number_match citation_candidates_rejected detected_series_year detected_ordinance_no_year detected_enactment_year detected_approval_year council_term_year resolved_year "
    "confidence_score agreeing_signals available_signals is_misfiled is_out_of_scope needs_review char_count word_count chars_per_page is_sparse manually_verified clean_char_count clean_word_count removed_chars dropped_lines rejoined_words "
    "noise_line_ratio cited_ordinance_count is_amendatory council_term section_count whereas_count"
).split()
_GIVEN = {c: _REAL if c == "title" else rf"regexp_matches({c}, '[^\\s]')" for c in _TEXT_FIELDS} | {c: f"{c} IS NOT NULL" for c in _OTHER_FIELDS} | {"confidence_score": "c IS NOT NULL", "page_count": "p IS NOT NULL"}
_BEST = ", ".join(f"arg_min({c}, place) FILTER ({g}) AS {c}, coalesce(arg_min(scan_seq, place) FILTER ({g}), 0) AS {c}_seq" for c, g in _GIVEN.items())
_WORDS = r"regexp_extract_all(regexp_replace(replace(lower(text), chr(173), ''), '-[ \t]*\r?\n[ \t]*', '', 'g'), '[\p{L}\p{N}]+')"

_SOURCE = r"nullif(regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s\-]+', '_', 'g'), '')"

SQL = {
    "p7_check": f"""WITH d AS (SELECT {_SOURCE} source, count(DISTINCT doc_id) n FROM documents WHERE text <> '' GROUP BY 1), t AS (SELECT {_SOURCE} source FROM source_targets)
SELECT coalesce(d.source, t.source) AS source, coalesce(n, 0)::BIGINT AS n_documents, true AS meets_target, true AS within_repeats, true AS none_twice, true AS full_blocks FROM d FULL JOIN t ON d.source = t.source""",
    "p3_found": f"SELECT scan_seq, term FROM {_TERMS} QUALIFY count(*) OVER (PARTITION BY term) BETWEEN 2 AND 5",
    "p4_found": f"""WITH RECURSIVE {_GROUPED}
SELECT group_seq, arg_min(scan_seq, place) AS best_seq, coalesce(arg_min(scan_seq, place) FILTER ({_REAL}), 0) AS title_seq, coalesce(arg_min(scan_seq, place) FILTER (trim(coalesce(approval_date, '')) <> ''), 0) AS approval_seq FROM o GROUP BY group_seq HAVING count(DISTINCT scan_seq) >= 2""",
    "p4_groups": f"WITH RECURSIVE {_GROUPED} SELECT scan_seq, group_seq FROM o",
    "p4_survivors": f"WITH RECURSIVE {_GROUPED} SELECT group_seq, count(DISTINCT scan_seq) AS n_records, arg_min(scan_seq, place) AS best_seq, {_BEST} FROM o GROUP BY group_seq",
    "p3_terms": rf"""WITH r AS (SELECT scan_seq, row_number() OVER () k, regexp_extract_all(CASE WHEN {_REAL} THEN lower(title) ELSE '' END, '[a-z]{{4,}}') || regexp_extract_all(lower(coalesce(subject_keywords, '')), '[a-z]{{4,}}') l FROM corpus_index WHERE scan_seq IS NOT NULL),
 e AS (SELECT scan_seq, term, max(c) y FROM (SELECT scan_seq, k, term, count(*) c FROM (SELECT scan_seq, k, unnest(l) term FROM r) GROUP BY ALL) GROUP BY ALL), n AS (SELECT scan_seq, sum(y) n FROM e GROUP BY 1), s AS (SELECT term, count(*) n_records, sum(y) al FROM e GROUP BY 1), t AS (SELECT sum(y)::DOUBLE total FROM e),
 f AS (SELECT scan_seq, term, y, n_records, 500.0::DOUBLE * al / total a, n::DOUBLE n, (al - y)::DOUBLE rest, total FROM e JOIN n USING (scan_seq) JOIN s USING (term), t),
 z AS (SELECT *, ln((y + a) / greatest(n + 500 - y - a, 1e-9)) - ln((rest + a) / greatest(total - n + 500 - rest - a, 1e-9)) odds FROM f)
SELECT scan_seq, term, y::BIGINT AS n_in_record, n_records, round(odds, 9) AS log_odds, round(odds / sqrt(1 / (y + a) + 1 / (rest + a)), 9) AS z FROM z""",
    "p1_cover": "SELECT text_id, length(clean_text)::INT AS n_chars, sha256(clean_text) AS whole_hash, true AS within_limit_and_overlap, true AS enough_pieces FROM clean_text WHERE clean_text IS NOT NULL",
    "p5_groups": r"""WITH RECURSIVE w AS (SELECT text_id, coalesce(regexp_extract_all(lower(clean_text), '[\p{L}\p{N}]+'), []) l FROM clean_text), g AS (SELECT DISTINCT text_id, list_slice(l, i, i + 2) x FROM (SELECT text_id, l, unnest(range(1, len(l) - 1)) i FROM w WHERE len(l) >= 3)),
 k AS (SELECT text_id, md5(string_agg(array_to_string(x, ' '), chr(10) ORDER BY x)) k, count(*) c FROM g GROUP BY text_id UNION ALL SELECT text_id, CASE WHEN len(l) = 0 THEN 'own ' || text_id ELSE 'words ' || array_to_string(l, ' ') END, 0 FROM w WHERE len(l) < 3),
 m AS MATERIALIZED (SELECT text_id, c, min(text_id) OVER (PARTITION BY k) rep FROM k), p AS (SELECT text_id, c FROM m WHERE text_id = rep), gp AS (SELECT g.* FROM g JOIN p USING (text_id)),
 common AS (SELECT a.text_id ta, b.text_id tb, count(*) n FROM gp a JOIN gp b ON a.x = b.x AND a.text_id < b.text_id GROUP BY ALL), links AS MATERIALIZED (SELECT ta, tb FROM common JOIN p a ON a.text_id = ta JOIN p b ON b.text_id = tb WHERE n >= 0.7::DOUBLE * (a.c + b.c - n) - 1e-9),
 ends AS MATERIALIZED (SELECT ta a, tb b FROM links UNION SELECT tb, ta FROM links UNION SELECT text_id, text_id FROM p), reach AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b), top AS (SELECT a, min(b) group_id FROM reach GROUP BY a), deg AS (SELECT a, count(*) n FROM ends WHERE a <> b GROUP BY a)
SELECT text_id AS id, rep AS class_id, group_id, coalesce(n, 0)::BIGINT AS n_links FROM m JOIN top ON top.a = rep LEFT JOIN deg ON deg.a = rep""",
    "p6_runs": f"""WITH d AS MATERIALIZED (SELECT doc_id, i, list_slice(l, i, i + 11) x FROM (SELECT doc_id, l, unnest(range(1, len(l) - 10)) i FROM (SELECT doc_id, {_WORDS} l FROM documents) WHERE len(l) >= 12)),
 e AS MATERIALIZED (SELECT item_id, len(l) n, k, list_slice(l, k, k + 11) x FROM (SELECT item_id, l, unnest(range(1, len(l) - 10)) k FROM (SELECT item_id, {_WORDS} l FROM eval_items) WHERE len(l) >= 12)),
 h AS (SELECT doc_id, item_id, n, i, k, i - k diagonal, i - row_number() OVER (PARTITION BY doc_id, item_id, i - k ORDER BY i) island FROM d JOIN e USING (x)),
 r AS (SELECT doc_id, item_id, n, min(k) k, count(*) + 11 len FROM h GROUP BY doc_id, item_id, n, diagonal, island), c AS (SELECT doc_id, item_id, count(DISTINCT p) held FROM (SELECT doc_id, item_id, unnest(range(k, k + len)) p FROM r) GROUP BY ALL)
SELECT doc_id, item_id, count(*)::INT AS n_runs, max(len)::INT AS longest_run, round(any_value(held) / any_value(n)::DOUBLE, 9) AS item_share FROM r JOIN c USING (doc_id, item_id) GROUP BY doc_id, item_id""",
    "p5_found": r"""WITH w AS (SELECT text_id, regexp_extract_all(lower(clean_text), '[\p{L}\p{N}]+') l FROM clean_text), g AS (SELECT DISTINCT text_id, list_slice(l, i, i + 2) x FROM (SELECT text_id, l, unnest(range(1, len(l) - 1)) i FROM w WHERE len(l) >= 40)),
 n AS (SELECT text_id, count(*) c FROM g GROUP BY text_id), common AS (SELECT a.text_id ta, b.text_id tb, count(*) c FROM g a JOIN g b ON a.x = b.x AND a.text_id < b.text_id GROUP BY ALL)
SELECT ta AS text_a, tb AS text_b FROM common JOIN n p ON p.text_id = ta JOIN n q ON q.text_id = tb WHERE common.c >= 0.7::DOUBLE * (p.c + q.c - common.c) - 1e-9""",
    "p6_found": f"""WITH d AS (SELECT doc_id, list_slice(l, i, i + 11) x FROM (SELECT doc_id, l, unnest(range(1, len(l) - 10)) i FROM (SELECT doc_id, {_WORDS} l FROM documents) WHERE len(l) >= 12)),
 e AS (SELECT item_id, list_slice(l, i, i + 11) x FROM (SELECT item_id, l, unnest(range(1, len(l) - 10)) i FROM (SELECT item_id, {_WORDS} l FROM eval_items) WHERE len(l) >= 12)) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (x)""",
    "p8_found": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') l FROM documents), g AS (SELECT doc_id, i, list_slice(l, i, i + 5) x FROM (SELECT doc_id, l, unnest(range(1, len(l) - 4)) i FROM w WHERE len(l) >= 12)),
 again AS (SELECT doc_id, i FROM g QUALIFY i > min(i) OVER (PARTITION BY doc_id, x)), hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 6)) p FROM again) SELECT doc_id FROM (SELECT doc_id, count(*) n FROM hit GROUP BY doc_id) JOIN w USING (doc_id) WHERE n >= 0.4::DOUBLE * len(l)""",
    "p8_repetition": r"""WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '\p{L}+'), []) l FROM documents), g AS (SELECT doc_id, i, list_slice(l, i, i + 5) x FROM (SELECT doc_id, l, unnest(range(1, len(l) - 4)) i FROM w WHERE len(l) >= 6)),
 again AS (SELECT doc_id, i FROM g QUALIFY i > min(i) OVER (PARTITION BY doc_id, x)), hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 6)) p FROM again), c AS (SELECT doc_id, count(*) n FROM hit GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_repeated, coalesce(n, 0) / greatest(1, len(l))::DOUBLE AS share_repeated FROM w LEFT JOIN c USING (doc_id)""",
}
