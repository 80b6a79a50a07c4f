"""Queries of the signals, the vote, cleaning and metadata over all texts of the corpus, and the same in SQL.

The texts are those of ``clean_text`` and the documents made of ``pages_in``. The SQL finds the places of matches for itself, by
taking the text apart at them, and asks the same patterns as the operators do, in the dialect of its own engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions import signals as S
from statutor.functions.anchors import anchors
from statutor.functions.cleaning import clean
from statutor.functions.consensus import resolve
from statutor.functions.metadata import cited_numbers, metadata, title
from statutor.functions.text import strip
from statutor.sources.documents import documents_from_pages, with_file_hashes
from statutor.sources.tables import table

#: White space as Java's Unicode classes have it.
SPACE = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def re2(pattern: str, flags: str = "(?i)") -> str:
    """A SQL literal of a pattern in the dialect of RE2, with the same white space."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two[:1] == "\\":
            out.append(two)
        else:
            inside = two[:1] == "[" or (inside and two[:1] != "]")
            out.append(two[:1])
        i += 2 if two[:1] == "\\" else 1
    return "'" + flags + "".join(out).replace("'", "''") + "'"


def spark_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents_from_pages(with_file_hashes(table(spark, d, "pages_in"), table(spark, d, "ordinances_eda_summary_all")))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Rows (doc, filename, folder_year, text) of all clean texts and all documents."""
    c = table(spark, d, "clean_text").select(F.concat(F.lit("c"), F.col("text_id").cast("string")).alias("doc"), F.regexp_extract("clean_text_path", "[^/]*$", 0).alias("filename"), "folder_year", F.col("clean_text").alias("text"))
    p = documents_from_pages(table(spark, d, "pages_in")).select(F.concat(F.lit("p/"), "file_path").alias("doc"), "filename", "folder_year", "text")
    return c.unionByName(p)


_STRIPPED = lambda c: f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_BLANKS = r"E' \n\t\r'"
PAGE_TEXT = rf"""(SELECT *, CASE WHEN length(trim(d, {_BLANKS})) < 100 AND length(trim(o, {_BLANKS})) > length(trim(d, {_BLANKS})) THEN o ELSE d END page_text, (length(trim(d, {_BLANKS})) < 100 AND length(trim(o, {_BLANKS})) > length(trim(d, {_BLANKS})))::INT by_ocr
 FROM (SELECT *, coalesce(digital_text, '') d, coalesce(ocr_text, '') o FROM pages_in))"""
DOCUMENTS = f"""(WITH p AS (SELECT file_path, page_index, min(page_text) page_text, min(by_ocr) by_ocr, min(folder_year) folder_year, min(filename) filename FROM {PAGE_TEXT} GROUP BY file_path, page_index),
 h AS (SELECT file_path, min(lower(trim(file_hash))) file_hash FROM ordinances_eda_summary_all WHERE trim(file_hash) <> '' GROUP BY file_path),
 f AS (SELECT file_path, min(folder_year) folder_year, min(filename) filename, string_agg(page_text, chr(10) ORDER BY page_index) "text", count(*)::INT page_count, sum(by_ocr)::INT ocr_page_count FROM p GROUP BY file_path)
SELECT folder_year, filename, f.file_path, "text", CASE WHEN ocr_page_count = 0 THEN 'Digital' WHEN ocr_page_count = page_count THEN 'OCR' ELSE 'Hybrid' END AS extraction_method, page_count, ocr_page_count, file_hash FROM f LEFT JOIN h USING (file_path))"""
TEXTS = f"""(SELECT 'c' || text_id doc, regexp_extract(clean_text_path, '[^/]*$') filename, folder_year, coalesce(clean_text, '') t FROM clean_text UNION ALL SELECT 'p/' || file_path, filename, folder_year, coalesce("text", '') FROM {DOCUMENTS})"""


def places(source: str, pattern: str, column: str = "t") -> str:
    """Rows (doc, t, k, hit, st, en): every match in ``source``, with its place."""
    p = re2(pattern)
    return f"""(SELECT doc, t, k, hit, (en - length(hit))::INT st, en::INT en FROM (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc ORDER BY k) en FROM
 (SELECT doc, t, unnest(h) hit, unnest(g[1:len(h)]) gap, generate_subscripts(h, 1) k FROM (SELECT doc, {column} t, regexp_extract_all({column}, {p}) h, regexp_split_to_array({column}, {p}) g FROM {source}) WHERE len(h) > 0)))"""


def _before(n: int) -> str:
    return f"substring(t, greatest(st - {n}, 0) + 1, st - greatest(st - {n}, 0))"


_CITED = f"(regexp_matches(pre, {re2(X.INSTRUMENT)}) AND (regexp_matches(pre, {re2(X.CITATION_CUE)}) OR regexp_matches(pre, {re2(X.RECITED_ACT)})))"


def own_places(source: str, pattern: str) -> str:
    """The matches that stand in no reference to another instrument, with the text that follows them."""
    return f"(SELECT *, substring(t, en + 1, {X.DATE_WINDOW}) seg FROM (SELECT *, {_before(X.LOOK_BACK)} pre FROM {places(source, pattern)}) WHERE NOT {_CITED})"


def _plausible(c: str) -> str:
    return f"CASE WHEN try_cast({c} AS INT) BETWEEN 1900 AND 2035 THEN try_cast({c} AS INT) END"


def year_near(seg: str, bare: bool = True) -> str:
    found = [(_plausible(f"regexp_extract({seg}, {re2(p)}, {g})"), "full_date") for p, g in ((X.MONTH_FIRST, 2), (X.DAY_FIRST, 2), (X.NUMERIC_DATE, 1))]
    if bare:
        found.append((_plausible(f"regexp_extract(substring({seg}, 1, {X.DATE_WINDOW // 2}), {re2(X.BARE_YEAR)}, 1)"), "bare_year"))
    return "coalesce(" + ", ".join(f"CASE WHEN {y} IS NOT NULL THEN {{'year': {y}, 'kind': '{k}'}} END" for y, k in found) + ")"


#: A match's group, or null where nothing matches.
def _group(text: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({text}, {re2(pattern)}, {group}), '')"


def _suffix(c: str) -> str:
    return f"(CASE WHEN length({c}) = 4 AND {c}::INT BETWEEN 1900 AND 2035 THEN {c}::INT WHEN length({c}) = 2 THEN CASE WHEN {c}::INT <= 35 THEN 2000 + {c}::INT ELSE 1900 + {c}::INT END END)::INT"


_STEM = r"regexp_replace(filename, '(.)\.[^.]*$', '\1')"
HEADS = f"(SELECT doc, substring(t, 1, {X.HEADER_CHARS}) t FROM texts)"
WITH = f"WITH texts AS MATERIALIZED {TEXTS}"
NAME_NUMBER = f"SELECT doc, a || '-' || b AS number, {_suffix('b')} AS year FROM (SELECT doc, {_group(_STEM, X.FILENAME_NUMBER, 1)} a, {_group(_STEM, X.FILENAME_NUMBER, 2)} b FROM texts)"
HEAD_NUMBER = f"""SELECT doc, a || '-' || b AS number, {_suffix('b')} AS year, rejected FROM (SELECT doc, {_group('hit', X.HEADER_NUMBER, 1)} a, {_group('hit', X.HEADER_NUMBER, 2)} b, coalesce(rejected, 0)::INT rejected FROM texts LEFT JOIN
 (SELECT doc, arg_min(hit, k) FILTER (NOT cited) hit, coalesce(min(k) FILTER (NOT cited) - 1, count(*)) rejected FROM (SELECT doc, k, hit, regexp_matches({_before(X.NUMBER_LOOK_BACK)}, {re2(X.CITATION_CUE)}) cited FROM {places(HEADS, X.HEADER_NUMBER)}) GROUP BY doc) USING (doc))"""
SERIES = f"SELECT doc, {_plausible('right(hit, 4)')} AS series_year FROM texts LEFT JOIN (SELECT doc, arg_min(hit, k) hit FROM {places(HEADS, X.SERIES)} WHERE NOT regexp_matches({_before(X.LOOK_BACK)}, {re2(X.CITATION_CUE)}) GROUP BY doc) USING (doc)"
COUNCIL = f"SELECT doc, CASE WHEN n > 0 AND 2016 + (n - 18) * 3 BETWEEN 1900 AND 2035 THEN 2016 + (n - 18) * 3 END::INT AS council_year FROM (SELECT doc, try_cast({_group('t', X.COUNCIL, 1)} AS INT) n FROM {HEADS})"
_NONE = "{'year': NULL::INT, 'kind': 'none'}"
ENACTMENT = f"SELECT doc, (coalesce(y, {_NONE})).year AS year, (coalesce(y, {_NONE})).kind AS kind FROM texts LEFT JOIN (SELECT doc, arg_min(y, k) y FROM (SELECT doc, k, {year_near('seg')} y FROM {own_places('texts', X.ENACTED)}) WHERE y IS NOT NULL GROUP BY doc) USING (doc)"
_AROUND = f"substring(t, greatest(st - {X.DATE_WINDOW}, 0) + 1, {2 * X.DATE_WINDOW})"
APPROVAL = f"""SELECT doc, (coalesce(y, z, {_NONE})).year AS year, (coalesce(y, z, {_NONE})).kind AS kind FROM texts LEFT JOIN (SELECT doc, arg_max(y, k) y FROM (SELECT doc, k, {year_near('seg')} y FROM {own_places('texts', X.APPROVED)}) WHERE y IS NOT NULL GROUP BY doc) USING (doc)
 LEFT JOIN (SELECT doc, arg_max(z, k) z FROM (SELECT doc, k, {year_near('around', bare=False)} z FROM (SELECT doc, k, {_AROUND} around FROM {places('texts', X.SIGNATURE)})) WHERE z IS NOT NULL GROUP BY doc) USING (doc)"""
_MONTHS = "CASE lower(m) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.MONTHS.items()) + " END"
#: Of a match its month, the first number that can be a day, and its year.
_PARTS = lambda p: f"(SELECT doc, k, {_MONTHS} m, list_filter(list_transform(regexp_extract_all(hit, '\\d{{1,4}}'), lambda x: CASE WHEN length(x) <= 2 THEN x::INT END), lambda x: x BETWEEN 1 AND 31)[1] d, {_plausible('y')} y FROM (SELECT doc, k, hit, regexp_extract(hit, {re2(X.MONTH)}) m, regexp_extract(hit, {re2(p)}, 2) y FROM (SELECT doc, k, regexp_extract(seg, {re2(p)}) hit FROM places)) WHERE hit <> '')"  # noqa: E731, ISC003


def iso_dates(pattern: str, pick: str) -> str:
    """The ISO date after the ``pick`` (arg_min or arg_max) of the places that has one, per document; null where it is no date of the calendar."""
    return f"""(WITH places AS (SELECT doc, k, seg FROM {own_places('texts', pattern)}), one AS {_PARTS(X.MONTH_FIRST)}, two AS {_PARTS(X.DAY_FIRST)},
 parts AS (SELECT p.doc, p.k, coalesce(CASE WHEN o.m IS NOT NULL AND o.d IS NOT NULL AND o.y IS NOT NULL THEN printf('%04d-%02d-%02d', o.y, o.m, o.d) END, CASE WHEN t.m IS NOT NULL AND t.d IS NOT NULL AND t.y IS NOT NULL THEN printf('%04d-%02d-%02d', t.y, t.m, t.d) END) iso FROM places p LEFT JOIN one o USING (doc, k) LEFT JOIN two t USING (doc, k))
 SELECT doc, {pick}(iso, k) iso FROM parts WHERE try_cast(iso AS DATE) IS NOT NULL GROUP BY doc)"""


FULL_DATES = f"SELECT doc, e.iso AS enactment_date, a.iso AS approval_date FROM texts LEFT JOIN {iso_dates(X.ENACTED, 'arg_min')} e USING (doc) LEFT JOIN {iso_dates(X.APPROVED, 'arg_max')} a USING (doc)"
_T = f"regexp_extract(t, {re2(r'(AN?\s+ORDINANCE\b[\s\S]{0,900}?)(?:\n\s*\n|\bBE\s+IT\s+ORDAINED\b|\bWHEREAS\b|\bSECTION\s+1\b)')}, 1)"
_T = _STRIPPED(f"regexp_replace(replace({_T}, chr(10), ' '), '[ \\t\\x{{a0}}]{{2,}}', ' ', 'g')")
TITLES = f"SELECT doc, substring(regexp_replace({_T}, {re2(r'\s*[.,;]\s*$')}, ''), 1, 400) AS title FROM texts"
_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def keyword_list(c: str) -> str:
    words = f"list_filter(regexp_extract_all(lower(regexp_replace({c}, {re2(X.TITLE_NOISE)}, '', 'g')), '[a-z]{{4,}}'), lambda x: NOT list_contains([{_STOPS}], x))"
    return f"list_filter({words}, lambda x, i: list_position({words}, x) = i)[1:6]"


_NAMED = f"list_transform(list_zip(regexp_extract_all(t, {re2(X.HEADER_NUMBER)}, 1), regexp_extract_all(t, {re2(X.HEADER_NUMBER)}, 2)), lambda x: x[1] || '-' || x[2])"
CITED = f"SELECT doc, list_filter(l, lambda x, i: list_position(l, x) = i) cited FROM (SELECT doc, list_filter({_NAMED}, lambda x: x IS DISTINCT FROM number) l FROM texts LEFT JOIN own USING (doc))"
_PLAIN_NAME = r"([A-Z][A-Za-z.\-]+(?:\s+[A-Z][A-Za-z.\-]+){1,4})\s*\n\s*"
_SAID = lambda t, p, g=1: _STRIPPED(f"coalesce(regexp_extract({t}, {re2(p)}, {g}), '')")
_HEAD = f"substring(t, 1, {X.HEADER_CHARS})"
PEOPLE = f"""SELECT doc, try_cast({_group(_HEAD, X.COUNCIL, 1)} AS INT) AS council_term, {_SAID(_HEAD, X.SESSION, 0)} AS session_label, {_SAID('t', X.SPONSOR)} AS sponsor,
 {_SAID('t', _PLAIN_NAME + X.MAYOR_OFFICE)} AS approving_mayor, {_SAID('t', _PLAIN_NAME + X.PRESIDING_OFFICE)} AS presiding_officer FROM texts"""


def _repaired(c: str) -> str:
    """Compatible characters (the ligatures are the only ones of them that these texts have), plain quotes and dashes, words put right."""
    for seen, right in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = f"replace({c}, '{seen}', '{right}')"
    c = f"translate({c}, '‘’“”–—', chr(39) || chr(39) || '\"\"--')"
    for seen, right in X.OCR_REPAIRS:
        c = f"regexp_replace({c}, {re2(seen)}, '{right}', 'g')"
    return c


_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
_HYPHEN = re2(X.HYPHEN_BREAK.replace(r"\w", _W), "")
_MASTHEADS = ", ".join(f"'{m}'" for m in X.MASTHEADS)
_KIND = f"CASE WHEN y = '' THEN 'kept' WHEN regexp_matches(y, {re2(X.PAGE_FURNITURE)}) OR regexp_replace(lower(y), '^[.,:;\\-]+|[.,:;\\-]+$', '', 'g') IN ({_MASTHEADS}) THEN 'dropped' WHEN regexp_matches(y, {re2(X.NOISE_LINE, '')}) THEN 'noise' ELSE 'kept' END"
_LINE_ENDS = r"'\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'"
_OUT = _STRIPPED("regexp_replace(array_to_string(list_transform(list_filter(l, lambda x: x.k = 'kept'), lambda x: regexp_replace(x.y, '[ \\t\\x{a0}]{2,}', ' ', 'g')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")
_WORDS_IN = lambda c: f"len(regexp_extract_all({c}, '[^{SPACE}]+'))"
CLEANED = f"""SELECT doc, clean, length(clean)::INT AS clean_char_count, {_WORDS_IN('clean')}::INT AS clean_word_count, (length(t) - length(clean))::INT AS removed_chars, len(list_filter(l, lambda x: x.k <> 'kept'))::INT AS dropped_lines, rejoined::INT AS rejoined_words, round(len(list_filter(l, lambda x: x.k = 'noise')) / greatest(1, len(l))::DOUBLE, 4) AS noise_line_ratio
 FROM (SELECT *, {_OUT} clean FROM (SELECT doc, t, rejoined, list_transform(list_transform(CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END, lambda y: {_STRIPPED('y')}), lambda y: {{'y': y, 'k': {_KIND}}}) l
 FROM (SELECT doc, t, len(regexp_extract_all(r, {_HYPHEN})) rejoined, regexp_split_to_array(regexp_replace(r, {_HYPHEN}, '\\1\\2', 'g'), {_LINE_ENDS}) l FROM (SELECT doc, t, {_repaired('t')} r FROM texts))))"""

_GIVES = [("enacted", 0.45), ("numbered", 0.25), ("series", 0.2), ("approved", 0.1)]
_SUM = lambda test: "(" + " + ".join(f"CASE WHEN {test.format(c)} THEN {w}::DOUBLE ELSE 0 END" for c, w in _GIVES) + ")"
_COUNT = lambda test: "(" + " + ".join(f"coalesce(({test.format(c)})::INT, 0)" for c, _ in _GIVES) + ")"
#: Everything that the vote needs of each text, the vote and the status, as CTEs that end with ``judged``.
VOTE = f"""n AS ({NAME_NUMBER}), h AS ({HEAD_NUMBER}), e AS ({ENACTMENT}), a AS ({APPROVAL}), s AS ({SERIES}), c AS ({COUNCIL}),
 g AS (SELECT doc, folder_year, length({_STRIPPED('t')}) >= {X.TEXT_CHARS} has_text, coalesce(n.number, h.number) number, coalesce(n.number = h.number, false) numbers_match, h.rejected, CASE WHEN n.number IS NOT NULL THEN 'filename' WHEN h.number IS NOT NULL THEN 'header' ELSE 'none' END number_source, coalesce(n.year, h.year) numbered, e.year enacted, e.kind enacted_kind, a.year approved, a.kind approved_kind, series_year series, council_year
  FROM texts JOIN n USING (doc) JOIN h USING (doc) JOIN e USING (doc) JOIN a USING (doc) JOIN s USING (doc) JOIN c USING (doc)),
 v AS (SELECT doc, unnest([enacted, numbered, series, approved]) y, unnest([0.45::DOUBLE, 0.25::DOUBLE, 0.2::DOUBLE, 0.1::DOUBLE]) w, unnest([0, 1, 2, 3]) p FROM g),
 b AS (SELECT doc, y FROM (SELECT doc, y, sum(w) s, min(p) p FROM v WHERE y IS NOT NULL GROUP BY doc, y) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY round(s, 6) DESC, p) = 1),
 r AS (SELECT g.*, coalesce(b.y, council_year) r FROM g LEFT JOIN b USING (doc)),
 w AS (SELECT *, greatest(0, least(1, {_SUM('{} = r')} - 0.5 * {_SUM('{} <> r')})) raw, {_COUNT('{} = r')}::INT agree, {_COUNT('{} IS NOT NULL')}::INT given, coalesce(r <> folder_year, false) mismatch, coalesce(r NOT BETWEEN 2016 AND 2024, false) outside FROM r),
 judged AS (SELECT *, CASE WHEN abs(raw - 0.625) < 1e-9 THEN 0.62 WHEN abs(raw - 0.175) < 1e-9 THEN 0.17 ELSE round(raw, 2) END::DOUBLE confidence,
  CASE WHEN NOT has_text OR r IS NULL THEN 'unresolved' WHEN mismatch AND raw >= 0.45 AND (agree >= 2 OR coalesce(enacted = r, false)) THEN CASE WHEN outside THEN 'out_of_scope' ELSE 'misfiled' END WHEN mismatch THEN 'review' WHEN outside THEN 'out_of_scope' ELSE 'valid' END status,
  concat_ws('; ', CASE WHEN enacted <> approved THEN printf('enacted %d vs approved %d', enacted, approved) END, CASE WHEN series <> numbered THEN printf('series %d vs ord-no %d', series, numbered) END, CASE WHEN number_source = 'header' THEN 'number read from header, filename unparsed' END, CASE WHEN NOT has_text THEN 'no extractable text; filename-only inference' END) notes FROM w)"""
CONSENSUS = f"{WITH}, {VOTE} SELECT doc, number AS ordinance_number, r AS resolved_year, confidence AS confidence_score, agree AS agreeing_signals, given AS available_signals, status AS temporal_status, notes AS conflict_notes FROM judged"
RECORDS = f"""WITH docs AS MATERIALIZED {DOCUMENTS}, texts AS MATERIALIZED (SELECT file_path doc, filename, folder_year, coalesce("text", '') t FROM docs), {VOTE}, own AS (SELECT doc, number FROM g), ti AS ({TITLES}), ci AS ({CITED}), pe AS ({PEOPLE}), cl AS ({CLEANED}), fd AS ({FULL_DATES})
SELECT docs.filename, file_path, file_hash, docs.folder_year, extraction_method, page_count, ocr_page_count, number AS ordinance_number, number_source AS ordinance_number_source, numbers_match AS filename_header_number_match, rejected AS citation_candidates_rejected, series AS detected_series_year, numbered AS detected_ordinance_no_year, enacted AS detected_enactment_year, approved AS detected_approval_year, enacted_kind AS enactment_date_kind, approved_kind AS approval_date_kind, council_year AS council_term_year,
 r AS resolved_year, confidence AS confidence_score, agree AS agreeing_signals, given AS available_signals, status AS temporal_status, status IN ('misfiled', 'out_of_scope') AND mismatch AS is_misfiled, outside AS is_out_of_scope, status IN ('review', 'unresolved') AS needs_review, notes AS conflict_notes, length(t)::INT AS char_count, {_WORDS_IN('t')}::INT AS word_count, CASE WHEN page_count > 0 THEN round(length(t) / page_count::DOUBLE, 1) ELSE 0 END AS chars_per_page, length({_STRIPPED('t')}) < {X.SPARSE_CHARS} AS is_sparse, 'consensus' AS resolution_source, false AS manually_verified,
 clean_char_count, clean_word_count, removed_chars, dropped_lines, rejoined_words, noise_line_ratio, title, array_to_string(cited[1:12], '; ') AS cited_ordinances, len(cited)::INT AS cited_ordinance_count, regexp_matches(title, {re2(X.AMENDATORY)}) AS is_amendatory, council_term, session_label, sponsor, approving_mayor, presiding_officer, len(regexp_extract_all(clean, {re2(X.SECTION.replace('(?m)', ''), '(?im)')}))::INT AS section_count, len(regexp_extract_all(clean, {re2(X.WHEREAS)}))::INT AS whereas_count, array_to_string({keyword_list('title')}, '; ') AS subject_keywords, enactment_date, approval_date, '' AS clean_text_path
FROM docs JOIN texts ON doc = file_path JOIN judged USING (doc) JOIN ti USING (doc) JOIN ci USING (doc) JOIN pe USING (doc) JOIN cl USING (doc) JOIN fd USING (doc)"""


def _t(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def add_to(query: Callable) -> None:
    """Registers the queries with their SQL."""

    @query(f"{WITH} {HEAD_NUMBER}")
    def header_number_rejected(spark: SparkSession, d: str) -> DataFrame:
        return texts(spark, d).select("doc", S.header_number(_t("text")).alias("h")).select("doc", "h.number", "h.year", "h.rejected")

    @query(f"{WITH} {SERIES}")
    def series_year(spark: SparkSession, d: str) -> DataFrame:
        return texts(spark, d).select("doc", S.series_year(_t("text")).alias("series_year"))

    @query(f"{WITH} {COUNCIL}")
    def council_year(spark: SparkSession, d: str) -> DataFrame:
        return texts(spark, d).select("doc", S.council_year(_t("text")).alias("council_year"))

    @query(f"{WITH} {ENACTMENT}")
    def enactment_year(spark: SparkSession, d: str) -> DataFrame:
        return texts(spark, d).select("doc", S.enactment(_t("text")).alias("e")).select("doc", "e.year", "e.kind")

    @query(f"{WITH} {APPROVAL}")
    def approval_year(spark: SparkSession, d: str) -> DataFrame:
        return texts(spark, d).select("doc", S.approval(_t("text")).alias("a")).select("doc", "a.year", "a.kind")

    @query(f"{WITH} {FULL_DATES}")
    def full_dates(spark: SparkSession, d: str) -> DataFrame:
        e, a = S.full_dates(_t("text"))
        return texts(spark, d).select("doc", e.alias("enactment_date"), a.alias("approval_date"))

    @query(f"{WITH} SELECT doc, st, en, {_CITED} AS cited FROM (SELECT *, {_before(X.LOOK_BACK)} pre FROM {places('texts', X.ENACTED + '|' + X.APPROVED)})")
    def anchor_places(spark: SparkSession, d: str) -> DataFrame:
        t = texts(spark, d).withColumn("text", _t("text"))
        t = t.select("doc", "text", F.explode(anchors(F.col("text"), X.ENACTED + "|" + X.APPROVED)).alias("a"))
        return t.select("doc", "a.st", "a.en", S.is_cited(F.col("text"), F.col("a.st")).alias("cited"))

    @query(CONSENSUS)
    def consensus(spark: SparkSession, d: str) -> DataFrame:
        s = texts(spark, d).withColumn("text", _t("text")).withColumn("s", S.year_signals(F.col("text"), F.col("filename")))
        s = s.withColumn("r", resolve(F.col("s"), F.col("folder_year"), F.length(strip(F.col("text"))) >= X.TEXT_CHARS))
        return s.select("doc", "s.ordinance_number", "r.resolved_year", "r.confidence_score", "r.agreeing_signals", "r.available_signals", "r.temporal_status", "r.conflict_notes")

    @query(f"{WITH} {TITLES}", "title")
    def title_(spark: SparkSession, d: str) -> DataFrame:
        return texts(spark, d).select("doc", title(_t("text")).alias("title"))

    @query(f"{WITH}, own AS (SELECT doc, number FROM ({NAME_NUMBER})) {CITED}")
    def citations(spark: SparkSession, d: str) -> DataFrame:
        number, _ = S.filename_number(F.col("filename"))
        return texts(spark, d).select("doc", cited_numbers(_t("text"), number).alias("cited"))

    @query(f"{WITH} {PEOPLE}")
    def people_and_sessions(spark: SparkSession, d: str) -> DataFrame:
        t = texts(spark, d).select("doc", metadata(F.col("text"), F.lit(""), F.lit("")).alias("m"))
        return t.select("doc", "m.council_term", "m.session_label", "m.sponsor", "m.approving_mayor", "m.presiding_officer")

    @query(f"{WITH} SELECT * EXCLUDE (clean), sha256(clean) AS clean_hash FROM ({CLEANED})")
    def clean_stats(spark: SparkSession, d: str) -> DataFrame:
        c = texts(spark, d).select("doc", clean(F.col("text")).alias("c")).select("doc", "c.*")
        return c.withColumn("clean_hash", F.sha2("clean", 256)).drop("clean")
