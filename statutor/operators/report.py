"""The report's tables as aggregates, and their rendering as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions.text import percent, year_or_dash
from statutor.operators.duplicates import group_totals, listing

SIGNALS = {"Enactment date": "detected_enactment_year", "Ordinance number": "detected_ordinance_no_year", "Series header": "detected_series_year", "Approval date": "detected_approval_year"}


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(False)).cast("int")), F.lit(0)).cast("long")


def over_domain(df: DataFrame, column: str, domain: tuple[str, ...], name: str = "n") -> DataFrame:
    """Counts of a fixed set of values, 0 where there are none, with their share of all rows, in one pass.

    The values are unpivoted from one row of counts, so the result has every value even for an empty table.
    """
    one = df.agg(F.count("*").alias("all"), *(_n(F.col(column) == v).alias(f"v{i}") for i, v in enumerate(domain)))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(v).alias(column), F.col(f"v{i}").alias(name), percent(F.col(f"v{i}"), F.col("all")).alias("share")) for i, v in enumerate(domain))))
    return one.select(rows.alias("r")).select("r.*")


def status_counts(df: DataFrame) -> DataFrame:
    return over_domain(df, "temporal_status", X.STATUSES)


def method_counts(df: DataFrame) -> DataFrame:
    return over_domain(df, "extraction_method", X.METHODS)


def inventory(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The report's single figures, by ``by`` or in all."""
    out = [
        F.count("*").alias("documents"), F.coalesce(F.sum("ocr_page_count"), F.lit(0)).cast("long").alias("ocr_pages"), F.avg("confidence_score").alias("mean_confidence"),
        F.median("confidence_score").alias("median_confidence"), _n(F.col("agreeing_signals") <= 1).alias("single_signal"),
        _n(F.col("ordinance_number").isNull()).alias("unnumbered"), _n(F.col("ordinance_number_source") == "filename").alias("numbered_by_filename"),
        _n(F.col("filename_header_number_match")).alias("numbers_agree"), F.coalesce(F.sum("citation_candidates_rejected"), F.lit(0)).cast("long").alias("citations_rejected"),
        _n(F.col("manually_verified")).alias("manually_verified"),
    ]
    return df.groupBy(*(by or [])).agg(*out)


def two_levels(df: DataFrame) -> DataFrame:
    """Documents, mean confidence and OCR pages of each folder year and of the corpus (null year), in one aggregation."""
    d = df.groupingSets([["folder_year"], []], "folder_year").agg(F.grouping("folder_year").cast("int").alias("is_corpus"), F.count("*").alias("documents"), F.avg("confidence_score").alias("mean_confidence"), F.coalesce(F.sum("ocr_page_count"), F.lit(0)).cast("long").alias("ocr_pages"))
    return d.select("folder_year", "is_corpus", "documents", "mean_confidence", "ocr_pages")


def signal_coverage(df: DataFrame) -> DataFrame:
    one = df.agg(F.count("*").alias("all"), *(F.count(c).alias(f"v{i}") for i, c in enumerate(SIGNALS.values())))
    cover = lambda i: F.when(F.col("all") > 0, 100.0 * F.col(f"v{i}") / F.col("all")).otherwise(0.0)
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("signal"), F.col(f"v{i}").alias("extracted"), F.col("all").alias("documents"), cover(i).alias("coverage")) for i, k in enumerate(SIGNALS)))).alias("r")).select("r.*")


def parser_health(df: DataFrame) -> DataFrame:
    """Per folder year the coverage of enactment dates, and whether it is too low for figures to be reported."""
    d = df.groupBy("folder_year").agg(F.count("detected_enactment_year").alias("enacted"), F.count("*").alias("documents"))
    return d.withColumn("warning", F.col("enacted") / F.col("documents") < 0.5)


def text_statistics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lengths as whole numbers (cut, not rounded), pages and densities."""
    whole = lambda c: c.cast("long")
    return df.groupBy(*(by or [])).agg(
        whole(F.avg("char_count")).alias("mean_chars"), whole(F.median("char_count")).alias("median_chars"), whole(F.avg("word_count")).alias("mean_words"),
        whole(F.min("char_count")).alias("min_chars"), whole(F.max("char_count")).alias("max_chars"), F.avg("page_count").alias("mean_pages"),
        F.avg("chars_per_page").alias("mean_chars_per_page"), _n(F.col("is_sparse")).alias("sparse"), _n(F.col("chars_per_page") < X.OCR_PAGE_CHARS).alias("low_density"),
    )


def year_histogram(df: DataFrame) -> DataFrame:
    return df.filter("resolved_year IS NOT NULL").groupBy("resolved_year").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, by: Column | None = None, name: str = "folder_year") -> DataFrame:
    """Statuses by year with their total and the mean confidence; conditional sums, so that one pass does."""
    key = (F.col("folder_year") if by is None else by).alias(name)
    return df.groupBy(key).agg(*(_n(F.col("temporal_status") == s).alias(s) for s in X.STATUSES), F.count("*").alias("total"), F.avg("confidence_score").alias("mean_confidence"))


def corpus_year_counts(index: DataFrame) -> DataFrame:
    return crosstab(index, F.coalesce("corpus_year", "folder_year"), "year").drop("mean_confidence")


def duplicate_totals(df: DataFrame) -> DataFrame:
    """Groups and files of equal hashes and of equal numbers, over all years."""
    kinds = {"hash": "file_hash", "number": "ordinance_number"}
    out = None
    for kind, key in kinds.items():
        d = group_totals(df, key).select(F.lit(kind).alias("kind"), "groups", "files")
        out = d if out is None else out.unionByName(d)
    return out


def removal_counts(df: DataFrame) -> DataFrame:
    return df.filter("coalesce(removal_reason, '') != ''").groupBy("removal_reason").agg(F.count("*").alias("n"))


def kept_and_redated(index: DataFrame) -> DataFrame:
    trusted = (F.col("confidence_score") >= X.MISFILE_BAR) & F.col("resolved_year").isNotNull()
    return index.agg(_n(F.col("included_in_corpus")).alias("kept"), _n(trusted & (F.col("resolved_year") != F.col("folder_year"))).alias("redated"), F.countDistinct("folder_year").alias("folder_years"))


def discrepancies(df: DataFrame) -> DataFrame:
    """Records filed wrongly or out of scope, with where they should be."""
    path = F.when(F.col("resolved_year").isNotNull(), F.concat(F.lit("data/raw/"), F.col("resolved_year"), F.lit("/"))).otherwise(X.NO_YEAR_PATH)
    years = {f"{s}_shown": year_or_dash(F.col(c)) for s, c in zip(("enacted", "number", "series", "approved"), SIGNALS.values(), strict=True)}
    d = df.filter(F.col("temporal_status").isin("misfiled", "out_of_scope"))
    return d.select("filename", F.coalesce(F.nullif("ordinance_number", F.lit("")), F.lit("n/a")).alias("number"), "temporal_status", "folder_year", "resolved_year", "confidence_score", F.concat_ws("/", F.col("agreeing_signals").cast("string"), F.col("available_signals").cast("string")).alias("agree"), *(c.alias(k) for k, c in years.items()), path.alias("suggested_path"))


def for_review(df: DataFrame) -> DataFrame:
    """Records that people must look at, with the reason."""
    notes = F.when(F.coalesce("conflict_notes", F.lit("")) != "", F.col("conflict_notes"))
    reason = F.coalesce(notes, F.when(F.col("resolved_year").isNull(), F.lit(X.REASON_NO_YEAR)).otherwise(X.REASON_BELOW_BAR))
    return df.filter(F.col("temporal_status").isin("review", "unresolved")).select("filename", year_or_dash(F.col("resolved_year")).alias("resolved"), "confidence_score", "agreeing_signals", "available_signals", reason.alias("reason"))


def figures(df: DataFrame) -> dict[str, DataFrame]:
    """The data of the figures: statuses, resolved years and signal coverage of a year, and the corpus by folder year."""
    return {"status": status_counts(df), "years": year_histogram(df).orderBy("resolved_year"), "coverage": signal_coverage(df), "corpus": crosstab(df).orderBy("folder_year")}


def _table(head: list[str], rows: list[list[object]]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]


def repeated_numbers(df: DataFrame, order: str = "scan_seq") -> DataFrame:
    """The report's table of repeated numbers: (ordinance_number, n_files, files, resolved_years), further names in further rows."""
    return listing(df, order).orderBy("ordinance_number", "part").select("ordinance_number", "n_files", "files", "resolved_years")


def year_tables(df: DataFrame, year: int) -> dict[str, DataFrame]:
    """The tables of single records in a year's report, whole and in its order."""
    d = df.filter(F.col("folder_year") == year)
    order = "scan_seq" if "scan_seq" in d.columns else "file_path"
    return {"duplicates": repeated_numbers(d, order), "discrepancies": discrepancies(d).orderBy("resolved_year", "filename"), "review": for_review(d).orderBy("filename")}


def render_year(df: DataFrame, year: int, window: tuple[int, int] = X.STUDY_WINDOW, listed: int = 1000) -> str:
    """The Markdown report on one folder year: inventory, duplicates, signals, text, discrepancies and what is left for review.

    A page is for reading: of each of ``year_tables`` it shows the first ``listed`` rows and, where there are more, says so
    and names the table that ``pipeline.write`` puts beside it, which has them all.
    """
    d = df.filter(F.col("folder_year") == year)
    i = inventory(d).first()
    if not i or not i["documents"]:
        return f"# Audit report: {year}\n\nNo documents found."
    t = text_statistics(d).first()
    dup = {r["kind"]: r for r in duplicate_totals(d).collect()}
    cover = signal_coverage(d).orderBy("place").collect()
    tables = year_tables(df, year)
    out = [f"# Audit report: {year}", "", f"Study window {window[0]}-{window[1]}; bar for misfiling {X.MISFILE_BAR:.2f}, for relocation {X.RELOCATE_BAR:.2f}.", "", "## 1. File inventory", ""]
    out += _table(["Classification", "Count", "Share"], [["all documents", i["documents"], "100.0%"], *([r["temporal_status"], r["n"], r["share"]] for r in status_counts(d).orderBy("place").collect())])
    out += _table(["Extraction", "Count", "Share"], [[r["extraction_method"], r["n"], r["share"]] for r in method_counts(d).orderBy("place").collect()])
    mean, median = (f"{i[k]:.2f}" if i[k] is not None else "-" for k in ("mean_confidence", "median_confidence"))
    out += [f"Pages read by OCR: {i['ocr_pages']}. Mean confidence {mean}, median {median}; {i['single_signal']} resolved on a single signal.", "", "## 2. Duplicates", ""]
    out += [f"- equal files: {dup['hash']['groups']} group(s), {dup['hash']['files']} file(s)", f"- equal numbers: {dup['number']['groups']} group(s), {dup['number']['files']} file(s)", f"- without a number: {i['unnumbered']}", ""]
    out += _shown(["Ordinance No.", "Count", "Files", "Resolved years"], tables["duplicates"], listed, f"report_{year}_duplicates")
    out += ["## 3. Signals", "", *_table(["Signal", "Extracted", "Coverage"], [[r["signal"], f"{r['extracted']} / {r['documents']}", f"{r['coverage']:.1f}%"] for r in cover])]
    out += [f"Numbers by file name {i['numbered_by_filename']}, agreeing with the header {i['numbers_agree']}; {i['citations_rejected']} citation(s) rejected.", ""]
    if cover[0]["coverage"] < 50:
        out += ["> Enactment dates are covered too thinly for this year's figures to be reported.", ""]
    out += ["## 4. Text", "", *_table(["Measure", "Value"], [[k.replace("_", " "), f"{t[k]:,.1f}" if isinstance(t[k], float) else f"{t[k]:,}" if t[k] is not None else "-"] for k in t.asDict()])]
    out += ["## 5. Discrepancies", "", *_shown(None, tables["discrepancies"], listed, f"report_{year}_discrepancies"), "### For review", "", *_shown(None, tables["review"], listed, f"report_{year}_review")]
    return "\n".join(out)


def _shown(head: list[str] | None, df: DataFrame, listed: int, whole: str) -> list[str]:
    rows = df.limit(listed + 1).collect()
    more = [f"These are the first {listed} rows; the table {whole} has all.", ""] if len(rows) > listed else []
    return _table(head or df.columns, [list(r) for r in rows[:listed]]) + more if rows else ["None.", ""]


def render_corpus(df: DataFrame) -> str:
    rows = crosstab(df).orderBy("folder_year").collect()
    dup = duplicate_totals(df).collect()
    table = _table(["Folder year", *X.STATUSES, "Total", "Mean conf."], [[r["folder_year"], *(r[s] for s in X.STATUSES), r["total"], f"{r['mean_confidence']:.2f}" if r["mean_confidence"] is not None else "-"] for r in rows])
    return "\n".join(["# Corpus report", "", *table, *(f"- equal {r['kind']}: {r['groups']} group(s), {r['files']} file(s)" for r in dup), ""])
