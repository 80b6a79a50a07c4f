"""A vault of linked notes: one per record, an index per corpus year and a map of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions.signals import stem
from statutor.functions.text import quoted, slug, year_or_dash
from statutor.operators.report import corpus_year_counts, crosstab
from statutor.sources.tables import ranked

BODY_CHARS = 12_000


def note_stem() -> Column:
    """The note's name: the ordinance number, or the file's name where there is none, or "untitled" where there is neither."""
    return F.when(F.coalesce("ordinance_number", F.lit("")) != "", F.concat(F.lit(X.NUMBERED), F.col("ordinance_number"))).otherwise(F.coalesce(F.nullif(stem(F.col("filename")), F.lit("")), F.lit("untitled")))


def note_year() -> Column:
    return F.coalesce(F.coalesce("corpus_year", "folder_year").cast("string"), F.lit("undated"))


def named(df: DataFrame, order: str = "scan_seq") -> DataFrame:
    """Adds ``note``: the note's own name within its year.

    Of records with the same name the last by ``order`` keeps it and the others get a suffix, so no note is overwritten and
    every one can be linked. Only names are shuffled for the last, never the texts.
    """
    d = df.withColumns({"_year": note_year(), "_stem": note_stem()})
    last = d.groupBy(F.col("_year").alias("_y"), F.col("_stem").alias("_s")).agg(F.max(order).alias("_last"))
    d = d.join(last, (F.col("_year") == F.col("_y")) & (F.col("_stem") == F.col("_s")))
    note = F.when(F.col(order).eqNullSafe(F.col("_last")), F.col("_stem")).otherwise(F.concat("_stem", F.lit(" ("), F.coalesce(F.col(order).cast("string"), F.lit("-")), F.lit(")")))
    return d.withColumn("note", note).drop("_year", "_stem", "_y", "_s", "_last")


def listed(c: str) -> Column:
    """The items of a list that is written with semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def tags() -> Column:
    year = F.coalesce("corpus_year", "resolved_year")
    fixed = [*map(F.lit, X.NOTE_TAGS), F.concat(F.lit("year/"), year), F.concat(F.lit("status/"), F.coalesce("temporal_status", F.lit("unknown"))), F.when(F.col("is_amendatory"), F.lit("type/amendatory")), F.when(F.col("manually_verified"), F.lit("verified/manual"))]
    return F.array_distinct(F.concat(F.array_compact(F.array(*fixed)), F.transform(listed("subject_keywords"), lambda k: F.concat(F.lit("topic/"), slug(k)))))


def front_matter() -> list[tuple[str, Column]]:
    """The note's properties in order, as YAML scalars."""
    number = F.coalesce("ordinance_number", F.lit(""))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(quoted(F.col(c)))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(note_stem())
    return [
        ("title", quoted(title)), ("ordinance_number", quoted(number)), ("corpus_year", plain("corpus_year")), ("folder_year", plain("folder_year")), ("resolved_year", plain("resolved_year")),
        ("enactment_date", text("enactment_date")), ("approval_date", text("approval_date")), ("series_year", plain("detected_series_year")), ("council_term", plain("council_term")),
        ("session", text("session_label")), ("sponsor", text("sponsor")), ("approving_mayor", text("approving_mayor")), ("presiding_officer", text("presiding_officer")),
        ("temporal_status", text("temporal_status")), ("confidence_score", plain("confidence_score")), ("resolution_source", text("resolution_source")), ("manually_verified", plain("manually_verified")),
        ("included_in_corpus", plain("included_in_corpus")), ("extraction_method", text("extraction_method")), ("page_count", plain("page_count")), ("word_count", plain("clean_word_count")),
        ("section_count", plain("section_count")), ("whereas_count", plain("whereas_count")), ("source_pdf", text("file_path")), ("sha256", quoted(F.substring(F.coalesce("file_hash", F.lit("")), 1, 16))),
        ("indexed", F.date_format(F.current_date(), "yyyy-MM-dd")),
    ]


def notes(df: DataFrame, include_text: bool = True, body_chars: int = BODY_CHARS, order: str = "scan_seq") -> DataFrame:
    """Rows (path, content), a note for each record; ``clean_text`` is the body, if the column is there.

    Notes are named first (``named``) and written after, so that no text of a note is shuffled for its name.
    """
    number = F.coalesce("ordinance_number", F.lit(""))
    has_number = number != ""
    head = [F.lit("---")]
    for k, v in front_matter():
        head.append(F.concat(F.lit(f"{k}: "), v))
        if k == "ordinance_number":
            head.append(F.when(has_number, F.concat(F.lit("aliases: ["), quoted(F.concat(F.lit(X.NUMBERED), number)), F.lit(", "), quoted(number), F.lit("]"))))
    head += [F.concat(F.lit("tags: ["), F.array_join(tags(), ", "), F.lit("]")), F.lit("---"), F.lit(""), F.concat(F.lit("# "), note_stem()), F.lit("")]
    title = F.coalesce("title", F.lit(""))
    head.append(F.when(title != "", F.concat(F.lit("> "), title, F.lit("\n"))))
    kind = F.when(F.col("temporal_status").isin("misfiled", "out_of_scope"), "warning").otherwise("question")
    why = F.when(F.coalesce("conflict_notes", F.lit("")) == "", X.NO_CONFLICT).otherwise(F.col("conflict_notes"))
    said = (kind, F.col("temporal_status"), F.col("folder_year").cast("string"), year_or_dash(F.col("resolved_year")), F.format_string("%.2f", F.coalesce("confidence_score", F.lit(0.0))), why)
    call = F.concat(*(x for fixed, own in zip(X.CALLOUT, said, strict=True) for x in (F.lit(fixed), own)), F.lit("\n"))
    head.append(F.when(F.col("temporal_status") != "valid", call))
    head += [F.lit(X.SIGNAL_TABLE), *(F.concat(F.lit(f"| {k} | "), year_or_dash(F.col(c)), F.lit(" |")) for k, c in X.SIGNAL_ROWS), F.concat(F.lit("| **Resolved** | **"), year_or_dash(F.col("resolved_year")), F.lit("** |\n"))]
    cited = listed("cited_ordinances")
    head.append(F.when(F.size(cited) > 0, F.concat(F.lit(X.CITES), F.array_join(F.transform(cited, lambda c: F.concat(F.lit(f"- [[{X.NUMBERED}"), c, F.lit("]]"))), "\n"), F.lit("\n"))))
    head.append(F.concat(F.lit(X.CONTEXT[0]), note_year(), F.lit(X.CONTEXT[1])))
    if include_text and "clean_text" in df.columns:
        body = F.coalesce("clean_text", F.lit(""))
        lead, of, full, end = X.TRUNCATED
        cut_off = F.when(F.length(body) > body_chars, F.concat(F.lit(f"{lead}{body_chars:,}{of}"), F.format_number(F.length(body), 0), F.lit(full), F.coalesce("clean_text_path", F.lit("")), F.lit(end))).otherwise("")
        head.append(F.when(body != "", F.concat(F.lit(X.CLEANED), cut_off, F.substring(body, 1, body_chars), F.lit("\n"))))
    own = df if "note" in df.columns else named(df, order)
    return own.select(F.concat(note_year(), F.lit("/"), "note", F.lit(".md")).alias("path"), F.array_join(F.array_compact(F.array(*head)), "\n").alias("content"))


def index_rows(df: DataFrame, order: str = "scan_seq") -> DataFrame:
    """The lines of the year indices: one per record, with its corpus year and its note's own name."""
    own = df if "note" in df.columns else named(df, order)
    line = (F.coalesce("corpus_year", "folder_year").alias("year"), "note", F.substring(F.coalesce("title", F.lit("")), 1, 80).alias("title"), "temporal_status", F.format_string("%.2f", F.coalesce("confidence_score", F.lit(0.0))).alias("confidence"), F.coalesce(F.nullif("enactment_date", F.lit("")), F.lit("-")).alias("enacted"), "filename")
    return own.select(*line)


def year_indices(df: DataFrame, order: str = "scan_seq", size: int = 10_000) -> DataFrame:
    """Rows (path, part, content): each year's index in parts that follow one another, its documents sorted by file name.

    Part -1 holds the head, the next ones ``size`` documents each in order, and the last one the foot, so that a year of any
    size is one ordered file when its parts are written out by number and no task holds a whole year.
    """
    year = F.coalesce(F.col("year").cast("string"), F.lit("undated"))
    path = F.concat(year, F.lit("/_Index "), year, F.lit(".md")).alias("path")
    counts = corpus_year_counts(df)
    head = [F.lit("---"), F.concat(F.lit('title: "Ordinance index '), year, F.lit('"')), F.concat(F.lit("corpus_year: "), year), F.concat(F.lit("document_count: "), F.col("total")), F.concat(F.lit("tags: [index, ordinance, davao, year/"), year, F.lit("]")), F.lit("---"), F.lit(""), F.concat(F.lit("# Ordinance index "), year), F.lit("")]
    head += [F.concat(F.col("total"), F.lit(" document(s) indexed under corpus year "), year, F.lit(".")), F.lit(""), *map(F.lit, X.INDEX_COUNTS), *(F.concat(F.lit(f"| {s} | "), F.col(s), F.lit(" |")) for s in X.STATUSES), F.lit(""), *map(F.lit, X.INDEX_DOCUMENTS)]
    foot = "\n".join(["", *X.INDEX_QUERY, "", X.BACK_LINK, ""])
    heads = counts.select(path, F.lit(-1).alias("part"), F.array_join(F.array(*head), "\n").alias("content"))
    feet = counts.select(path, F.expr(f"int((total + {size - 1}) div {size})").alias("part"), F.lit(foot).alias("content"))
    row = F.concat(F.lit("| [["), F.col("note"), F.lit("]] | "), F.col("title"), F.lit(" | "), F.coalesce("temporal_status", F.lit("None")), F.lit(" | "), F.col("confidence"), F.lit(" | "), F.col("enacted"), F.lit(" |"))
    rows = ranked(index_rows(df, order).select("year", "filename", row.alias("row")), ["year"], ["filename", "row"]).withColumn("part", F.expr(f"int(place div {size})"))
    parts = rows.groupBy("year", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]), "\n").alias("content"))
    return heads.unionByName(parts.select(path, "part", "content")).unionByName(feet)


def corpus_map(df: DataFrame) -> DataFrame:
    """The overview's table: statuses by folder year with total and link."""
    return crosstab(df).drop("mean_confidence").withColumn("link", F.concat(F.lit("[[_Index "), F.col("folder_year"), F.lit("]]")))


def citation_edges(df: DataFrame, key: str = "scan_seq") -> DataFrame:
    """Rows (key, source_number, cited, resolved): each citation, and whether a record of that number is there."""
    edges = df.select(key, F.col("ordinance_number").alias("source_number"), F.explode(F.array_distinct(listed("cited_ordinances"))).alias("cited"))
    known = df.filter("ordinance_number IS NOT NULL").select(F.col("ordinance_number").alias("_number")).distinct()
    return edges.join(known, edges["cited"] == known["_number"], "left").select(key, "source_number", "cited", F.col("_number").isNotNull().alias("resolved"))
