"""Documents from page tables, text tables and year folders of PDF files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions.text import strip
from statutor.sources.files import exists

#: What the audit takes in.
CONTRACT = "folder_year int, filename string, file_path string, text string, extraction_method string, page_count int, ocr_page_count int, file_hash string"


def scan_folders(spark: SparkSession, root: str, years: Iterable[int] | None = None) -> DataFrame:
    """Rows (file_path, folder_year, filename, file_hash, content) of ``root/<year>/*.pdf``.

    Without ``years`` every folder whose name is all digits is read. A folder that is missing gives no rows.
    """
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    df = df.filter(inside.rlike(r"^\d+$")).select(F.col("path").alias("file_path"), inside.cast("int").alias("folder_year"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("file_hash"), "content")
    return df if years is None else df.filter(F.col("folder_year").isin([int(y) for y in years]))


def folder_years(files: DataFrame) -> DataFrame:
    return files.select("folder_year").distinct().orderBy("folder_year")


Reader = Callable[[bytes], list[str]]
PAGES = "file_path string, folder_year int, filename string, file_hash string, page_index int, digital_text string, ocr_text string, error string"


def read_pages(files: DataFrame, readers: Reader | Sequence[Reader], ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """Rows of ``PAGES``, by readers of PDF bytes and a recogniser of single pages.

    Readers are tried in their order until one doesn't fail. A file that all fail on has one row without a page, with
    what they said in ``error``; the job goes on. ``ocr`` (bytes, page) is asked for pages whose own text is short; where
    it fails or isn't given, ``ocr_text`` is ''.
    """
    order = [readers] if callable(readers) else list(readers)

    def own(content: bytes) -> tuple[list[str], str | None]:
        said = []
        for reader in order:
            try:
                return [p or "" for p in reader(content)], None
            except Exception as e:  # noqa: BLE001
                said.append(f"{type(e).__name__}: {e}")
        return [], "; ".join(said)

    def recognised(content: bytes, index: int, text: str) -> str:
        if ocr is None or len(text.strip()) >= X.OCR_PAGE_CHARS:
            return ""
        try:
            return ocr(content, index) or ""
        except Exception:  # noqa: BLE001
            return ""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for batch in batches:
            for r in batch.itertuples():
                content, head = bytes(r.content), (r.file_path, r.folder_year, r.filename, r.file_hash)
                pages, error = own(content)
                rows = [(*head, i, p, recognised(content, i, p), None) for i, p in enumerate(pages)] or [(*head, None, None, None, error)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")]).astype({"page_index": "Int32"})

    return files.mapInPandas(run, PAGES)


def read_pages_once(files: DataFrame, path: str, readers: Reader | Sequence[Reader], ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """``read_pages`` with a table of pages at ``path`` that is read first: only files whose content it lacks are read and added.

    Pages are kept by the hash of the file's content and whether a recogniser was at hand, so that neither another file
    of the same name nor another switch gets the wrong pages. Each file takes the pages of its content.
    """
    spark, mode = files.sparkSession, F.lit(ocr is not None)
    if exists(spark, path):
        known = spark.read.parquet(path).filter(F.col("with_ocr") == mode)
        new = files.join(known.select("file_hash").distinct(), "file_hash", "left_anti")
    else:
        new = files
    one_each = new.groupBy("file_hash").agg(F.min_by(F.struct("file_path", "folder_year", "filename", "content"), "file_path").alias("f")).select("file_hash", "f.*")
    read_pages(one_each, readers, ocr).select("file_hash", "page_index", "digital_text", "ocr_text", "error", mode.alias("with_ocr")).write.mode("append").parquet(path)
    pages = spark.read.parquet(path).filter(F.col("with_ocr") == mode).drop("with_ocr")
    return files.select("file_path", "folder_year", "filename", "file_hash").join(pages, "file_hash").select(*(c.split()[0] for c in PAGES.split(", ")))


def choose_page_text(pages: DataFrame, use_ocr: bool = True) -> DataFrame:
    """Adds ``page_text`` and ``by_ocr``: the scan's text where the digital one is short and the scan's is longer."""
    d, o = (F.coalesce(F.col(c), F.lit("")) for c in ("digital_text", "ocr_text"))
    scanned = F.lit(use_ocr) & (F.length(strip(d)) < X.OCR_PAGE_CHARS) & (F.length(strip(o)) > F.length(strip(d)))
    return pages.withColumns({"page_text": F.when(scanned, o).otherwise(d), "by_ocr": scanned})


def method(ocr_pages, pages):  # noqa: ANN001, ANN201
    return F.when(ocr_pages == 0, "Digital").when(ocr_pages == pages, "OCR").otherwise("Hybrid")


def page_counts(pages: DataFrame) -> DataFrame:
    """Rows (file_path, page_count, ocr_page_count, extraction_method), each page index counted once, without the texts."""
    p = choose_page_text(pages).select("file_path", "page_index", "by_ocr").groupBy("file_path", "page_index").agg(F.max("by_ocr").alias("by_ocr"))
    counts = p.groupBy("file_path").agg(F.count("page_index").cast("int").alias("page_count"), F.sum(F.col("by_ocr").cast("int")).cast("int").alias("ocr_page_count"))
    return counts.withColumn("extraction_method", method(F.col("ocr_page_count"), F.col("page_count")))


def documents_from_pages(pages: DataFrame) -> DataFrame:
    """One row per ``file_path``, its pages joined by line ends in their order; a page listed twice counts once.

    A document's pages come together in one row, so that a row is as large as the largest document; documents are spread
    by their path, which is unique to a file, never by the scanner's file name. ``file_hash`` is that of the file's bytes
    and comes with the pages; pages that have none give documents without one, since their text says nothing about the
    file: two blank scans are no copies of each other. A file without pages is an empty document.
    """
    have = pages if "file_hash" in pages.columns else pages.withColumn("file_hash", F.lit(None).cast("string"))
    p = choose_page_text(have).groupBy("file_path", "page_index").agg(F.min(F.struct("page_text", "by_ocr", "folder_year", "filename")).alias("p"), F.min("file_hash").alias("file_hash"))
    d = p.groupBy("file_path").agg(
        F.min("p.folder_year").alias("folder_year"), F.min("p.filename").alias("filename"), F.min("file_hash").alias("file_hash"), F.count("page_index").cast("int").alias("page_count"),
        F.coalesce(F.sum(F.when(F.col("page_index").isNotNull(), F.col("p.by_ocr").cast("int"))), F.lit(0)).cast("int").alias("ocr_page_count"), F.array_sort(F.collect_list(F.struct("page_index", "p.page_text"))).alias("all"),
    )
    text = F.array_join(F.transform("all", lambda x: x["page_text"]), "\n")
    d = d.withColumns({"text": text, "extraction_method": method(F.col("ocr_page_count"), F.col("page_count"))})
    return d.select("folder_year", "filename", "file_path", "text", "extraction_method", "page_count", "ocr_page_count", "file_hash")


def with_file_hashes(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Pages with the hash that earlier records of their file give, in lower case; the smallest where they differ."""
    known = F.lower(F.trim("file_hash"))
    hashes = records.filter(F.length(known) > 0).groupBy("file_path").agg(F.min(known).alias("file_hash"))
    return pages.drop("file_hash").join(hashes, "file_path", "left")


def bronze(documents: DataFrame, path: str) -> DataFrame:
    """Writes extracted documents by folder year and reads them back, so that texts are extracted once."""
    documents.write.mode("overwrite").partitionBy("folder_year").parquet(path)
    return documents.sparkSession.read.schema(documents.schema).parquet(path).select(documents.columns)
