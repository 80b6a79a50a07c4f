"""An audit run from documents to tables, reports and the vault."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.operators.audit import SUMMARY, apply_overrides, audit, debug_headers, override_template
from statutor.operators.curate import INDEX, after_removal, corpus_index, corpus_only, flag_removals, purge_plan, relocation_plan, removal_plan, with_corpus_year
from statutor.operators.report import crosstab, render_corpus, render_year, year_tables
from statutor.operators.vault import corpus_map, named, notes, year_indices
from statutor.sources.files import write_text


@dataclass
class Run:
    """What a run is asked for. Destructive steps are only planned, never done.

    ``years`` are the folder years to take, by default those of the window; ``all_years`` takes every one that is there.
    ``plan_only`` writes the plans and tables but no vault, and leaves ``file_path`` as it is; ``sample`` adds that many
    documents' headers for debugging.
    """

    years: list[int] | None = None
    all_years: bool = False
    window: tuple[int, int] = X.STUDY_WINDOW
    min_confidence: float = X.RELOCATE_BAR
    categories: tuple[str, ...] = X.DEFAULT_CATEGORIES
    clean_text: bool = True
    vault: bool = False
    vault_text: bool = True
    vault_text_chars: int = 12_000
    vault_corpus_only: bool = False
    template: bool = False
    purge: bool = False
    plan_only: bool = False
    sample: int = 0
    clean_root: str = "data/processed/clean_text"
    reports: list[int] | None = field(default=None)

    def taken(self) -> list[int] | None:
        return None if self.all_years else list(self.years) if self.years is not None else list(range(self.window[0], self.window[1] + 1))


def records(documents: DataFrame, run: Run, overrides: DataFrame | None = None) -> DataFrame:
    """Audit records with verdicts laid over them, and with their removal reason; ``clean_text`` comes along."""
    years = run.taken()
    docs = documents if years is None else documents.filter(F.col("folder_year").isin(years))
    d = audit(docs, run.window, run.clean_root if run.clean_text else "", keep_text=True)
    if overrides is not None:
        d = apply_overrides(d, overrides, run.window)
    return flag_removals(d, run.categories, row_order="file_path")


def write(documents: DataFrame, out: str, run: Run | None = None, overrides: DataFrame | None = None) -> dict[str, str]:
    """Runs the audit once into a record table and derives every output from it; gives the outputs' places.

    The clean text of a document lies in ``clean_text`` by folder year under the ``clean_text_path`` that its record names.
    """
    run = run or Run()
    spark: SparkSession = documents.sparkSession
    places = {k: f"{out}/{k}" for k in ("records", "summary", "summary_by_year", "corpus_index", "plan_removal", "plan_relocation", "plan_purge", "crosstab", "clean_text", "template", "vault", "headers")}
    records(documents, run, overrides).write.mode("overwrite").parquet(places["records"])
    d = spark.read.parquet(places["records"])
    flat = d.drop("clean_text")
    removal_plan(flat).write.mode("overwrite").parquet(places["plan_removal"])
    if run.purge:
        purge_plan(flat).write.mode("overwrite").parquet(places["plan_purge"])
    relocation_plan(flat, run.min_confidence).write.mode("overwrite").parquet(places["plan_relocation"])
    moved = flat if run.plan_only else after_removal(flat)
    moved.select(*SUMMARY, "removal_reason").write.mode("overwrite").option("header", True).csv(places["summary"])
    moved.select(*SUMMARY).write.mode("overwrite").partitionBy("folder_year").option("header", True).csv(places["summary_by_year"])
    corpus_index(moved).write.mode("overwrite").option("header", True).csv(places["corpus_index"])
    crosstab(flat).orderBy("folder_year").write.mode("overwrite").parquet(places["crosstab"])
    if run.clean_text:
        d.select("folder_year", "clean_text_path", "clean_text").write.mode("overwrite").partitionBy("folder_year").parquet(places["clean_text"])
    if run.template:
        override_template(flat).write.mode("overwrite").partitionBy("folder_year").option("header", True).csv(places["template"])
    if run.sample:
        debug_headers(documents, run.sample).write.mode("overwrite").json(places["headers"])
    if run.vault and not run.plan_only:
        full = with_corpus_year(d)
        full = named(corpus_only(full) if run.vault_corpus_only else full, "file_path")
        pages = notes(full, run.vault_text, run.vault_text_chars, order="file_path").withColumn("part", F.lit(0))
        pages.unionByName(year_indices(full, "file_path")).write.mode("overwrite").parquet(places["vault"])
        corpus_map(full).orderBy("folder_year").write.mode("overwrite").parquet(f"{places['vault']}_map")
    for year in run.reports or []:
        for name, df in year_tables(flat, year).items():
            df.write.mode("overwrite").parquet(f"{out}/report_{year}_{name}")
        write_text(spark, f"{out}/report_{year}.md", render_year(flat, year, run.window))
    if run.reports:
        write_text(spark, f"{out}/report_corpus.md", render_corpus(flat))
    return places


def write_vault_files(vault: DataFrame, root: str) -> None:
    """Writes the notes and indices of a vault table, (path, part, content), as files under ``root``.

    Parts of a path follow one another in one file. Each task writes the files of its paths, one part at a time, to a
    folder that every executor can reach.
    """

    def put(rows: Iterator[Row]) -> None:
        from pathlib import Path

        last = None
        for r in rows:
            at = Path(root) / r["path"]
            at.parent.mkdir(parents=True, exist_ok=True)
            with at.open("a" if r["path"] == last else "w", encoding="utf-8") as f:
                f.write(("\n" if r["path"] == last else "") + r["content"])
            last = r["path"]

    vault.repartition("path").sortWithinPartitions("path", "part").foreachPartition(put)


def append_manifest(plan: DataFrame, path: str) -> None:
    """Adds the moves that were made to the manifest, with the time they were made at."""
    plan.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("append").parquet(path)


__all__ = ["INDEX", "Run", "append_manifest", "records", "write", "write_vault_files"]
