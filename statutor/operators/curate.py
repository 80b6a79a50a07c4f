"""What belongs in the corpus and under which year; file moves as plans, never done here."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.operators.duplicates import duplicate_losers

INDEX = (
    "filename file_path ordinance_number title folder_year resolved_year corpus_year enactment_date approval_date temporal_status "
    "confidence_score removal_reason included_in_corpus clean_word_count word_count page_count section_count subject_keywords clean_text_path"
).split()


def protected():  # noqa: ANN201
    return F.coalesce(F.col("manually_verified"), F.lit(False)) & ~F.col("temporal_status").eqNullSafe("out_of_scope")


def flag_removals(df: DataFrame, categories: Collection[str] = X.DEFAULT_CATEGORIES, row_order: str = "scan_seq") -> DataFrame:
    """Adds ``removal_reason``: the first category that applies, '' for rows to keep and for protected ones."""
    rules = {
        "duplicate": F.col("is_loser"), "out_of_scope": F.col("temporal_status") == "out_of_scope", "misfiled": F.col("temporal_status") == "misfiled",
        "review": F.col("temporal_status") == "review", "unresolved": F.col("temporal_status") == "unresolved", "sparse": F.coalesce(F.col("is_sparse"), F.lit(False)),
    }
    d = duplicate_losers(df.drop("removal_reason"), row_order) if "duplicate" in categories else df.drop("removal_reason")
    reason = F.when(protected(), "")
    for c in X.CATEGORIES:
        if c in categories:
            reason = reason.when(rules[c], X.REASONS[c])
    return d.withColumn("removal_reason", reason.otherwise("")).drop("loses_hash", "loses_number", "is_loser")


def trusted():  # noqa: ANN201
    return F.coalesce((F.col("confidence_score") >= X.MISFILE_BAR) & F.col("resolved_year").isNotNull(), F.lit(False))


def with_corpus_year(df: DataFrame) -> DataFrame:
    """Adds the corpus year and whether the record is in the corpus."""
    return df.withColumns({
        "corpus_year": F.when(trusted(), F.col("resolved_year")).otherwise(F.col("folder_year")).cast("int"),
        "included_in_corpus": (F.coalesce("removal_reason", F.lit("")) == "") & ~F.coalesce(F.col("is_sparse"), F.lit(False)),
    })


def corpus_index(df: DataFrame) -> DataFrame:
    """The index's columns, as far as they are there, with the corpus year and whether the record is in the corpus."""
    d = with_corpus_year(df)
    return d.select(*(c for c in INDEX if c in d.columns))


def corpus_only(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("included_in_corpus", F.lit(True)))


def removal_plan(df: DataFrame, quarantine: str = "data/quarantine") -> DataFrame:
    """Where each flagged file goes: ``quarantine/<reason>/<folder year>/``; by reason and file name."""
    d = df.filter(F.coalesce("removal_reason", F.lit("")) != "")
    to = F.concat_ws("/", F.lit(quarantine), "removal_reason", F.col("folder_year").cast("string"), "filename")
    return d.select("filename", F.col("file_path").alias("original_path"), to.alias("quarantine_path"), F.lit("quarantine").alias("action"), "removal_reason", "folder_year", "resolved_year", "confidence_score", "ordinance_number").orderBy("removal_reason", "filename")


def purge_plan(df: DataFrame) -> DataFrame:
    """The flagged files as a plan to delete them, for people to carry out: nothing here deletes, and no plan can bring them back."""
    plan = removal_plan(df)
    return plan.select("filename", "original_path", F.lit("").alias("quarantine_path"), F.lit("purge").alias("action"), *plan.columns[4:])


def after_removal(df: DataFrame, quarantine: str = "data/quarantine") -> DataFrame:
    """Records with the path that each flagged file has once the removal plan is carried out."""
    to = F.concat_ws("/", F.lit(quarantine), "removal_reason", F.col("folder_year").cast("string"), "filename")
    return df.withColumn("file_path", F.when(F.coalesce("removal_reason", F.lit("")) != "", to).otherwise(F.col("file_path")))


def restore_plan(manifest: DataFrame) -> DataFrame:
    """The quarantine moves of a manifest backwards, each path pair once; purged files can't be brought back.

    The action is compared without regard to case and spaces.
    """
    action = F.lower(F.trim(F.col("action" if "action" in manifest.columns else "action_taken")))
    return manifest.filter(action == "quarantine").select(F.col("quarantine_path").alias("source"), F.col("original_path").alias("target")).distinct()


def relocation_plan(df: DataFrame, bar: float = X.RELOCATE_BAR) -> DataFrame:
    """Misfiled files with a year, and whether they are sure enough to be moved there."""
    d = df.filter((F.col("temporal_status") == "misfiled") & F.col("resolved_year").isNotNull())
    return d.select("filename", "file_path", "folder_year", "resolved_year", "confidence_score", F.concat_ws("/", F.lit("data/raw"), F.col("resolved_year").cast("string"), "filename").alias("target"), F.coalesce(F.col("confidence_score") >= bar, F.lit(False)).alias("eligible"))
