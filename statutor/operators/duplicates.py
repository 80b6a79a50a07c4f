"""Duplicate groups and which of their members to keep.

Nothing here uses a window over a key: the best member of a group is an aggregate, taken in part before the shuffle, and
is joined back, so that a key on a third of all rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutor.sources.tables import ranked


def losers(df: DataFrame, key: str, order: Column, name: str) -> DataFrame:
    """Adds boolean ``name``: whether the row isn't its key's first by ``order`` (a struct that ends in something unique).

    A null key marks nothing.
    """
    first = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_first"))
    d = df.withColumn("_order", order).join(first, F.col(key) == F.col("_key"), "left")
    return d.withColumn(name, F.coalesce(F.col("_order") != F.col("_first"), F.lit(False))).drop("_key", "_first", "_order")


def descending(c: Column) -> list[Column]:
    """Keys that sort a number from high to low, nulls last."""
    return [c.isNull(), -c]


def duplicate_losers(df: DataFrame, row_order: str = "scan_seq", either: bool = True) -> DataFrame:
    """Adds ``loses_hash``, ``loses_number`` and ``is_loser``.

    Of equal hashes the first by (folder year, file name) stays; of equal numbers the one filed under its own year, then the
    surest, then the longest. Ties go by ``row_order``. The two are independent, so a group can lose every member; with
    ``either`` false a row must lose by number to be a loser where it has one.
    """
    by_hash = F.struct(F.col("folder_year"), F.col("filename"), F.col(row_order))
    own_year = ~F.coalesce(F.col("folder_year") == F.col("resolved_year"), F.lit(False))
    parts = [own_year, *descending(F.col("confidence_score")), *descending(F.col("char_count")), F.col(row_order)]
    by_number = F.struct(*(p.alias(f"o{i}") for i, p in enumerate(parts)))
    d = losers(losers(df, "file_hash", by_hash, "loses_hash"), "ordinance_number", by_number, "loses_number")
    lost = (F.col("loses_hash") | F.col("loses_number")) if either else F.when(F.col("ordinance_number").isNotNull(), F.col("loses_number")).otherwise(F.col("loses_hash"))
    return d.withColumn("is_loser", lost)


def groups(df: DataFrame, key: str) -> DataFrame:
    """Rows (key, n) of the keys that more than one row has, nulls left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def group_totals(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """How many groups of more than one row there are, and how many rows they cover, by ``by`` or in all."""
    by = by or []
    g = df.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n")).filter("n > 1")
    out = [F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("files")]
    return g.groupBy(*by).agg(*out) if by else g.agg(*out)


def listed_files(df: DataFrame, row_order: str = "scan_seq") -> DataFrame:
    """Rows (ordinance_number, ``row_order``, filename, resolved_year, n_files): every file of each number on more than one row.

    The whole listing, one row per file and so of any size; within a number ``row_order`` gives the files' order.
    """
    return df.join(groups(df, "ordinance_number"), "ordinance_number").select("ordinance_number", row_order, "filename", "resolved_year", F.col("n").alias("n_files"))


def listing(df: DataFrame, row_order: str = "scan_seq", size: int = 50) -> DataFrame:
    """Rows (ordinance_number, part, n_files, files, resolved_years) of each number on more than one row.

    All its file names are there in row order, in numbered parts of ``size`` names, so that a cell holds what can be read
    and a number on any share of all rows is listed whole. ``resolved_years`` are those of all its rows.
    """
    g = listed_files(df, row_order)
    parts = ranked(g, ["ordinance_number"], [row_order, "filename"]).withColumn("part", F.expr(f"place div {size}").cast("int"))
    names = parts.groupBy("ordinance_number", "part").agg(F.first("n_files").alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "filename"))), lambda x: x["filename"]), ", ").alias("files"))
    years = F.array_join(F.array_sort(F.collect_set(F.col("resolved_year").cast("string"))), ", ")
    whole = g.groupBy("ordinance_number").agg(F.when(years == "", "n/a").otherwise(years).alias("resolved_years"))
    return names.join(whole, "ordinance_number").select("ordinance_number", "part", "n_files", "files", "resolved_years")
