"""Human verdicts on years, merged from several files."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statutor.functions.text import plausible, strip
from statutor.sources.files import exists, is_folder, listed

SCHEMA = "filename string, correct_year string, verified_by string, evidence string, note string"


def override_files(spark: SparkSession, root: str, year: int, explicit: str | None = None) -> list[str]:
    """The files that hold verdicts on a folder year, in the order in which later ones win. Templates don't count."""
    files = [f"{root}/data/manual_year_overrides.csv", f"{root}/data/manual_year_overrides_{year}.csv"]
    if explicit:
        files += [f"{explicit}/{n}" for n in listed(spark, explicit) if fnmatch(n, f"*{year}*.csv")] if is_folder(spark, explicit) else [explicit]
    return [f for f in files if exists(spark, f) and "TEMPLATE" not in f.rsplit("/", 1)[-1]]


def read_overrides(spark: SparkSession, files: dict[str, int | None]) -> DataFrame:
    """Rows of the given files (path to folder year, None for all), with ``priority`` and ``override_id`` in reading order.

    A file without the columns ``filename`` and ``correct_year`` gives no rows.
    """
    out = None
    for i, (path, year) in enumerate(files.items()):
        head = spark.read.option("header", True).csv(path)
        if not {"filename", "correct_year"} <= set(head.columns):
            continue
        have = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] in head.columns]
        d = head.select(*have, *(F.lit(None).cast("string").alias(c.split()[0]) for c in SCHEMA.split(", ") if c.split()[0] not in have))
        d = d.select(*(c.split()[0] for c in SCHEMA.split(", ")), F.lit(year).cast("int").alias("folder_year"), F.lit(i).alias("priority"), (F.lit(i * 10**9) + F.monotonically_increasing_id()).alias("override_id"))
        out = d if out is None else out.unionByName(d)
    return spark.createDataFrame([], SCHEMA + ", folder_year int, priority int, override_id long") if out is None else out


def usable(overrides: DataFrame) -> DataFrame:
    """Verdicts with a plausible year, file names stripped."""
    year = plausible(F.col("correct_year").try_cast("double"))
    return overrides.withColumns({"filename": strip(F.col("filename")), "correct_year": year}).filter("correct_year IS NOT NULL AND filename IS NOT NULL")


def rank() -> Column:
    return F.struct(F.coalesce("priority", F.lit(-1)).alias("priority"), F.col("override_id").alias("override_id"))


def merged(overrides: DataFrame) -> DataFrame:
    """One verdict per (filename, folder_year), the one of the highest priority, of equals the later. A null folder year
    stands for all years."""
    best = usable(overrides).groupBy("filename", "folder_year").agg(F.max(F.struct(rank().alias("rank"), "correct_year", "verified_by", "evidence", "note")).alias("b"))
    return best.select("filename", "folder_year", "b.correct_year", "b.verified_by", "b.evidence", "b.note", F.col("b.rank").alias("rank"))


def conflicts(overrides: DataFrame) -> DataFrame:
    """Verdicts that change the year of an earlier one on the same file name, in the order of merging.

    The window runs over one file name's verdicts, which people write by hand.
    """
    w = Window.partitionBy("filename").orderBy(F.coalesce("priority", F.lit(-1)), "override_id")
    d = usable(overrides).withColumn("earlier_year", F.lag("correct_year").over(w))
    return d.filter("earlier_year != correct_year").select("filename", "override_id", "earlier_year", "correct_year")
