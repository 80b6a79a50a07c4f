"""Single files on whatever file system Spark itself reads: local, HDFS or an object store."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none where there is no such folder."""
    if not is_folder(spark, folder):
        return []
    p, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small text as one file, in UTF-8, over what was there."""
    p, fs = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
