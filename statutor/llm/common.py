"""Helpers shared by the training-data operators."""

from __future__ import annotations

__all__ = ["WordHashes", "batches_of_chars", "cut", "fold_width", "is_blank", "join_term_stats", "table"]

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statutor.sources.tables import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordHashes(dict):
    """64-bit hashes of words, each made once; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > 2_000_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def fold_width(c: Column) -> Column:
    """Full-width forms of ASCII characters and the ideographic space as plain ones."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\u00a0"
    return F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F))) + "  ")


def join_term_stats(rows: DataFrame, stats: DataFrame, key: str, freq: str, n_rows: int, share: float = 0.001) -> DataFrame:
    """Inner join of ``rows`` with one ``stats`` row per (string) ``key``, safe for hot keys.

    ``stats[freq]`` is how many of the ``n_rows`` rows hold the key. At most ``1 / share`` keys can each hold more
    than ``share`` of all rows, so that part of ``stats`` has a proven bound and is broadcast; for the rest a shuffled
    join meets no key with more than ``share`` of the rows.
    """
    hot = stats.filter(F.col(freq) > F.lit(share * n_rows))
    cold = stats.filter(F.col(freq) <= F.lit(share * n_rows))
    rest = [c for c in stats.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(key, F.struct(*rest).alias("_hot"))), key, "left")
    # rows already served get keys that match nothing and lie in all partitions
    marked = marked.withColumn("_cold", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string"))))
    out = marked.join(cold.select(F.col(key).alias("_cold"), F.struct(*rest).alias("_rest")), "_cold", "left")
    out = out.withColumn("_stats", F.coalesce("_hot", "_rest")).filter("_stats IS NOT NULL")
    return out.select(*rows.columns, *(F.col(f"_stats.{c}").alias(c) for c in rest))


def batches_of_chars(rows: Iterator, size: Iterator | None = None, limit: int = 8_000_000) -> Iterator[list]:
    """Regroup (key, text) rows into lists of at most ``limit`` characters, so that memory holds whatever the texts' length."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1] or "")
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held
