"""Repetition inside a single document (problem 8)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statutor.llm.common import batches_of_chars
from statutor.sources.tables import spread

_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_ids(texts: list[str], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words (runs of letters, in lower case) of all texts as numbers, and how many words each text has."""
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for i, t in enumerate(texts):
        words = _WORD.findall(t.lower())
        counts[i] = len(words)
        parts.extend([ids.setdefault(w, len(ids)) for w in words])
    return np.array(parts, np.uint64), counts


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive words."""
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def repeated_words(words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Per text, how many of its words lie in a run of ``n`` words that began before in the same text."""
    size = len(words)
    ends = np.cumsum(counts)
    if size < n:
        return np.zeros(len(counts), np.int64)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    inside = owner[: size - n + 1] == owner[n - 1 :]
    at = np.flatnonzero(inside)
    h = window_hashes(words, n)[at] ^ ((owner[at] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(h, kind="stable")
    again = at[order[1:][h[order[1:]] == h[order[:-1]]]]
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + n, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return covered[ends] - covered[ends - counts]


def measure_repetition(df: DataFrame, key: str, text: str, n: int = 6) -> DataFrame:
    """Rows (key, n_words, n_repeated, share_repeated), one for each row of ``df``, in Arrow batches without a shuffle.

    A word is repeated if it lies in ``n`` consecutive words that, in the same order, began at an earlier word of the
    same text. Null and empty texts have no words and a share of 0. Repeated rows are measured each on their own;
    other columns are left out. Runs of words are compared as 64-bit hashes over numbers given to the words.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words, repeated = [], []
            for part in batches_of_chars((i, t or "") for i, t in enumerate(texts)):
                if len(ids) > 2_000_000:
                    ids.clear()
                w, counts = word_ids([t for _, t in part], ids)
                words.append(counts)
                repeated.append(repeated_words(w, counts, n))
            total, again = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (words, repeated))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(again), pa.array(again / np.maximum(total, 1))], [key, "n_words", "n_repeated", "share_repeated"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_words long, n_repeated long, share_repeated double")
