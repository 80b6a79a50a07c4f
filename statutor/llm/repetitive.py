"""A calibrated classifier of texts that repeat themselves (problem 8).

A logistic regression over hashed word and character n-grams, weighted by how often a text has said them before, gives the
probability that a text repeats at least a given share of its words. It is trained on labelled rows of the table itself
and scored in Arrow batches against fixed thresholds; the share of those it holds possible is then measured exactly.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutor.llm.common import WordHashes, batches_of_chars
from statutor.llm.repetition import _MIX, _WORD, repeated_words
from statutor.sources.tables import spread

#: Sizes of the word n-grams, of the character n-grams (multiples of eight), and the buckets that each size is hashed to.
WORD_SIZES, CHAR_SIZES, BUCKETS = (1, 2, 3, 4, 6), (8, 24), 64
#: Classes of counts within a text besides the buckets: an n-gram said 2, 3, ... or at least ``COUNTS`` times.
COUNTS = 8
_SLOTS = BUCKETS + COUNTS
WIDTH = (len(WORD_SIZES) + len(CHAR_SIZES)) * _SLOTS
#: Fixed thresholds on the calibrated probability: below the first a text is let pass, from the second on it counts as
#: repetitive; from the first on its share is measured.
POSSIBLE, LIKELY = 0.01, 0.5


def _step(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _MIX
    return h ^ (h >> np.uint64(29))


def _word_grams(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    h = np.zeros(len(words), np.uint64)
    for n in range(1, max(WORD_SIZES) + 1):
        k = max(0, len(words) - n + 1)
        h = _step(h[:k], words[n - 1 :][:k])
        if n in WORD_SIZES:
            yield n, h


def _char_grams(chars: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    h, n = _step(chars.astype(np.uint64), np.uint64(7)), 1
    while n < 8:
        k = max(0, len(h) - n)
        h, n = _step(h[:k] * np.uint64(3), h[n:][:k]), 2 * n
    eight = h
    while True:
        if n in CHAR_SIZES:
            yield n, h
        if n >= max(CHAR_SIZES):
            return
        k = max(0, len(eight) - n)
        h, n = _step(h[:k], eight[n:][:k]), n + 8


@dataclass
class Repeats:
    """The n-grams that a text says more than once: its place, the feature's two slots, the count, and how many n-grams it has."""

    owner: np.ndarray
    bucket: np.ndarray
    times: np.ndarray
    count: np.ndarray
    total: np.ndarray


def repeats(units: np.ndarray, counts: np.ndarray, chars: bool) -> Iterator[Repeats]:
    """For each size of n-grams of the texts' units (``counts`` of them each), those that come again within a text."""
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    sizes, grams = (CHAR_SIZES, _char_grams) if chars else (WORD_SIZES, _word_grams)
    base = len(WORD_SIZES) if chars else 0
    for n, h in grams(units):
        inside = owner[: len(h)] == owner[n - 1 :][: len(h)]
        keys = np.sort(((owner[: len(h)] << np.uint64(44)) | (h >> np.uint64(20)))[inside])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(keys)))
        again = count > 1
        key, count = keys[first[again]], count[again]
        slot = (base + sizes.index(n)) * _SLOTS
        who = (key >> np.uint64(44)).astype(np.int64)
        yield Repeats(who, slot + ((key >> np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64), slot + BUCKETS + np.minimum(count, COUNTS) - 1, count, np.maximum(1, counts - n + 1)[who])


def hashed_words(texts: list[str], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as 64-bit hashes, the same in every batch, and how many words each text has."""
    found = [_WORD.findall(t.lower()) for t in texts]
    return cache.of(list(chain.from_iterable(found))), np.array([len(w) for w in found], np.int64)


def units_of(texts: list[str], cache: WordHashes) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    words, counts = hashed_words(texts, cache)
    chars = np.frombuffer("".join(texts).lower().encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(chars) != sizes.sum():  # a character whose lower case is longer
        parts = [t.lower() for t in texts]
        chars, sizes = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32), np.array([len(t) for t in parts], np.int64)
    return [(words, counts, False), (chars, sizes, True)]


def features(units: list[tuple[np.ndarray, np.ndarray, bool]]) -> np.ndarray:
    """The features of each text as a dense matrix, for training."""
    out = np.zeros((len(units[0][1]), WIDTH), np.float32)
    for values, counts, chars in units:
        for r in repeats(values, counts, chars):
            np.add.at(out, (r.owner, r.bucket), 8.0 * (r.count - 1) / r.total)
            np.add.at(out, (r.owner, r.times), r.count / r.total)
    return out


@dataclass
class RepetitionModel:
    """Weights of the features and the line that calibrates their sum."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probabilities(self, units: list[tuple[np.ndarray, np.ndarray, bool]]) -> np.ndarray:
        """Scored without a matrix: each repeated n-gram adds its weights to its text."""
        n = len(units[0][1])
        z = np.full(n, self.bias)
        for values, counts, chars in units:
            for r in repeats(values, counts, chars):
                z += np.bincount(r.owner, (8.0 * (r.count - 1) * self.weights[r.bucket] + r.count * self.weights[r.times]) / r.total, n)
        return _sigmoid(self.slope * z + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, of greatest penalised likelihood, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 20 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray, penalty: float = 0.3) -> RepetitionModel:
    """A model of all rows, calibrated on scores that each half of them gets from a model of the other half."""
    if len(y) == 0:
        return RepetitionModel(np.zeros(WIDTH), 0.0)
    held = np.zeros(len(y))
    for k in (0, 1):
        other = fold != k
        w = fit_logistic(x[other], y[other], penalty) if other.any() else np.zeros(WIDTH + 1)
        held[~other] = x[~other] @ w[:-1] + w[-1]
    most = max(1.0, y.sum())
    soft = np.where(y > 0, (most + 1) / (most + 2), 1 / (len(y) - y.sum() + 2))  # so that a clean cut stays finite
    a, b = fit_logistic(held[:, None] / 10, soft, 1e-3)
    w = fit_logistic(x, y, penalty)
    return RepetitionModel(w[:-1], float(w[-1]), float(a) / 10, float(b))


def spliced(text: str, seed: int, longest: int = 1200) -> str | None:
    """The text with one of its passages said again so often that a share drawn at random is repeated; None for a short text."""
    rng = random.Random(seed)
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)][:longest]
    n, size = len(places), rng.randint(7, 60)
    if n < 2 * size:
        return None
    share, at = rng.uniform(0.05, 0.9), rng.randrange(n - size)
    times = max(1, round(share * n / (1 - share) / size))
    passage = text[places[at][0] : places[at + size - 1][1]]
    where = places[rng.randrange(n)][0]
    return f"{text[:where]} {' '.join([passage] * times)} {text[where : places[-1][1]]}"


def fit_repetition_model(df: DataFrame, key: str, text: str, share: float = 0.4, n: int = 6, least_words: int = 12, sample: int = 3000) -> RepetitionModel:
    """A model fitted on a bounded sample: about ``sample`` rows, never more than a quarter above, in the order of a hash.

    Rows are labelled by the exact share of their repeated words. Beside each stands a copy with a passage of its own
    spliced in again, so that rows on both sides of the border are there whatever the table's own are like.
    """
    rows = df.select(key, text).filter(F.col(text).isNotNull() & F.col(key).isNotNull())
    total = rows.count()
    if total > sample:
        low = F.pmod(F.xxhash64(F.lit(17), key, text), F.lit(1_000_000))
        rows = rows.filter(low < int(1_000_000 * min(1.0, sample / total)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i, t) for i, t in enumerate(x.as_py() for x in batch.column(0))]
            for part in batches_of_chars(iter(own)):
                texts = [t for _, t in part]
                seeds = [sum(map(ord, t[:200])) * 31 + len(t) for t in texts]
                again = [(s, spliced(t, s)) for s, t in zip(seeds, texts, strict=True)]
                texts, seeds = texts + [t for _, t in again if t], seeds + [s for s, t in again if t]
                units = units_of(texts, WordHashes())
                words, counts = units[0][:2]
                repeated = repeated_words(words, counts, n)
                x = features(units)
                keep = np.flatnonzero(counts >= least_words)
                label = repeated >= share * counts - 1e-9
                yield pa.RecordBatch.from_arrays([pa.array([x[k].tobytes() for k in keep], pa.binary()), pa.array(label[keep]), pa.array([seeds[k] % 2 for k in keep], pa.int32())], ["x", "y", "fold"])

    out = spread(rows.limit(sample * 5 // 4).select(text)).mapInArrow(run, "x binary, y boolean, fold int").toArrow()
    x = np.frombuffer(b"".join(out.column(0).to_pylist()), np.float32).reshape(-1, WIDTH)
    return train(x, np.array(out.column(1).to_pylist(), float), np.array(out.column(2).to_pylist(), np.int64))


def score_repetition(df: DataFrame, key: str, text: str, model: RepetitionModel | None = None, n: int = 6, **fit: object) -> DataFrame:
    """Rows (key, n_words, probability, verdict, share_repeated), one for each row of ``df``, in one pass without a shuffle.

    ``probability`` is the model's, that a text repeats at least the share it was fitted for; ``verdict`` is "clean" below
    ``POSSIBLE``, "repetitive" from ``LIKELY`` on and "possible" between. The share of repeated words is measured, exactly as by
    ``measure_repetition``, for all texts but the clean ones, where it is null. Null and empty texts are clean with no words.
    Repeated rows are scored each on their own, null keys are kept, other columns are left out. An empty table gives no rows.
    """
    model = model or fit_repetition_model(df, key, text, n=n, **fit)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, WordHashes()
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
            for part in batches_of_chars((i, t.as_py() or "") for i, t in enumerate(batch.column(1))):
                units = units_of([t for _, t in part], cache)
                words, counts = units[0][:2]
                p = np.where(counts > 0, own.probabilities(units), 0.0)
                asked = p >= POSSIBLE
                repeated = repeated_words(words[np.repeat(asked, counts)], counts[asked], n)
                share = np.full(len(counts), np.nan)
                share[asked] = repeated / np.maximum(1, counts[asked])
                for x, y in zip(out, (counts, p, share), strict=True):
                    x.append(y)
            total, p, share = (np.concatenate(x) for x in out)
            verdict = np.where(p < POSSIBLE, "clean", np.where(p < LIKELY, "possible", "repetitive"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(p), pa.array(verdict.astype(object), pa.string()), pa.array(share, pa.float64(), mask=np.isnan(share))], [key, "n_words", "probability", "verdict", "share_repeated"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_words long, probability double, verdict string, share_repeated double")
