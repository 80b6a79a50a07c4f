"""Mixing sources to target weights (problem 7)."""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from statutor.llm.common import cut
from statutor.sources.tables import spread

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary's rank file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slots that a draw of random counts is made for exactly; above it a normal approximation is as good and has no limit.
EXACT_DRAW = 500_000_000


@cache
def encoding(path: str = RANKS) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@cache
def goes_on(path: str = RANKS) -> np.ndarray:
    """For each token whether its first byte goes on with a character that began before it."""
    enc = encoding(path)
    return np.array([0x80 <= enc.decode_single_token_bytes(k)[0] < 0xC0 for k in range(enc.n_vocab)])


def token_type(path: str = RANKS) -> type:
    """The narrowest type that holds the vocabulary's tokens, in which they are stored and shuffled."""
    return np.uint16 if encoding(path).n_vocab <= 65_536 else np.uint32


def source_key(c: Column) -> Column:
    """A source's name in lower case, trimmed, with one underscore for white space and hyphens; null where blank."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-]+", "_")
    return F.when(t != "", t)


def tokenised(df: DataFrame, key: str, text: str, keep: list[str], path: str = RANKS) -> DataFrame:
    """``key`` and ``keep`` with ``n_tokens`` and ``tokens`` (in ``token_type``), none for null, in Arrow batches without a shuffle."""
    columns = [key, *keep]
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("n_tokens", T.LongType()), T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoding(path).encode_ordinary, token_type(path)
        for batch in batches:
            held = [np.array(encode(t.as_py()) if t.is_valid else [], kind) for t in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array([len(x) for x in held], pa.int64()), pa.array([x.tobytes() for x in held], pa.binary())], [*columns, "n_tokens", "tokens"])

    return spread(df.select(*columns, text)).mapInArrow(run, schema)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for each key, at ``index``: a Feistel network walked until inside."""
    index, size, key = (np.asarray(x).astype(np.uint64) for x in (index, size, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float) + 0.5)) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = index.copy(), np.arange(len(index))
    while len(left):
        x, h, m, k = out[left], half[left], mask[left], key[left]
        a, b = x >> h, x & m
        for r in range(4):
            f = (b + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
            a, b = b, a ^ ((f >> np.uint64(33)) & m)
        out[left] = (a << h) | b
        left = left[out[left] >= size[left]]
    return out.astype(np.int64)


def laid_out(counts: DataFrame, totals: dict[str, int], seed: int, bucket_tokens: int = 4_000_000) -> DataFrame:
    """Rows (source, doc_id, n_tokens, at): the documents of each source one after the other in the order of a hash.

    Running totals are taken in buckets of the hash of about ``bucket_tokens`` each, so that a source of any size is
    spread over many tasks, and the buckets' totals are then added up.
    """
    buckets = F.coalesce(F.create_map(*(F.lit(x) for s, n in totals.items() for x in (s, max(1, -(-n // bucket_tokens)))))[F.col("source")], F.lit(1)) if totals else F.lit(1)
    d = counts.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_h", 20), buckets))
    d = d.withColumn("_end", F.sum("n_tokens").over(Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id")))
    heads = d.groupBy("source", "_bucket").agg(F.max("_end").alias("_size"))
    heads = heads.withColumn("_head", F.sum("_size").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_size")).drop("_size")
    return d.join(heads, ["source", "_bucket"]).select("source", "doc_id", "n_tokens", (F.col("_head") + F.col("_end") - F.col("n_tokens")).alias("at"))


def quotas(totals: dict[str, int], targets: dict[str, tuple[float, int]], block_tokens: int, total_tokens: int | None = None) -> dict[str, int]:
    """Full blocks to take from each source so that shares meet the targets to within a block and none is used beyond its repeats.

    A source that may be used ``r`` times gives the blocks of its tokens said ``r`` times over, so only what is less than a
    block at the very end can't be used. Shares are those of the sources that have tokens, scaled to sum to 1. The total is
    the greatest that the scarcest source allows, or ``total_tokens`` if that is less.
    """
    have = {s: (w, r) for s, (w, r) in targets.items() if totals.get(s, 0) > 0 and w > 0 and r > 0}
    scale = sum(w for w, _ in have.values())
    if not have:
        return {}
    most = {s: totals[s] * r // block_tokens for s, (_, r) in have.items()}
    total = min(most[s] * block_tokens * scale / w for s, (w, _) in have.items())
    total = min(total, total_tokens) if total_tokens is not None else total
    return {s: min(round(total * w / scale / block_tokens), most[s]) for s, (w, _) in have.items()}


def _split(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the items drawn without replacement: how many of each kind."""
    total = int(counts.sum())
    if total <= EXACT_DRAW:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out, left, rest = np.zeros_like(counts), n, total
    for k, c in enumerate(map(int, counts)):
        p = c / rest if rest else 0.0
        spread_ = math.sqrt(max(0.0, left * p * (1 - p) * (rest - left) / max(1, rest - 1)))
        out[k] = min(max(round(left * p + spread_ * rng.standard_normal()), 0, left - (rest - c)), c, left)
        left, rest = left - int(out[k]), rest - c
    return out


def draw_shards(quota: dict[str, int], slots: int, seed: int, low: int = 0, high: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard from ``low`` to ``high``: its number, its count of each source (in order of their names), the first slot of each.

    All slots are halved by shards, again and again; what falls to either half is a draw of random counts without
    replacement with a seed of its own. So each shard's counts are a multinomial given what is left of every source,
    the totals are exact, and any range of shards is drawn alone, wherever that is done.
    """
    counts = np.array([quota[s] for s in sorted(quota)], np.int64)
    shards = math.ceil(counts.sum() / slots) if len(counts) else 0
    todo = [(0, shards, counts, np.zeros_like(counts))] if shards else []
    high = shards if high is None else min(high, shards)
    while todo:
        a, b, own, first = todo.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, own, first
            continue
        mid = (a + b) // 2
        left = _split(np.random.default_rng((seed, a, b)), own, (mid - a) * slots)
        todo += [(mid, b, own - left, first + left), (a, mid, left, first)]


SEGMENT = "array<struct<position:int,doc_id:long,from_token:long,to_token:long,rest:array<int>>>"


def pack(tokens: DataFrame, totals: dict[str, int], quota: dict[str, int], block_tokens: int, seed: int, path: str = RANKS, bucket_tokens: int = 4_000_000) -> DataFrame:
    """Rows (source, block, pieces): the first ``quota`` blocks of each source's tokens, said over as often as that takes.

    Documents follow each other in the order of a hash; after the last one the first comes again. Every block has
    ``block_tokens``, wherever that cuts, and ``pieces`` has its parts with their place in it.
    """
    places = laid_out(tokens.select("source", "doc_id", "n_tokens"), totals, seed, bucket_tokens).filter(F.col("source").isin(*quota) if quota else F.lit(False))
    joined = places.select("doc_id", "source", "at").join(tokens.select("doc_id", "tokens"), "doc_id")
    size = block_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cont, kind = goes_on(path), token_type(path)
        for batch in batches:
            held, n = [[] for _ in range(8)], 0

            def out() -> pa.RecordBatch:
                types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, types, strict=True)], ["source", "block", "position", "doc_id", "from_token", "to_token", "tokens", "rest"])  # noqa: B023

            for doc, source, at, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                words = np.frombuffer(raw.as_py(), kind)
                end, total = len(words), totals[source]
                while at < quota[source] * size:
                    for block in range(at // size, min((at + end - 1) // size + 1, quota[source])):
                        a, b = max(0, block * size - at), min(end, (block + 1) * size - at)
                        c = b
                        while c < end and cont[words[c]]:
                            c += 1
                        for x, y in zip(held, (source, block, at + a - block * size, doc, a, b, words[a:b].tobytes(), words[b:c].tobytes()), strict=True):
                            x.append(y)
                        n += b - a
                    at += total  # noqa: PLW2901
                    if n > 2_000_000:
                        yield out()
                        held, n = [[] for _ in range(8)], 0
            yield out()

    parts = joined.select("doc_id", "source", "at", "tokens").mapInArrow(run, "source string, block long, position int, doc_id long, from_token long, to_token long, tokens binary, rest binary")
    return parts.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("position", "doc_id", "from_token", "to_token", "tokens", "rest"))).alias("pieces"))


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = 1024, shard_slots: int = 4096, seed: int = 7, total_tokens: int | None = None, path: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    The mix has rows (shard, slot, source, use_no, block, tokens, segments), a block of exactly ``block_tokens`` tokens
    each; its segments (position, doc_id, from_token, to_token, rest) say which tokens of which documents it holds, and
    ``rest`` are the tokens after it that end a character begun in it (none as a rule). Each source's share of all tokens
    meets its target share (among the sources that have documents) to within a block, and no document's tokens are
    used more than ``max_repeats`` times: the blocks are cut from a source's tokens said over up to so often, and its slots
    are mapped to them by a pseudorandom permutation. ``use_no`` is the use in which a block begins. The report has rows
    (source, target_share, max_repeats, n_documents, available_tokens, used_tokens, actual_share, mean_uses) for every source
    named in the targets or found in the documents (null for documents without one).

    Sources and targets are compared by ``source_key``. Documents without tokens (null, empty) and those of sources without
    a target aren't used. Repeated rows of a ``doc_id`` count once (the longest), null ids are left out. Targets must
    be one row per source; their number is small by nature and is checked. Empty tables give an empty mix.
    """
    wanted = targets.filter(F.col("source").isNotNull()).select(source_key(F.col("source")), F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(1))).limit(100_001).collect()
    if len(wanted) > 100_000:
        raise ValueError("more than 100,000 targets")
    want = {r[0]: (r[1], r[2]) for r in wanted}
    named = documents.filter("doc_id IS NOT NULL").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    once = tokenised(named, "doc_id", "text", ["source"], path).groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source", "tokens")).alias("x"))
    counted = cut(once.select("doc_id", "x.*"))
    usable = counted.filter(F.col("source").isin(*want) & (F.col("n_tokens") > 0)) if want else counted.filter("false")
    totals = {r[0]: r[1] for r in usable.groupBy("source").agg(F.sum("n_tokens")).collect()}
    quota = {s: n for s, n in quotas(totals, want, block_tokens, total_tokens).items() if n}
    blocks = pack(usable, totals, quota, block_tokens, seed, path)
    spark, names = documents.sparkSession, sorted(quota)
    total_slots = sum(quota.values())
    shards = math.ceil(total_slots / shard_slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wanted_ = batch.column(0).to_pylist()
            for shard, own, first in draw_shards(quota, shard_slots, seed, min(wanted_), max(wanted_) + 1):
                j, which = np.arange(own.sum()), np.repeat(np.arange(len(names)), own)
                g = np.concatenate([np.arange(f, f + n) for f, n in zip(first, own, strict=True)])
                size = np.array([quota[s] for s in names], np.int64)[which]
                block = permuted(g, size, (which + 1) * 7919 + seed)
                slot = permuted(j, np.full(len(j), len(j)), np.full(len(j), shard * 104_729 + seed))
                use = block * block_tokens // np.array([totals[s] for s in names], np.int64)[which] + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), shard, np.int32)), pa.array(slot.astype(np.int32)), pa.array([names[k] for k in which], pa.string()), pa.array(use.astype(np.int32)), pa.array(block)], ["shard", "slot", "source", "use_no", "block"])

    # contiguous shards in each partition, so that a task draws one range of them
    placed = spark.range(0, shards, 1, max(1, min(shards, 8 * spark.sparkContext.defaultParallelism))).mapInArrow(place, "shard int, slot int, source string, use_no int, block long")
    joined = placed.join(blocks, ["source", "block"]).select("shard", "slot", "source", "use_no", "block", F.col("pieces.position").alias("position"), F.col("pieces.doc_id").alias("doc_id"), F.col("pieces.from_token").alias("from_token"), F.col("pieces.to_token").alias("to_token"), F.col("pieces.tokens").alias("tokens"), F.col("pieces.rest").alias("rest"))
    mixed = joined.mapInArrow(unpacked(path), f"shard int, slot int, source string, use_no int, block long, tokens array<int>, segments {SEGMENT}")
    used = spark.createDataFrame([(s, n * block_tokens) for s, n in quota.items()], "source string, used_tokens long")
    have = counted.filter("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("available_tokens"))
    asked = spark.createDataFrame([(s, float(w), int(r)) for s, (w, r) in want.items()], "source string, target_share double, max_repeats int")
    d = have.join(asked, "source", "full").join(used, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    d = d.select("source", "target_share", "max_repeats", zero("n_documents"), zero("available_tokens"), zero("used_tokens"))
    in_all = F.lit(float(max(1, total_slots * block_tokens)))
    report = d.select("*", (F.col("used_tokens") / in_all).alias("actual_share"), F.coalesce(F.col("used_tokens") / F.nullif(F.col("available_tokens"), F.lit(0)), F.lit(0.0)).alias("mean_uses"))
    return mixed, report


def unpacked(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Token ids of blocks as arrays of numbers, and their segments as structs, without a loop over tokens."""

    def numbers(c: list[bytes]) -> pa.Array:
        kind = token_type(path)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in c])]) // np.dtype(kind).itemsize
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(c), kind).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                lists = [b.column(i) for i in range(5, 11)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists[0]])]).astype(np.int32))
                fields = [*(x.flatten() for x in lists[:4]), numbers(lists[5].flatten().to_pylist())]
                segments = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["position", "doc_id", "from_token", "to_token", "rest"]))
                tokens = numbers([b"".join(x) for x in lists[4].to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:5], tokens, segments], ["shard", "slot", "source", "use_no", "block", "tokens", "segments"])

    return run


def mix_texts(mixed: DataFrame, path: str = RANKS) -> DataFrame:
    """Rows (shard, slot, position, doc_id, text): the text of each segment of a mix, from its tokens alone.

    A character that a segment cuts belongs to the segment it begins in, so that the segments of one use of a document
    give its text without loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, cont = encoding(path), goes_on(path)
        for batch in batches:
            at, out = [], ([], [], [])
            for r, (tokens, segments) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                ids, place = tokens.values.to_numpy(), 0
                for s in segments.as_py():
                    own = ids[place : place + s["to_token"] - s["from_token"]]
                    place += len(own)
                    k = 0
                    while s["from_token"] and k < len(own) and cont[own[k]]:
                        k += 1
                    at.append(r)
                    text = b"".join(enc.decode_tokens_bytes([*own[k:].tolist(), *(s["rest"] if k < len(own) else [])])).decode("utf-8", "replace")
                    for x, y in zip(out, (s["position"], s["doc_id"], text), strict=True):
                        x.append(y)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.string()), strict=True))], ["shard", "slot", "position", "doc_id", "text"])

    return mixed.select("shard", "slot", "tokens", "segments").mapInArrow(run, "shard int, slot int, position int, doc_id long, text string")


def check_mix(mixed: DataFrame, report: DataFrame, block_tokens: int = 1024) -> DataFrame:
    """Rows (source, n_documents, meets_target, within_repeats, none_twice, full_blocks): what a mix promises, from the mix itself.

    ``meets_target``: the source's tokens in the mix are within a block of its share of all (a source without target or
    documents has none). ``within_repeats``: none of its tokens is used more often than allowed; ``none_twice``: a
    document's uses of any token differ by one at most, so that none comes again before all have come. Tokens are
    told apart by the ends of the segments they lie in, not one by one.
    """
    sized = mixed.select("source", F.size("tokens").alias("n"), F.explode("segments").alias("s"))
    spans = sized.select("source", "s.doc_id", F.explode(F.array(F.struct(F.col("s.from_token").alias("t"), F.lit(1).alias("d")), F.struct(F.col("s.to_token").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    steps = spans.groupBy("source", "doc_id", "e.t").agg(F.sum("e.d").alias("d"))
    uses = steps.withColumn("uses", F.sum("d").over(Window.partitionBy("doc_id").orderBy("t"))).withColumn("next", F.lead("t").over(Window.partitionBy("doc_id").orderBy("t"))).filter("next > t")
    most = uses.groupBy("source").agg(F.max("uses").alias("most"), F.min("uses").alias("least"))
    sums = mixed.groupBy("source").agg(F.sum(F.size("tokens")).alias("tokens"), F.min(F.size("tokens") == block_tokens).alias("full"))
    usable = (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0)
    scale, in_all = report.agg(F.sum(F.when(usable, F.col("target_share"))), F.sum("used_tokens")).first()
    aim = F.when(usable, F.coalesce("target_share", F.lit(0.0)) / F.lit(scale or 1.0) * F.lit(in_all or 0)).otherwise(0.0)
    tokens = F.coalesce("tokens", F.lit(0))
    d = report.join(sums, "source", "left").join(most, "source", "left")
    return d.select("source", "n_documents", ((F.abs(tokens - aim) <= block_tokens) & (tokens == F.col("used_tokens"))).alias("meets_target"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("within_repeats"), F.coalesce(F.col("most") - F.col("least") <= 1, F.lit(True)).alias("none_twice"), F.coalesce("full", F.lit(True)).alias("full_blocks"))
