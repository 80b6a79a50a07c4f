"""Best representative of each duplicate group (problem 4)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutor.llm.common import cut, fold_width, is_blank
from statutor.llm.components import components

# Stand-ins for "no title", after everything but letters is removed.
NO_TITLE = ("", "na", "none", "null", "nil", "nan", "tba", "tbd", "untitled", "unnamed", "unknown", "notitle", "titleunknown", "notavailable")


def real_title(title: Column) -> Column:
    """True where the title is neither null, blank nor a stand-in for "no title"."""
    return F.coalesce(~F.regexp_replace(F.lower(title), r"(?U)[\W\d_]+", "").isin(*NO_TITLE), F.lit(False))


def number_key(number: Column) -> Column:
    """Number and year of an ordinance number however it is written, as ``number-year``; null where it is missing.

    Letters that scanners put for digits (O, o for 0; l, I, | for 1) count as the digit where they stand beside digits
    or make up the end of the number. A two-digit year up to 35 is in the 2000s, a later one in the 1900s.
    """
    t = F.regexp_replace(fold_width(F.coalesce(number, F.lit(""))), r"(?i)ordinances?|\bord\b\.?|\bnos?\b\.?|\bnumber\b|series|\bof\b|[#,]", " ")
    t = F.regexp_replace(F.translate(t, "–—‐‑_/", "------"), r"\s*-\s*|(?<=[0-9OolI|])\s+(?=[0-9OolI|])", "-")
    digit = "[0-9OolI|]"
    part = lambda k: F.translate(F.regexp_extract(t, rf"^\D*?({digit}{{1,6}})-+({digit}{{2}}|{digit}{{4}})\W*$", k), "OolI|", "00111")
    n, y = part(1).try_cast("int"), part(2).try_cast("int")
    year = F.when(y >= 100, y).when(y <= 35, y + 2000).otherwise(y + 1900)
    return F.when(n.isNotNull() & y.isNotNull(), F.concat_ws("-", n.cast("string"), year.cast("string")))


def group_records(df: DataFrame, seq: str, keys: Mapping[str, Column]) -> DataFrame:
    """``df`` with ``group_seq``: the smallest ``seq`` of the records tied to this one, directly or through others.

    Two records are tied if any of ``keys`` is equal; a null key ties nothing. Keys are replaced by the smallest
    ``seq`` that has them (an aggregation with partial minima), so what the component search sees is one edge for each
    distinct pair of keys, however many records a key holds. A record without any key is its own group; rows with a
    null ``seq`` are left out, since nothing can name them. A ``group_seq`` that is there already is replaced.
    """
    d = df.drop("group_seq").filter(F.col(seq).isNotNull())
    ids = d.select(F.col(seq).alias("_seq"), *(k.alias(f"_k{i}") for i, k in enumerate(keys.values())))
    reps = [f"_r{i}" for i in range(len(keys))]
    for i, r in enumerate(reps):
        least = ids.filter(F.col(f"_k{i}").isNotNull()).groupBy(f"_k{i}").agg(F.min("_seq").alias(r))
        ids = ids.join(least, f"_k{i}", "left").drop(f"_k{i}")
    ids = cut(ids.withColumn("_any", F.coalesce(*reps, F.col("_seq"))))
    edges = None
    for r in reps:
        pairs = ids.filter(F.col(r).isNotNull()).select(F.col("_any").alias("u"), F.col(r).alias("v")).distinct()
        edges = pairs if edges is None else edges.union(pairs)
    found = components(edges.distinct())
    member = ids.join(found, ids["_any"] == found["node"], "left").groupBy("_seq").agg(F.min(F.coalesce("component", "_any", "_seq")).alias("group_seq"))
    return d.join(member, d[seq] == member["_seq"]).drop("_seq")


def survivors(df: DataFrame, group: str, order: list[Column], seq: str, fields: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One row per group, each field taken from the best record that has it, in a single aggregation.

    ``order`` ranks records, greatest first; a null ranks last. Ties go to the smaller ``seq``. ``fields`` maps a name
    to (is it given, value). Every field becomes the maximum of the composite (given, rank, value), so partial maxima
    are merged before the shuffle and a hot group is never gathered. Result: group, n_records, best_seq, and for each
    field its value and ``<field>_seq``, the record it came from (null and 0 where no record gives it). Nulls in
    ``group`` form no group. Repeated rows count once in n_records.
    """
    rank = F.struct(*(x for i, c in enumerate(order) for x in (c.isNotNull().alias(f"has{i}"), c.alias(f"by{i}"))), (-F.col(seq)).alias("low"))
    d = df.filter(F.col(group).isNotNull()).select(F.col(group), F.col(seq).alias("_seq"), rank.alias("_rank"), *(x.alias(f"_{p}_{k}") for k, f in fields.items() for p, x in zip("gv", f, strict=True)))
    agg = [F.countDistinct("_seq").alias("n_records"), F.max("_rank").alias("_best")]
    agg += [F.max(F.when(F.col(f"_g_{k}"), F.struct(F.col("_rank"), F.col(f"_v_{k}").alias("value")))).alias(f"_f_{k}") for k in fields]
    out = d.groupBy(group).agg(*agg)
    at = lambda c: F.coalesce(-F.col(f"{c}.low"), F.lit(0))
    return out.select(group, "n_records", at("_best").alias("best_seq"), *(x for k in fields for x in (F.col(f"_f_{k}.value").alias(k), at(f"_f_{k}._rank").alias(f"{k}_seq"))))


def ordinance_groups(summary: DataFrame) -> DataFrame:
    """The summary with ``group_seq``, tied by ordinance number or by hash (unless ``char_count`` is 0)."""
    h = F.lower(F.trim("file_hash"))
    tie = F.when(~is_blank(F.col("file_hash")) & ~F.coalesce(F.col("char_count") == 0, F.lit(False)), h)
    return group_records(summary, "scan_seq", {"number": number_key(F.col("ordinance_number")), "hash": tie})


def ordinance_survivors(summary: DataFrame) -> DataFrame:
    """One record per ordinance, field by field from the best of its records.

    A confidence outside 0 to 1 and a page count below 1 count as missing, for the rank and as values; text counts as
    given if it isn't blank, a title if it is no stand-in. Columns whose names clash with the result's are renamed
    by the caller.
    """
    d = ordinance_groups(summary)
    score = F.when(F.col("confidence_score").between(0, 1), F.col("confidence_score"))
    pages = F.when(F.col("page_count") >= 1, F.col("page_count"))
    values = {c: F.col(c) for c in summary.columns if c not in ("scan_seq", "group_seq", "best_seq", "n_records")} | {"confidence_score": score, "page_count": pages}
    given = {c: ~is_blank(F.col(c)) if t == "string" else values[c].isNotNull() for c, t in summary.dtypes if c in values}
    given["title"] = real_title(F.col("title"))
    return survivors(d, "group_seq", [score, pages, F.col("run_at")], "scan_seq", {c: (given[c], values[c]) for c in values})
