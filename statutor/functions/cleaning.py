"""Conservative cleaning of a document's text, with counts of what it changed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from statutor.functions import fixed as X
from statutor.functions.text import let, n_words, strip

_QUOTES = ("‘’“”–—﻿", "''\"\"--")  # the last has no counterpart and is deleted
_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition. Only texts that it may change go through Python: those with characters beyond ASCII
    other than the quotes, dashes and signs that stay as they are and are common here."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F‘’“”–—‐§¬\xAD]"), text)), text)


#: Words whose repair finds the right spelling too, so that nearly every text has them.
_COMMON = ("SERIES", "SECTION")


def repaired(text: Column) -> Column:
    """Compatible characters, plain quotes and dashes, and the words put right that this corpus often has misread."""
    rare = [(seen, right) for seen, right in X.OCR_REPAIRS if right not in _COMMON]

    def put_right(t: Column) -> Column:
        """Of the words that few texts have, one pass says whether there are any."""
        few = t
        for seen, right in rare:
            few = F.regexp_replace(few, X.FLAGS + seen, right)
        return F.when(t.rlike(X.FLAGS + "|".join(seen for seen, _ in rare)), few).otherwise(t)

    t = let(F.translate(nfkc(text), *_QUOTES), put_right)
    for seen, right in X.OCR_REPAIRS:
        if right in _COMMON:
            t = F.regexp_replace(t, X.FLAGS + seen, right)
    return t


def clean(text: Column) -> Column:
    """``struct<clean, clean_char_count, clean_word_count, removed_chars, dropped_lines, rejoined_words, noise_line_ratio>``.

    Words broken at a line's end are rejoined; page furniture, masthead lines and lines of stray glyphs are dropped;
    runs of blanks and of empty lines are shortened. Null and empty texts give an empty text and zeros.
    """
    furniture = lambda x: x.rlike(X.FLAGS + X.PAGE_FURNITURE)
    masthead = lambda x: F.btrim(F.lower(x), F.lit(".,:;-")).isin(*X.MASTHEADS)
    noise = lambda x: x.rlike("(?d)" + X.NOISE_LINE)
    kind = lambda x: F.when(x == "", "kept").when(furniture(x) | masthead(x), "dropped").when(noise(x), "noise").otherwise("kept")

    def lines(joined: Column) -> Column:
        parts = let(F.split(joined, _LINE_ENDS, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
        return F.transform(F.transform(parts, strip), lambda x: F.struct(x.alias("x"), kind(x).alias("k")))

    def counted(fixed: Column) -> Column:
        joined = F.regexp_replace(fixed, X.FLAGS + X.HYPHEN_BREAK, "$1$2")
        return F.struct(F.regexp_count(fixed, F.lit(X.FLAGS + X.HYPHEN_BREAK)).alias("rejoined"), lines(joined).alias("lines"))

    def rebuilt(c: Column) -> Column:
        kept = F.transform(F.filter(c["lines"], lambda x: x["k"] == "kept"), lambda x: F.regexp_replace(x["x"], "[ \t ]{2,}", " "))
        return F.struct(c["rejoined"].alias("rejoined"), c["lines"].alias("lines"), strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")).alias("out"))

    def result(r: Column, t: Column) -> Column:
        count = lambda *k: F.size(F.filter(r["lines"], lambda x: x["k"].isin(*k)))
        return F.struct(
            r["out"].alias("clean"), F.length(r["out"]).alias("clean_char_count"), n_words(r["out"]).alias("clean_word_count"), (F.length(t) - F.length(r["out"])).alias("removed_chars"),
            count("dropped", "noise").alias("dropped_lines"), r["rejoined"].alias("rejoined_words"),
            F.round(count("noise") / F.greatest(F.lit(1), F.size(r["lines"])), 4).alias("noise_line_ratio"),
        )

    t = F.coalesce(text, F.lit(""))
    return let(let(let(repaired(t), counted), rebuilt), lambda r: result(r, t))
