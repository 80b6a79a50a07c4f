"""Splitting oversized ordinance texts at natural boundaries (problem 1)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from statutor.sources.tables import spread

# The words that open a section heading.
HEADING_WORDS = ("section", "sections", "sec", "secs", "seksyon", "seksiyon", "article", "§")
#: Strengths of boundaries, strongest first. A piece begins at the strongest one near its target.
SECTION, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, ANYWHERE = 6, 5, 4, 3, 2, 1, 0
KINDS = ("anywhere", "word", "clause", "sentence", "line", "paragraph", "section")

_WORDS = "|".join(w if w == "§" else rf"\b{w}\b" for w in HEADING_WORDS)
_HEADING = re.compile(rf"(?:{_WORDS})\.?[ \t]*(?P<number>[0-9OolI]*[0-9][0-9OolI]*|[IVXLC]+)(?:(?P<mark>[ \t]*[.:][-–—]?|[ \t]+[-–—])(?=\s)|\b)", re.IGNORECASE)
_REFERENCE = re.compile(r"\s*(?:[a-z,;()]|(?i:ordinance|resolution|republic|act|of|this|also)\b)")
_SENTENCE_BEGINS = re.compile(r"[ \t]+[A-Z]")
_PARAGRAPH = re.compile(r"\n[ \t]*(?:\n[ \t]*)+")
_LINE = re.compile(r"\n[ \t]*")
_SENTENCE = re.compile(r"[.!?][\"”’)]*\s+(?=[\"“‘(]?[A-Z§0-9])")
_CLAUSE = re.compile(r"[;:,]\s+")
_WORD = re.compile(r"\s+")
_ENDS = frozenset(".;:!?”\"’)-–—")


def _value(number: str) -> int:
    """The value of an Arabic (with O, l, I misread for digits) or Roman number."""
    if any(c.isdigit() for c in number):
        return int(number.translate(str.maketrans("OolI", "0011")))
    each = [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}[c] for c in number]
    return sum(-a if b > a else a for a, b in zip(each, [*each[1:], 0], strict=True))


def _before(text: str, at: int) -> tuple[bool, str]:
    """Whether ``at`` begins a line, and the last character before it that isn't white space."""
    j = at
    while j and text[j - 1] in " \t":
        j -= 1
    k = j
    while k and text[k - 1].isspace():
        k -= 1
    return j == 0 or text[j - 1] == "\n", text[k - 1 : k]


def section_starts(text: str) -> list[int]:
    """Where the ordinance's own sections begin (code points before the heading).

    A heading is a heading word, a number and a mark (``.`` ``:`` ``.-`` ``–``), beginning a line or following the end
    of a sentence; "Section 7 of ..." has no mark and is a reference. What stands inside a quotation that is closed
    again belongs to another instrument; a quotation counts as closed only if its closing mark comes before the next
    opening one, so a lost mark doesn't hide the sections after it. A heading without its mark, at the beginning of a line or
    of a sentence, counts if its number is missing beside one that is there, and it stands in the numbers' order; that number
    is there for the next one then.
    """
    marks = [(m.start(), m[0] == "“") for m in re.finditer("[“”]", text)]
    places = [p for p, _ in marks]
    out, damaged = {}, []
    for m in _HEADING.finditer(text):
        if not any(c.isdigit() for c in m["number"]) and not m["number"].isupper():
            continue
        i = bisect_left(places, m.start())
        if 0 < i < len(marks) and marks[i - 1][1] and not marks[i][1]:
            continue
        own_line, before = _before(text, m.start())
        if before == "“":
            continue
        if not m["mark"]:
            if not _REFERENCE.match(text, m.end()) and (own_line or (before in _ENDS and _SENTENCE_BEGINS.match(text, m.end()))):
                damaged.append((m.start(), _value(m["number"])))
        elif own_line or before in _ENDS or not m[0][0].islower():
            out[m.start()] = _value(m["number"])
    first, last = {}, {}
    for at, n in sorted(out.items()):
        first.setdefault(n, at)
        last[n] = at
    more = len(damaged)
    while more:
        more, rest = 0, []
        for at, n in damaged:
            if n not in first and (n - 1 in first or n + 1 in first) and first.get(n - 1, -1) < at < last.get(n + 1, len(text)):
                out[at] = first[n] = last[n] = at
                more += 1
            else:
                rest.append((at, n))
        damaged = rest
    return sorted(out)


def boundaries(text: str, sections: list[int]) -> list[list[int]]:
    """Sorted places where a piece may begin, by strength from ``WORD`` to ``SECTION``."""
    found = [[m.end() for m in p.finditer(text)] for p in (_WORD, _CLAUSE, _SENTENCE, _LINE, _PARAGRAPH)]
    return [*found, sections]


def _snap(bounds: list[list[int]], target: int, low: int, high: int, reach: int) -> tuple[int, int]:
    """The strongest boundary within ``reach`` of the target, the nearest of equals, between low and high; its strength."""
    a, b = max(low, target - reach), min(high, target + reach)
    for strength in range(SECTION, ANYWHERE, -1):
        places = bounds[strength - 1]
        own = places[bisect_left(places, a) : bisect_right(places, b)]
        if own:
            return min(own, key=lambda p: (abs(p - target), p)), strength
    return max(low, min(high, target)), ANYWHERE


def balanced_cuts(length: int, bounds: list[list[int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(place, strength) of each piece's beginning, the first at 0.

    The least number of pieces that could do, targets at equal distances, each snapped to the strongest boundary
    nearby; while a piece with its overlap would exceed ``limit``, one piece is added. Enough pieces always
    do, since at a reach of 0 the targets themselves are cut at.
    """
    if length <= limit:
        return [(0, SECTION)]
    own = limit - overlap
    count = -(-(length - overlap) // own)
    while True:
        step = length / count
        reach = int(min(step / 2 - 1, max(0, own - step) + step / 4)) if step >= 4 else 0
        cuts = [(0, SECTION)]
        for k in range(1, count):
            low, high = cuts[-1][0] + 1, length - 1
            high = min(high, cuts[-1][0] + own)
            cuts.append(_snap(bounds, round(k * step), low, max(low, high), reach))
        ends = [c[0] for c in cuts[1:]] + [length]
        if all(e - max(0, c[0] - overlap) <= limit for c, e in zip(cuts, ends, strict=True)):
            return cuts
        count += 1


def split_text(text: str, limit: int, overlap: int) -> list[dict]:
    """The pieces of one text; their own parts, ``start`` to ``end``, cover it without gap or overlap."""
    sections = section_starts(text)
    cuts = balanced_cuts(len(text), boundaries(text, sections) if len(text) > limit else [], limit, overlap)
    out = []
    for k, (start, strength) in enumerate(cuts):
        end = cuts[k + 1][0] if k + 1 < len(cuts) else len(text)
        first = max(0, start - overlap) if k else 0
        out.append({"piece_no": k, "n_pieces": len(cuts), "piece_start": first, "start_at": start, "end_at": end, "begins_at": KINDS[strength], "section_starts": sections[bisect_left(sections, start) : bisect_left(sections, end)], "piece_text": text[first:end]})
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 6000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Pieces of at most ``limit`` characters of each text.

    Rows (key, piece_no, n_pieces, piece_start, start_at, end_at, begins_at, section_starts, piece_text): a piece is
    ``text[piece_start:end_at]``; its own part begins at ``start_at``, at a boundary of kind ``begins_at``, and what
    precedes it repeats exactly ``overlap`` characters of the piece before (fewer only where the text itself
    begins). ``section_starts`` are the places in the own part where a section of the text itself begins. A text
    within the limit is one piece; an empty one is one empty piece; a null text has no pieces. Repeated rows are split
    each on their own, other columns are left out. Places count code points. Rows are handled one by one, with no
    shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must lie between 0 and limit")
    kind = df.schema[key].dataType.simpleString()
    fields = [("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("piece_start", pa.int64()), ("start_at", pa.int64()), ("end_at", pa.int64()), ("begins_at", pa.string()), ("section_starts", pa.list_(pa.int64())), *[("piece_text", pa.string())] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, columns, size = batch.column(0), [], {n: [] for n, _ in fields}, 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([keys.take(pa.array(held, pa.int64())), *(pa.array(columns[n], t) for n, t in fields)], [key, *columns])  # noqa: B023

            for i, t in enumerate(batch.column(1)):
                if (t := t.as_py()) is None:
                    continue
                for piece in split_text(t, limit, overlap):
                    held.append(i)
                    size += len(piece["piece_text"])
                    for n, _ in fields:
                        columns[n].append(piece[n])
                if size > 16_000_000:
                    yield out()
                    held, columns, size = [], {n: [] for n, _ in fields}, 0
            yield out()

    names = {"piece_no": "int", "n_pieces": "int", "piece_start": "long", "start_at": "long", "end_at": "long", "begins_at": "string", "section_starts": "array<long>", "piece_text": "string"}
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} {names[n]}" for n, _ in fields))


def section_audit(corpus_index: DataFrame, clean_text: DataFrame, sections: DataFrame) -> DataFrame:
    """Each record of ``corpus_index`` with its ``section_count`` beside the number of sections found in its text.

    Repeated rows of a ``scan_seq`` count once. A record whose path is null or leads to no text has a null ``n_sections``.
    """
    per_text = sections.groupBy("text_id").agg(F.sum(F.size("section_starts")).cast("long").alias("n_sections"), F.count("*").alias("n_pieces"))
    found = clean_text.select("text_id", "clean_text_path").join(per_text, "text_id")
    ask = corpus_index.filter("scan_seq IS NOT NULL").groupBy("scan_seq").agg(F.max("clean_text_path").alias("clean_text_path"), F.max("section_count").alias("section_count"))
    agree: Column = F.col("section_count").eqNullSafe(F.col("n_sections"))
    return ask.join(found, "clean_text_path", "left").select("scan_seq", "text_id", "section_count", "n_sections", "n_pieces", agree.alias("agrees"))
