"""Evaluation texts leaking into training text (problem 6)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutor.sources.tables import cut, spread

_JOIN = re.compile("\u00ad|-[ \\t]*\\r?\\n[ \\t]*")
_WORD = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """The words of a text, in lower case, with one space before, between and after them.

    Soft hyphens are dropped and a hyphen at a line's end is removed with the line break; words are runs of letters
    or digits.
    """
    t = text.lower()
    if "\u00ad" in t:
        t = t.replace("\u00ad", "")
    if "-" in t:
        t = _JOIN.sub("", t)
    return f" {' '.join(_WORD.findall(t))} "


def word_places(text: str) -> list[tuple[int, int]]:
    """Begin and end in the original text of each word of ``normalise(text)``."""
    if len(text.lower()) != len(text):  # a character whose lower case is longer
        low = [c.lower() for c in text]
        back = [i for i, c in enumerate(low) for _ in c]
        return [(back[a], back[b - 1] + 1) for a, b in word_places("".join(low))]
    t, kept, last = text.lower().replace("\u00ad", "\0"), [], 0
    for m in re.finditer("\0|-[ \\t\0]*\\r?\\n[ \\t\0]*" if "\0" in t else _JOIN, t):
        kept.append((last, m.start()))
        last = m.end()
    kept.append((last, len(t)))
    joined = "".join(t[a:b] for a, b in kept)
    heads, n = [], 0
    for a, b in kept:
        heads.append(n)
        n += b - a

    def back(p: int) -> int:
        k = bisect_right(heads, p) - 1
        while kept[k][1] - kept[k][0] == 0:
            k -= 1
        return kept[k][0] + p - heads[k]

    return [(back(m.start()), back(m.end() - 1) + 1) for m in _WORD.finditer(joined)]


def build_automaton(items: list[tuple[object, list[str]]], window: int) -> ahocorasick.Automaton:
    """One automaton over the items' blocks of ``window // 2`` words; a block's value lists (item's place, word's place).

    Any ``window`` consecutive words of an item hold a whole block, so no passage of that length is missed, and
    the automaton has about one character for each of the items.
    """
    block, where = window // 2, {}
    for i, (_, words) in enumerate(items):
        if len(words) >= window:
            for k in range(0, len(words) - block + 1, block):
                where.setdefault(f" {' '.join(words[k : k + block])} ", []).append((i, k))
    auto = ahocorasick.Automaton()
    for pattern, places in where.items():
        auto.add_word(pattern, (len(pattern), places))
    if where:
        auto.make_automaton()
    return auto


def scan(text: str, auto: ahocorasick.Automaton, items: list[tuple[object, list[str]]], window: int) -> dict[int, list[tuple[int, int, int]]]:
    """Per item (by place) the runs (word in the text, word in the item, length) of at least ``window`` equal words."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    norm = normalise(text)
    hits = list(auto.iter(norm)) if len(auto) else []
    if not hits:
        return found
    words = norm.split()
    begins, p = [], 1
    for w in words:
        begins.append(p)
        p += len(w) + 1
    reached: dict[tuple[int, int], int] = {}
    for end, (length, places) in hits:
        at = bisect_right(begins, end - length + 2) - 1
        for i, k in places:
            if reached.get((i, at - k), -1) > at:
                continue
            own, a, b = items[i][1], 0, 0
            while at - a > 0 and k - a > 0 and words[at - a - 1] == own[k - a - 1]:
                a += 1
            while at + b < len(words) and k + b < len(own) and words[at + b] == own[k + b]:
                b += 1
            reached[i, at - k] = at + b
            if a + b >= window:
                found.setdefault(i, []).append((at - a, k - a, a + b))
    return found


def find_leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = 12, max_item_chars: int = 4_000_000) -> DataFrame:
    """Rows (key, item_key, n_runs, longest_run, item_share, start_at, end_at): each text with each item it holds.

    A text holds an item if at least ``window`` consecutive words of the item occur in it; ``longest_run`` counts words,
    ``item_share`` is the share of the item's words found, ``start_at`` and ``end_at`` bound the longest run (the first
    of equals) in the original text, in code points. The items go to each task as one Aho-Corasick automaton, so their
    size is checked first. A set of more than ``max_item_chars`` characters (some 400 MB as an automaton) is split by item
    into several scans, which together find the same: one part at a time is read, sent out, scanned for and dropped again, so
    that neither the driver nor a task ever holds more. Null and empty texts hold nothing, items of fewer than ``window`` words are in
    none; a null key of an item is kept. Repeated rows give repeated results; repeated items are scanned for once.
    """
    own = items.select(item_key, item_text).filter(F.col(item_text).isNotNull()).distinct()
    size = own.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    parts = max(1, -(-size // max_item_chars))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((df, key), (items, item_key))]
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, n_runs int, longest_run int, item_share double, start_at long, end_at long"
    out = None
    for part in range(parts):
        mine = own.filter(F.pmod(F.xxhash64(item_key, item_text), F.lit(parts)) == part) if parts > 1 else own
        shared = df.sparkSession.sparkContext.broadcast([(r[0], normalise(r[1]).split()) for r in mine.sort(item_key, item_text).collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            auto = build_automaton(shared.value, window)
            for batch in batches:
                rows, out = [], []
                for r, t in enumerate(batch.column(1)):
                    t = t.as_py()
                    for i, runs in (scan(t, auto, shared.value, window) if t else {}).items():
                        places = word_places(t)
                        first, _, longest = min(runs, key=lambda x: (-x[2], x[0]))
                        held = len({w for _, k, n in runs for w in range(k, k + n)})
                        rows.append(r)
                        out.append((shared.value[i][0], len(runs), longest, held / len(shared.value[i][1]), places[first][0], places[first + longest - 1][1]))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                types = [items_type, pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

        names = [key, item_key, "n_runs", "longest_run", "item_share", "start_at", "end_at"]
        items_type = _arrow(items, item_key)
        found = spread(df.select(key, text)).mapInArrow(run, schema)
        if parts > 1:
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
