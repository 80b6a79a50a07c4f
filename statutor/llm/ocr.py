"""Repairing text from scanned pages into continuous paragraphs (problem 2)."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutor.llm.common import cut, is_blank
from statutor.llm.ocr_lines import LineModel, Page, split_labels, train
from statutor.sources.tables import spread

# What scanners show for a glyph, and what it may have been.
CONFUSIONS = {
    "0": "o", "1": "i l", "5": "s", "@": "a", "4": "a", "9": "g", "6": "b", "8": "b", "3": "e", "7": "t", "2": "z", "$": "s", "|": "l i", "!": "i l",
    "c": "e o", "f": "e", "b": "h", "h": "b", "l": "i t", "i": "l", "o": "c", "d": "cl", "m": "rn n", "n": "m", "u": "ii v", "v": "y",
    "ri": "n", "ii": "u", "cl": "d", "rn": "m", "vv": "w", "li": "h", "fl": "fi", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl",
}
HYPHENS = "-¬­‐‑"
_WORD = re.compile(r"[\w@$|!]+(?:['\-][\w@$|!]+)*")
_TOKEN = re.compile(r"[\w@$|!]+(?:['’‘\-‐‑][\w@$|!]+)*")
_BROKEN = re.compile(rf"([\w@$|!]+(?:['’\-][\w@$|!]+)*)[{HYPHENS}][ \t\r]*$")
_HEAD = re.compile(r"\s*([\w@$|!]+(?:['’\-][\w@$|!]+)*)")
_ODD = re.compile(r"[^\W\d_].*[0-9@$|!]|[0-9@$|!].*[^\W\d_]|[ﬀ-ﬄ]")
_YEAR = re.compile(r"[0-9OolISis]{4}$")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)$|p?\d+[\d.,]*$|[\d\-]+$|[ivxlc]+$")


def year_of(token: str) -> str | None:
    """The year that a token with misread digits stands for, if it has any and is a plausible year."""
    if not _YEAR.match(token) or token.isdigit() or sum(c.isdigit() for c in token) < 2:
        return None
    y = token.translate(str.maketrans("OolISis", "0011515"))
    return y if 1900 <= int(y) <= 2099 else None


ODD_GLYPHS = "0123456789@$|!ﬁﬂﬀﬃﬄ"
_LETTERS = {seen: true.split() for seen, true in CONFUSIONS.items() if seen not in ODD_GLYPHS}
_SEEN: dict[str, list[str]] = defaultdict(list)
for _seen, _options in _LETTERS.items():
    for _true in _options:
        _SEEN[_true].append(_seen)


def _changes(word: str, table: dict[str, list[str]]) -> Iterator[tuple[str, int, int]]:
    """Every single change of ``word`` by ``table``, with where it begins and where its outcome ends."""
    longest = max(map(len, table))
    for i in range(len(word)):
        for size in range(1, min(longest, len(word) - i) + 1):
            for other in table.get(word[i : i + size], ()):
                yield word[:i] + other + word[i + size :], i, i + len(other)


def count_odd(word: str) -> int:
    return sum(c in ODD_GLYPHS for c in word)


def corrections(word: str) -> list[tuple[str, int]]:
    """All that ``word`` may have been, with the number of glyphs changed: every one or two changes of letters apart from
    each other; for a word with odd glyphs all of these, and where there is but one, one change of letters besides.

    The product over odd glyphs doubles with each that may be two letters; ``respell`` asks for it up to three.
    """
    out: dict[str, int] = {}
    odd = count_odd(word)
    if odd:
        parts = [CONFUSIONS[c].split() if c in ODD_GLYPHS else [c] for c in word]
        for x in map("".join, product(*parts)):
            out[x] = odd
        if odd == 1:
            k = next(i for i, c in enumerate(word) if c in ODD_GLYPHS)
            for true in parts[k]:
                for x in [w + true + word[k + 1 :] for w, _, _ in _changes(word[:k], _LETTERS)] + [word[:k] + true + w for w, _, _ in _changes(word[k + 1 :], _LETTERS)]:
                    out.setdefault(x, 2)
    else:
        once = list(_changes(word, _LETTERS))
        for x, _, _ in once:
            out[x] = 1
        for x, _, end in once:
            for y, _, _ in _changes(x[end:], _LETTERS):
                out.setdefault(x[:end] + y, 2)
        out.pop(word, None)
    return sorted(out.items(), key=lambda x: (x[1], x[0]))


def folded(word: str) -> tuple[str, str]:
    """``word`` with its odd glyphs as letters and l as i (the one pair that a glyph may stand for), and the pattern of all it
    may have been: words of that pattern have the same folded form."""
    parts = [CONFUSIONS[c].split() if c in ODD_GLYPHS else [c] for c in word]
    return "".join(x[0] for x in parts).replace("l", "i"), "^" + "".join(x[0] if len(x) == 1 else f"({'|'.join(x)})" for x in parts) + "$"


# Apostrophes and hyphens that stand for the plain ones.
_PLAIN = (("’", "'"), ("‘", "'"), ("‐", "-"), ("‑", "-"))


def plain(text: str) -> str:
    """In lower case, with plain apostrophes and hyphens."""
    t = text.lower()
    if not t.isascii():
        for seen, right in _PLAIN:
            t = t.replace(seen, right)
    return t


def words_of(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def count_chunks(chunks: Counter[str]) -> Counter[str]:
    """Counts of words from counts of what stands between white space; each distinct chunk is taken apart once."""
    out: Counter[str] = Counter()
    for chunk, n in chunks.items():
        for w in _WORD.findall(chunk):
            out[w] += n
    return out


def unrepaired_pages(pages: DataFrame, summary: DataFrame) -> DataFrame:
    """The pages, each once, of OCR and Hybrid records with OCR pages that have no clean text yet.

    Rows (page_id, file_path, page_index, text, scanned): the scanned text or, where that is blank, the digital one.
    Null page ids are left out.
    """
    files = summary.filter(F.col("extraction_method").isin("OCR", "Hybrid") & (F.col("ocr_page_count") > 0) & is_blank(F.col("clean_text_path"))).select("file_path").distinct()
    scanned = ~is_blank(F.col("ocr_text"))
    p = pages.filter("page_id IS NOT NULL").select("page_id", "file_path", F.coalesce("page_index", F.lit(0)).cast("int").alias("page_index"), F.when(scanned, F.col("ocr_text")).otherwise(F.col("digital_text")).alias("text"), scanned.alias("scanned"))
    p = p.filter(~is_blank(F.col("text"))).join(files, "file_path", "left_semi")
    return p.groupBy("page_id").agg(F.max(F.struct("scanned", "file_path", "page_index", "text")).alias("x")).select("page_id", "x.*")


def fit_line_model(pages: DataFrame, clean_text: DataFrame, text: str, files: int = 400, pages_each: int = 10, texts: int = 300, text_chars: int = 100_000) -> LineModel:
    """A line model fitted on a bounded sample: the first ``pages_each`` pages of each of ``files`` files, those of eight
    pages or more before shorter ones, and then in the order of a hash, which show what is furniture; and ``texts`` of the
    repaired texts of up to ``text_chars`` characters, in the order of a hash, which show where paragraphs begin.

    Without repaired texts nothing tells where paragraphs begin, and a page is one.
    """
    scans = pages.filter("scanned")
    sizes = scans.filter(F.col("page_index") < pages_each).groupBy("file_path").agg(F.least(F.lit(8), F.count("*")).alias("_n")).filter("_n >= 3")
    chosen = sizes.orderBy(F.desc("_n"), F.xxhash64("file_path"), "file_path").limit(files).select("file_path")
    rows = scans.filter(F.col("page_index") < pages_each).join(F.broadcast(chosen), "file_path").select("file_path", "page_index", "text", "page_id").dropDuplicates(["file_path", "page_index"]).limit(files * pages_each).collect()
    by_file: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in rows:
        by_file[r[0]].append((r[1], r[2]))
    own = F.col(text)
    known = clean_text.filter(~is_blank(own) & (F.length(own) <= text_chars)).select(own.alias("t")).orderBy(F.xxhash64("t"), "t").limit(texts).collect()
    return train([sorted(v) for _, v in sorted(by_file.items())], [r[0] for r in known])


def label_pages(pages: DataFrame, model: LineModel) -> DataFrame:
    """Adds ``furniture`` (numbers of the lines that belong to the page), ``breaks`` (of those that begin a paragraph),
    ``first_word`` of the body and ``last_line``, the number of its last line. Every line is labelled, many pages at once."""
    shared = pages.sparkSession.sparkContext.broadcast((model.features.ids, model.weights, model.moves))
    names = ["page_id", "file_path", "page_index", "scanned", "text", "furniture", "breaks", "first_word", "last_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LineModel(*shared.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                out: list[list] = [[], [], [], []]
                found = [Page(t.as_py(), i) for t, i in zip(batch.column(4), batch.column(2).to_pylist(), strict=True)]
                for page, labels in zip(found, own.label(found), strict=True):
                    off, body, breaks = split_labels(page, labels)
                    head = _HEAD.match(page.lines[body[0]]) if body else None
                    for x, y in zip(out, (off, breaks, head[1] if head else None, body[-1] if body else None), strict=True):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32())], names)

    kinds = dict(pages.dtypes)
    return pages.select(*names[:5]).mapInArrow(run, f"page_id {kinds['page_id']}, file_path string, page_index int, scanned boolean, text string, furniture array<int>, breaks array<int>, first_word string, last_line int")


def body_lines(text: str, furniture: list[int]) -> list[tuple[int, str]]:
    off = set(furniture)
    return [(i, line) for i, line in enumerate(text.split("\n")) if i not in off and line and not line.isspace()]


def break_up(lines: list[tuple[int, str]], following: str | None, carried: bool = False) -> tuple[list[tuple[int, str]], list[tuple[int, str, str]]]:
    """The body lines without words that go on between lines, and those words as (line, beginning, rest).

    ``following`` is the first word of the next page, if the page ends within a word; ``carried`` says that the page
    before does.
    """
    whole, broken, skip = [], [], carried
    for k, (i, line) in enumerate(lines):
        if skip and (head := _HEAD.match(line)):
            line = line[head.end() :]  # noqa: PLW2901
        skip = False
        if line.rstrip()[-1:] in HYPHENS and (cut_off := _BROKEN.search(line, max(line.rstrip().rfind(x) for x in " \t") + 1)):
            head = _HEAD.match(lines[k + 1][1]) if k + 1 < len(lines) else None
            rest = head[1] if head else following if k + 1 == len(lines) else None
            if rest and (rest[0].isalpha() or _ODD.match(rest)):
                broken.append((i, *(plain(x) for x in (cut_off[1], rest))))
                line = line[: cut_off.start()]  # noqa: PLW2901
                skip = True
        whole.append((i, line))
    return whole, broken


def count_words(pages: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Rows (word, n): how often each word stands unbroken in the pages' bodies and in ``texts``, counted over all of them.

    Counts are summed in each batch before they are shuffled. Words broken at a line's end are there in both spellings
    with a count of 0, so that corrections are sought for them too.
    """

    def from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            chunks: Counter[str] = Counter()
            for t, off, after, carried in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                whole, broken = break_up(body_lines(t.as_py(), off), after, carried)
                chunks.update(plain("\n".join(line for _, line in whole)).split())
                for _, w, rest in broken:
                    n[w + rest] += 0
                    n[f"{w}-{rest}"] += 0
            n.update(count_chunks(chunks))
            yield _counts(n)

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            for t in batch.column(0):
                n.update(plain(t.as_py() or "").split())
            yield _counts(count_chunks(n))

    schema = "word string, n long"
    both = pages.select("text", "furniture", "following", "carried").mapInArrow(from_pages, schema).unionByName(spread(texts.select(text)).mapInArrow(from_texts, schema))
    return both.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(n: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])


def respell(words: DataFrame, times: float = 4.0, common: int = 20_000) -> DataFrame:
    """Rows (word, n, right): every word with its right spelling, null where it is right as it stands or unknown.

    Words have three to 60 characters; what is longer is no word. A word is misread if one of its ``corrections`` occurs at least ``times`` as often; one with digits or signs among its
    letters if any correction occurs more often than it. All corrections are looked up, by joins, so the vocabulary isn't held
    in one place: two changes of letters meet halfway (a change of the word seen is a change of the right one undone), and
    words with more than three odd glyphs by their folded form. For an odd word none of whose corrections occurs (a rare
    name), the correction of up to three glyphs with the likeliest letter sequences is taken, by trigrams of the ``common``
    most frequent words (a bounded sample).
    """
    top = [r[0] for r in words.filter("n > 1 AND word RLIKE '^[a-z]{4,}$'").orderBy(F.desc("n"), "word").limit(common).collect()]
    trigrams = Counter(f"^{w}$"[i : i + 3] for w in top for i in range(len(w)))
    shared = words.sparkSession.sparkContext.broadcast(dict(trigrams))

    def asked_for(w: str) -> bool:
        return 3 <= len(w) <= 60 and not _ORDINAL.match(w) and any(c.isalpha() for c in w) and not year_of(w)

    def over(rows: Callable[[str, int], Iterator[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        fields = [pa.field(k, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for k, t in (x.split() for x in schema.split(", "))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[] for _ in fields]
                for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for row in rows(w, n):
                        for x, y in zip(out, row, strict=True):
                            x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, fields, strict=True)], schema=pa.schema(fields))

        return run

    def few_odd(w: str, n: int) -> Iterator[tuple]:
        if asked_for(w) and 1 <= count_odd(w) <= 3:
            yield from ((w, n, c, edits) for c, edits in corrections(w))

    def many_odd(w: str, n: int) -> Iterator[tuple]:
        if asked_for(w) and (odd := count_odd(w)) > 3:
            yield (w, n, *folded(w), odd)

    def seen_changed(w: str, n: int) -> Iterator[tuple]:
        if asked_for(w) and not count_odd(w):
            yield from ((x, w, n, end) for x, _, end in _changes(w, _LETTERS))

    def right_undone(w: str, m: int) -> Iterator[tuple]:
        if m >= 2 and len(w) <= 62 and not count_odd(w):
            yield w, w, m, 1000, 1
            yield from ((x, w, m, at, 2) for x, at, _ in _changes(w, _SEEN))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        for batch in batches:
            kept: list[list[str]] = [[], []]
            for w, n, best, others in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                odd, right = bool(_ODD.search(w)), None
                if best["m"] > 0 and best["m"] >= (n if odd else max(2, times * n)):
                    right = best["right"]
                elif odd and others:
                    right = max(others, key=lambda c: (sum(_log(grams.get(f"^{c}$"[i : i + 3], 0)) for i in range(len(c))) / len(c), c))
                if right:
                    kept[0].append(w)
                    kept[1].append(right)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in kept], ["word", "right"])

    def rows_of(rows: Callable[[str, int], Iterator[tuple]], schema: str) -> DataFrame:
        return words.select("word", "n").mapInArrow(over(rows, schema), schema)

    known = words.filter("n > 0").select(F.col("word").alias("right"), F.col("n").alias("m"))
    columns = ("word", "n", "right", "m", "edits")
    odd = rows_of(few_odd, "word string, n long, right string, edits int").join(known, "right", "left").select(*columns)
    more = rows_of(many_odd, "word string, n long, folded string, pattern string, edits int").join(known.withColumn("folded", F.translate("right", "l", "i")), "folded").filter(F.regexp_like("right", F.col("pattern"))).select(*columns)
    halves = rows_of(seen_changed, "half string, word string, n long, end int").join(rows_of(right_undone, "half string, right string, m long, at int, edits int"), "half")
    letters = halves.filter((F.col("at") >= F.col("end")) & (F.col("right") != F.col("word")) & (F.col("m") >= F.greatest(F.lit(2.0), F.lit(times) * F.col("n")))).select(*columns)
    every = odd.withColumn("other", F.col("right")).unionByName(more.unionByName(letters).withColumn("other", F.lit(None).cast("string")))
    d = every.groupBy("word").agg(F.max("n").alias("n"), F.max(F.struct(F.coalesce("m", F.lit(0)).alias("m"), (-F.col("edits")).alias("few"), "right")).alias("best"), F.collect_list("other").alias("others"))
    chosen = d.select("word", "n", "best", "others").mapInArrow(choose, "word string, right string")
    return words.join(chosen, "word", "left").select("word", "n", "right")


def _log(n: int) -> float:
    return math.log(n + 0.01)


class RepairedPages:
    """Scanned pages with their furniture found, their broken words joined and their misread words put right.

    Only pages of records that await repair are taken, each ``page_id`` once. Null and blank pages have no lines; empty
    tables give empty results. Lines are counted from 0, blank ones included.
    """

    def __init__(self, pages: DataFrame, summary: DataFrame, clean_text: DataFrame, known: int = 50_000) -> None:
        own = unrepaired_pages(pages, summary)
        own = cut(own)
        labelled = cut(label_pages(own, fit_line_model(own, clean_text, "clean_text")))
        after = labelled.filter("first_word IS NOT NULL").groupBy("file_path", (F.col("page_index") - 1).alias("page_index")).agg(F.min("first_word").alias("following"))
        last = F.element_at(F.split("text", "\n"), F.col("last_line") + 1)
        asks = labelled.filter(last.rlike(rf"(?U)\w[{HYPHENS}]\s*$")).select("page_id", "file_path", "page_index").join(after, ["file_path", "page_index"])
        before = asks.select("file_path", (F.col("page_index") + 1).alias("page_index"), F.lit(True).alias("carried")).distinct()
        carried = labelled.select("page_id", "file_path", "page_index").join(before, ["file_path", "page_index"]).select("page_id", "carried")
        # both by page, so that the texts are shuffled once
        beside = asks.select("page_id", "following").join(carried, "page_id", "full")
        self.pages = labelled.join(beside, "page_id", "left").withColumn("carried", F.coalesce("carried", F.lit(False)))
        words = cut(count_words(self.pages, clean_text, "clean_text"))
        self.words = cut(respell(words))
        # bounded: the ``known`` most frequent words that are right as they stand need no look-up
        # (a year with letters for digits is frequent without being right)
        mixed = F.col("word").rlike("[0-9].*[a-z]|[a-z].*[0-9]|[@$|!]") & ~F.col("word").rlike("^[0-9]+(st|nd|rd|th)$")
        good = self.words.filter(F.col("right").isNull() & (F.col("n") >= 3) & ~mixed).orderBy(F.desc("n"), "word").limit(known)
        self.good = {r[0]: r[1] for r in good.select("word", "n").collect()}
        self.found = cut(self._find())

    def _look_up(self) -> DataFrame:
        """Rows (page_id, line_no, kind, word, other): furniture, and words that aren't among the known good ones."""
        shared = self.pages.sparkSession.sparkContext.broadcast(self.good)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            good, right = shared.value, {}
            for batch in batches:
                at, out = [], ([], [], [], [])

                def put(r: int, *values: object) -> None:
                    at.append(r)  # noqa: B023
                    for x, y in zip(out, values, strict=True):  # noqa: B023
                        x.append(y)

                for r, (t, off, after, carried) in enumerate(zip(batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                    for i in off:
                        put(r, i, "furniture", "", None)
                    whole, broken = break_up(body_lines(t.as_py(), off), after, carried)
                    for i, w, rest in broken:
                        one, two = w + rest, f"{w}-{rest}"
                        if one in good and good[one] >= good.get(two, 0):
                            put(r, i, "broken_word", one, None)
                        elif two in good:
                            put(r, i, "broken_word", two, None)
                        else:
                            put(r, i, "broken", one, two)
                    clear = True
                    for chunk in set(plain("\n".join(line for _, line in whole)).split()):
                        known = right.get(chunk)
                        if known is None:
                            if len(right) > 500_000:
                                right.clear()
                            known = right[chunk] = all(w in good for w in _WORD.findall(chunk))
                        clear = clear and known
                    if clear:
                        continue
                    for i, line in whole:
                        for w in words_of(line):
                            if w in good:
                                continue
                            y = year_of(w)
                            put(r, i, *(("misread", y, w) if y else ("word", w, None)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.string(), pa.string(), pa.string()), strict=True))], ["page_id", "line_no", "kind", "word", "other"])

        kind = dict(self.pages.dtypes)["page_id"]
        return self.pages.filter("scanned").select("page_id", "text", "furniture", "following", "carried").mapInArrow(run, f"page_id {kind}, line_no int, kind string, word string, other string")

    def _find(self) -> DataFrame:
        """Rows (page_id, line_no, kind, word, seen): ``seen`` is the word as it stands, without its break."""
        asked = cut(self._look_up())
        sure = asked.filter("kind IN ('furniture', 'broken_word', 'misread')").select("page_id", "line_no", "kind", "word", F.coalesce("other", "word").alias("seen"))
        right = self.words.select("word", "right", "n")
        single = asked.filter("kind = 'word'").join(right.filter("right IS NOT NULL"), "word").select("page_id", "line_no", F.lit("misread").alias("kind"), F.col("right").alias("word"), F.col("word").alias("seen"))
        two = right.select(F.col("word").alias("other"), F.col("right").alias("right2"), F.col("n").alias("n2"))
        halves = asked.filter("kind = 'broken'").join(right, "word", "left").join(two, "other", "left")
        m1, m2 = F.coalesce("n", F.lit(0)), F.coalesce("n2", F.lit(0))
        whole = F.when(m2 > m1, F.col("other")).when(m1 > 0, F.col("word")).otherwise(F.coalesce("right", F.when(F.col("right2").rlike("-"), F.col("right2")), "word"))
        broken = halves.select("page_id", "line_no", F.lit("broken_word").alias("kind"), whole.alias("word"), F.when(m2 > m1, F.col("other")).otherwise(F.col("word")).alias("seen"))
        return sure.unionByName(single).unionByName(broken).distinct()

    def paragraphs(self) -> DataFrame:
        """Rows (page_id, file_path, page_index, paragraph_no, continues, text): the pages' paragraphs, in right spelling.

        A paragraph is one line of text. ``continues`` is true for the first of a page that goes on with the last of the
        page before; a word broken between pages is whole on the first of them.
        """
        fixes = self.found.filter("kind != 'furniture'").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "word", "seen"))).alias("fixes"))
        d = self.pages.join(fixes, "page_id", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, out = [], ([], [], [])
                rows = zip(batch.column(3), *(batch.column(k).to_pylist() for k in (4, 5, 6, 7)), strict=True)
                for r, (t, off, breaks, known, carried) in enumerate(rows):
                    for k, (text, goes_on) in enumerate(assemble(t.as_py(), off, breaks, known or [], carried)):
                        at.append(r)
                        for x, y in zip(out, (k, goes_on, text), strict=True):
                            x.append(y)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.string())], ["page_id", "file_path", "page_index", "paragraph_no", "continues", "text"])

        kind = dict(self.pages.dtypes)["page_id"]
        return d.select("page_id", "file_path", "page_index", "text", "furniture", "breaks", "fixes", "carried").mapInArrow(run, f"page_id {kind}, file_path string, page_index int, paragraph_no int, continues boolean, text string")


def _like(word: str, model: str) -> str:
    """``word`` in the case of ``model``."""
    return word.upper() if sum(c.isupper() for c in model) > 1 and model.upper() == model else word[:1].upper() + word[1:] if model[:1].isupper() else word


def assemble(text: str, furniture: list[int], breaks: list[int], fixes: list[dict], carried: bool) -> list[tuple[str, bool]]:
    """The page's paragraphs, each from a line labelled as its beginning to the next, and whether each goes on with one of the page before."""
    begins = set(breaks)
    lines = body_lines(text, furniture)
    misread: dict[int, dict[str, str]] = defaultdict(dict)
    whole = {}
    for f in fixes:
        if f["kind"] == "misread":
            misread[f["line_no"]][f["seen"]] = f["word"]
        elif f["kind"] == "broken_word":
            whole[f["line_no"]] = f["word"]
    out: list[list[str]] = []
    goes_on, skip = [], carried
    for k, (i, line) in enumerate(lines):
        body = line
        if skip and (m := _HEAD.match(body)):
            body = body[m.end() :]
        broken = _BROKEN.search(line) if i in whole else None
        tail = ""
        if broken:
            body = body[: len(body) - (len(line) - broken.start())] if len(body) >= len(line) - broken.start() else ""
            tail = _like(whole[i], broken[1])
        own = misread.get(i, {})
        body = _TOKEN.sub(lambda m: _like(own[w], m[0]) if (w := plain(m[0])) in own else m[0], body) if own else body  # noqa: B023
        piece = " ".join((body + tail).split())
        if k == 0 or (i in begins and not skip):
            out.append([])
            goes_on.append(k == 0 and (skip or i not in begins))
        if skip and out[-1] and piece and not piece[0].isalnum() and piece[0] not in "(“":
            out[-1][-1] += piece  # the mark that followed the broken word
        elif piece:
            out[-1].append(piece)
        skip = broken is not None
    return [(" ".join(x), c) for x, c in zip(out, goes_on, strict=True) if x]
