"""Labelling the lines of scanned pages with a linear-chain conditional random field.

A line is of the body, begins a paragraph of it (a break), or is a running header, the stamp beneath it or a page number.
The model is trained here by its likelihood: on pages that label themselves, since in files of many pages the furniture
betrays itself by recurring at the same place or by counting up with the pages, and on texts whose paragraphs are known, set
in lines and pages. It learns from layout and wording to label every line of any page, also in files of one.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np

LABELS = ("body", "break", "header", "stamp", "number")
BODY, BREAK, HEADER, STAMP, NUMBER = range(5)
NEVER = -1e4
#: Lines from the top and from the bottom of a page among which the pages that the model learns from label themselves.
EDGE_TOP, EDGE_BOTTOM = 4, 3

# Glyphs that scanners confuse, folded to one of each kind.
_FOLD = str.maketrans("0O1I|!5$8694@7", "oollllssbbgaat")
_DIGITS = str.maketrans("OoQDIl|!iSsBbZzgq", "00001111155882299")
_TOKEN = re.compile(r"[\w@!$]+|[^\w\s]+")
_ROMAN = re.compile(r"[ivxlc]{1,7}$")
_NUMERIC = re.compile(r"[0-9OolIiSB|!]{1,4}$")


_GROUPS = (("ll", "u"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("rl", "n"))
_CLASSES = str.maketrans("mceh", "noob")


def _token(t: str) -> str:
    if not (t[0].isalnum() or t[0] in "@!$"):
        return t[:3]
    if 2 * sum(c.isdigit() for c in t) > len(t):
        return "9"
    t = t.translate(_FOLD).lower().replace("i", "l")
    for seen, true in _GROUPS:
        t = t.replace(seen, true)
    return t.translate(_CLASSES)


# Two caches, since a mark at a word's end is a glyph to one fold and none to the other.
_FOLDED: dict[str, str] = {}
_FOLDED_WORDS: dict[str, str] = {}
_UPPER, _LOWER = re.compile("[A-Z]"), re.compile("[a-z]")


def tokens(line: str) -> list[str]:
    out = []
    for t in _TOKEN.findall(line):
        f = _FOLDED.get(t)
        if f is None:
            if len(_FOLDED) > 500_000:
                _FOLDED.clear()
            f = _FOLDED[t] = _token(t)
        out.append(f)
    return out


def _case(line: str) -> str:
    """U for a line mostly in capitals, else M."""
    upper = len(_UPPER.findall(line))
    return "U" if upper > 1.5 * len(_LOWER.findall(line)) else "M"


def skeleton(line: str) -> str:
    """The line with confusable glyphs and numbers folded, marked with its case."""
    return _case(line) + " ".join(tokens(line))


def numbers_in(line: str) -> list[int]:
    """What the only number of a short line such as a page number may be, Arabic (with misread digits) or Roman.

    Of "Page 3 of 10" it is the first. Empty where the line is no such line.
    """
    words = [w.strip("[](){}—–-.,*") for w in line.split()]
    words = [w for w in words if w.strip("|") and w.lower() not in ("page", "p", "pg", "of", "pahina")]
    if not 1 <= len(words) <= 2:
        return []
    w, out = words[0], []
    if _NUMERIC.match(w) and (any(c.isdigit() for c in w) or len(w) <= 2):
        out.append(int(w.translate(_DIGITS)))
    if len(words) == 1 and _ROMAN.match(w.lower()):
        v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in w.lower()]
        out.append(sum(-a if b > a else a for a, b in zip(v, [*v[1:], 0], strict=True)))
    return out


class Page:
    """The lines of a page that aren't blank; every one of them is labelled."""

    def __init__(self, text: str, index: int) -> None:
        self.lines = text.split("\n")
        self.full = [i for i, line in enumerate(self.lines) if line and not line.isspace()]
        n = len(self.full)
        #: Where furniture that betrays itself is looked for, to learn from.
        self.edge = self.full if n <= EDGE_TOP + EDGE_BOTTOM else self.full[:EDGE_TOP] + self.full[-EDGE_BOTTOM:]
        self.gap = EDGE_TOP if n > EDGE_TOP + EDGE_BOTTOM else -1
        self.index = index


# What a line looks like.

_CAPITALS, _SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_TAIL = re.compile(r"(?:\s*[|]\s*|\s+[-–—]\s+|\s{2,})[0-9OolIiSB|!]{1,4}\s*$")
_TAILS = frozenset("0123456789OolIiSB|!")
_MARKS = ".,;:!?()[]\"'“”’"
#: Features of a line by itself and by its place; what a line has fewer of is filled up with the one that is never set.
OWN, PLACE = 12, 16


def _case_of(s: str) -> str:
    """U for a line mostly in capitals, else M."""
    b = s.encode("utf-8", "replace")
    return "U" if len(b) - len(b.translate(None, _CAPITALS)) > 1.5 * (len(b) - len(b.translate(None, _SMALL))) else "M"


def _word(w: str) -> str:
    f = _FOLDED_WORDS.get(w)
    if f is None:
        if len(_FOLDED_WORDS) > 500_000:
            _FOLDED_WORDS.clear()
        bare = w.strip(_MARKS)
        f = _FOLDED_WORDS[w] = _token(bare) if bare else w[:3]
    return f


def _near(a: str, b: str) -> bool:
    """At most two changed or one added or lost character in strings of ten or more."""
    if a == b:
        return True
    if a[0] != b[0] or abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 10:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 2
    short, long = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[k:] == long[k + 1 :]


def untailed(line: str) -> str:
    """A header's skeleton without the page number that may follow it on its line."""
    return skeleton(_TAIL.sub("", line))


def self_labels(pages: list[Page]) -> list[tuple[Page, list[int]]]:
    """Labels of the edge lines of one file's pages, from what recurs and what counts up with them."""
    heads: Counter[str] = Counter()
    marks: Counter[str] = Counter()
    for p in pages:
        if p.index == 0:
            continue
        lines = [p.lines[i] for i in p.edge[:3]]
        for s in {untailed(x) for x in lines if not numbers_in(x)}:
            heads[s] += 1
        for i in {*p.edge[:1], *p.edge[-1:]}:
            if p.index + 1 in numbers_in(p.lines[i]):
                marks[re.sub(r"\d+", "9", p.lines[i].strip()) if any(c.isdigit() for c in p.lines[i]) else "roman"] += 1
    later = sum(p.index > 0 for p in pages)
    known = [s for s, n in heads.items() if n >= max(2 if later < 7 else 3, 0.25 * later) and len(s) > 4]
    numbered = sum(marks.values()) >= 0.5 * later
    out = []
    for p in pages:
        labels = [BODY] * len(p.edge)
        seen_body = False
        for k, i in enumerate(p.edge):
            line = p.lines[i]
            at_top, at_bottom = k < 3 and (p.gap < 0 or k < p.gap), k == len(p.edge) - 1
            if numbered and p.index + 1 in numbers_in(line) and (k == 0 or at_bottom):
                labels[k] = NUMBER
            elif at_top and not seen_body and not numbers_in(line) and any(_near(untailed(line), s) for s in known):
                labels[k] = STAMP if k and labels[k - 1] == HEADER else HEADER
            else:
                seen_body = True
        out.append((p, labels))
    return out


def own_features(line: str) -> tuple[str, ...]:
    """The features of a line that hang on the line alone, after its shape, its first class and its first word."""
    s = line.strip()
    tail = s[-1] in _TAILS and _TAIL.search(line) is not None
    words = (_TAIL.sub("", s) if tail else s).split() or s.split()
    n, case = len(words), _case_of(s)
    short = n <= 7
    near = [_FOLDED_WORDS.get(w) or _word(w) for w in (words if short else (*words[:3], *words[-2:]))]
    c, e = s[0], s[-1]
    first = "l" if c.islower() else "U" if c.isupper() else "d" if c.isdigit() else c
    numeral = len(s) < 24 and bool(numbers_in(line))
    shape = ("w" if not numeral else "n" if any(x.isdigit() for x in s) else "r") + case + str(min(n, 9))
    out = [shape, first, near[0], f"s={shape}", f"n{min(len(s) // 8, 10)}{case}", f"e{'a' if e.isalnum() else e}", f"b{first}{case}", f"0={case}{near[0]}", f"z={case}{near[-1]}"]
    if short:
        out.append(f"L={case}{' '.join(near)}")
    if n > 1:
        out.append(f"01={case}{near[0]}_{near[1]}")
        out.append(f"12={case}{near[1]}_{near[2] if n > 2 else '$'}")
    if tail:
        out.append("tail")
    if n >= 4 and s.endswith(("...", "…")):
        out.append("cutoff")
    return tuple(out[: OWN + 3])


def place_features(key: tuple) -> list[str]:
    """The features of a line that hang on where it stands."""
    top, bottom, first, shape, number, after, before, few, ended, fits, begins, wide = key
    out = [f"T{top}", f"B{bottom}", f"T{top}{first}", f"T{top}{shape}", f"B{bottom}{shape}", f"c{shape[1]}{first}", f"p{ended}{fits}", f"p{ended}{fits}{begins}", f"q{ended}{before}{begins}", f"w{wide}{ended}{begins}"]
    if number:
        out += [f"N{number}{shape[0]}T{top}", f"N{number}{shape[0]}B{bottom}"]
    if after:
        out.append(f"after{top}")
    if before:
        out.append(f"before{top}{bottom}")
    if few:
        out.append("few")
    return out


class Features:
    """Numbers of features; new ones are numbered while ``open``, later they count as none."""

    def __init__(self, ids: dict[str, int] | None = None) -> None:
        self.ids, self.open = ({}, True) if ids is None else (ids, False)
        self._own: dict[str, tuple] = {}
        self._place: dict[tuple, int] = {}
        self._opens: dict[tuple, int] = {}
        #: The features of each place that has come up.
        self.places: list[list[int]] = []

    def _numbers(self, names: list[str] | tuple[str, ...], size: int) -> list[int]:
        ids = self.ids
        out = [ids.setdefault(x, len(ids) + 1) for x in names] if self.open else [ids.get(x, 0) for x in names]
        return out[:size] + [0] * (size - len(out))

    def of(self, page: Page) -> list[list[int]]:
        """A row of ``OWN`` + ``PLACE`` + 1 numbers for each line that isn't blank."""
        own, place, opens = [], [], []
        self.collect(page, own, place, opens)
        return [[*a, *self.places[b], c] for a, b, c in zip(own, place, opens, strict=True)]

    def collect(self, page: Page, own_rows: list[list[int]], place_rows: list[int], open_rows: list[int]) -> None:
        """Adds each line's own features, the number of its place and the feature of how it opens."""
        lines, full, n = page.lines, page.full, len(page.full)
        width = max((len(lines[i].rstrip()) for i in full), default=0)
        first, few, prior, ended, room = page.index == 0, n <= 3, -2, "^", 0
        for k, i in enumerate(full):
            line = lines[i]
            own = self._own.get(line)
            if own is None:
                if len(self._own) > 200_000:
                    self._own.clear()
                f = own_features(line)
                own = self._own[line] = (f[0], f[1], f[2], self._numbers(f[3:], OWN), len(line.split(None, 1)[0]), line.rstrip())
            shape, begins, word, numbers, head, bare = own
            number = ("same" if page.index + 1 in numbers_in(line) else "other") if shape[0] != "w" else ""
            before = prior != i - 1 and k > 0
            key = (min(k, 4), min(n - 1 - k, 3), first, shape, number, i + 1 < len(lines) and not lines[i + 1].strip(), before, few, ended, room > head, begins, len(bare) * 4 > width * 3)
            place = self._place.get(key)
            if place is None:
                place = self._place[key] = len(self.places)
                self.places.append(self._numbers(place_features(key), PLACE))
            opening = self._opens.get((ended, begins, word))
            if opening is None:
                if len(self._opens) > 500_000:
                    self._opens.clear()
                opening = self._opens[ended, begins, word] = self._numbers((f"o{ended}{begins}={word}",), 1)[0]
            own_rows.append(numbers)
            place_rows.append(place)
            open_rows.append(opening)
            last = bare[-1]
            ended, room, prior = "a" if last.isalnum() else last, width - len(bare), i


# The model.


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class LineModel:
    """A linear-chain conditional random field: weights of features by label, and of labels that follow one another.

    ``moves`` has a row for the beginning besides those of the labels. A stamp stands beneath a header.
    """

    def __init__(self, ids: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.features, self.weights, self.moves = Features(ids), weights, moves

    def label(self, pages: list[Page]) -> list[list[int]]:
        """The likeliest labels of each page's lines (Viterbi), many pages at once."""
        if len(self.features.places) > 200_000:
            self.features = Features(self.features.ids)
        own: list[list[int]] = []
        place: list[int] = []
        opens: list[int] = []
        for p in pages:
            self.features.collect(p, own, place, opens)
        sizes = np.array([len(p.full) for p in pages], np.int64)
        if not own:
            return [[] for _ in pages]
        scores = self.weights[np.array(self.features.places)].sum(axis=1)[place] + self.weights[opens]
        for k in range(0, len(own), 4096):
            scores[k : k + 4096] += self.weights[np.array(own[k : k + 4096])].sum(axis=1)
        out: list[list[int]] = [[] for _ in pages]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(sizes, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 256)):  # pages of like length together
            length = int(sizes[part].max(initial=0))
            if not length:
                continue
            at = np.minimum(starts[part][:, None] + np.arange(length), len(scores) - 1)
            s = scores[at]
            best, back = s[:, 0] + self.moves[-1], np.zeros((len(part), length, len(LABELS)), np.int8)
            ends = np.zeros(len(part), np.int64)
            ends[sizes[part] == 1] = best[sizes[part] == 1].argmax(axis=1)
            for t in range(1, length):
                x = best[:, :, None] + self.moves[None, :-1]
                back[:, t] = x.argmax(axis=1)
                best = x.max(axis=1) + s[:, t]
                here = sizes[part] == t + 1
                ends[here] = best[here].argmax(axis=1)
            for j, p in enumerate(part):
                path, y = [], int(ends[j])
                for t in range(int(sizes[p]) - 1, -1, -1):
                    path.append(y)
                    y = int(back[j, t, y])
                out[p] = path[::-1]
        return out

    def furniture(self, text: str, index: int) -> tuple[list[int], list[int], list[int]]:
        """The numbers of a page's furniture lines, of its body lines that aren't blank, and of those that begin a paragraph."""
        return split_labels(Page(text, index), self.label([Page(text, index)])[0])


def split_labels(page: Page, labels: list[int]) -> tuple[list[int], list[int], list[int]]:
    pairs = list(zip(page.full, labels, strict=True))
    return [i for i, y in pairs if y > BREAK], [i for i, y in pairs if y <= BREAK], [i for i, y in pairs if y == BREAK]


def _marginals(s: np.ndarray, moves: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods of a batch, the labels' probabilities and the summed probabilities of moves, by forward and backward sums."""
    b, length, n = s.shape
    fwd, bwd = np.zeros_like(s), np.zeros_like(s)
    fwd[:, 0] = s[:, 0] + moves[-1]
    for t in range(1, length):
        step = _sum_exp(fwd[:, t - 1, :, None] + moves[None, :-1], 1) + s[:, t]
        fwd[:, t] = np.where(inside[:, t, None], step, fwd[:, t - 1])
    z = _sum_exp(fwd[:, -1], 1)
    for t in range(length - 2, -1, -1):
        step = _sum_exp(moves[None, :-1] + (s[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        bwd[:, t] = np.where(inside[:, t + 1, None], step, bwd[:, t + 1])
    p = np.exp(np.minimum(0, fwd + bwd - z[:, None, None])) * inside[..., None]
    pairs = fwd[:, :-1, :, None] + moves[None, None, :-1] + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]
    change = np.zeros((n + 1, n))
    change[:-1] = (np.exp(np.minimum(0, pairs)) * inside[:, 1:, None, None]).sum(axis=(0, 1))
    change[-1] = p[:, 0].sum(axis=0)
    return z, p, change


def fit(rows: list[tuple[list[list[int]], list[int]]], n_features: int, rounds: int = 8, rate: float = 0.25, decay: float = 1e-5, seed: int = 11, batch: int = 128) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weights and moves of greatest likelihood (stochastic ascent with step sizes by feature), and the mean log-likelihood of each round.

    A row has the numbers of its lines' features and for each line the set of labels (bits) that it may have. What is
    climbed is the likelihood of all labellings within these sets, so that a line known to be of the body, but not whether
    it begins a paragraph, teaches just that. The weights are the means of the later rounds, which hang less on the sample.
    """
    n, rng = len(LABELS), np.random.default_rng(seed)
    weights, moves = np.zeros((n_features + 1, n)), np.zeros((n + 1, n))
    moves[[x for x in range(n + 1) if x != HEADER], STAMP] = NEVER
    free = moves > NEVER / 2
    squares, move_squares, likelihoods = np.full_like(weights, 1e-3), np.full_like(moves, 1e-3), []
    mean = [np.zeros_like(weights), np.zeros_like(moves)]
    rows = sorted((r for r in rows if r[0]), key=lambda r: len(r[0]))
    parts = [rows[k : k + batch] for k in range(0, len(rows), batch)]
    bits = 1 << np.arange(n)
    packed = []
    for part in parts:
        length = max(len(r[0]) for r in part)
        ids, may, inside = np.zeros((len(part), length, len(part[0][0][0])), np.int64), np.zeros((len(part), length), np.int64), np.zeros((len(part), length), bool)
        for j, (x, y) in enumerate(part):
            ids[j, : len(x)], may[j, : len(x)], inside[j, : len(x)] = x, y, True
        packed.append((ids, np.where((may[..., None] & bits) > 0, 0.0, NEVER) * inside[..., None], inside))
    for _ in range(rounds):
        total = 0.0
        for k in rng.permutation(len(packed)):
            ids, barred, inside = packed[k]
            s = weights[ids].sum(axis=2)
            z, p, change = _marginals(s, moves, inside)
            z0, p0, change0 = _marginals(s + barred, moves, inside)
            total += float((z0 - z).sum())
            flat, slope = ids[inside], (p0 - p)[inside]
            grad = np.stack([np.bincount(flat.ravel(), np.repeat(slope[:, y], ids.shape[2]), len(weights)) for y in range(n)], axis=1) - decay * len(inside) * weights
            grad[0] = 0
            squares += grad**2
            weights += rate * grad / np.sqrt(squares)
            move_grad = np.where(free, change0 - change, 0)
            move_squares += move_grad**2
            moves += rate * move_grad / np.sqrt(move_squares)
        likelihoods.append(total / max(1, sum(len(r[0]) for r in rows)))
        if len(likelihoods) > rounds // 2:
            mean[0] += weights / (rounds - rounds // 2)
            mean[1] += moves / (rounds - rounds // 2)
    return mean[0].astype(np.float32), mean[1].astype(np.float32), likelihoods


def typeset(text: str, seed: int) -> list[tuple[Page, list[int]]]:
    """A text whose paragraphs are known (a line each), set in lines and pages as a typist would, with each line's label.

    Widths, blank lines, breaks within words and the lines of a page are drawn at random by ``seed``.
    """
    rng = random.Random(seed)
    width, gap, broken, height = rng.randint(56, 74), rng.choice((0.0, 0.3, 1.0)), rng.choice((0.0, 0.3)), rng.randint(8, 34)
    lines: list[tuple[str, int]] = []
    for paragraph in text.split("\n"):
        words, now, label = paragraph.split(), "", BREAK
        if words and lines and rng.random() < gap:
            lines.append(("", -1))
        for w in words:
            if now and len(now) + 1 + len(w) > width:
                room = width - len(now) - 2
                if w.isalpha() and len(w) >= 6 and 3 <= room <= len(w) - 2 and rng.random() < broken:
                    now, w = f"{now} {w[:room]}-", w[room:]  # noqa: PLW2901
                lines.append((now, label))
                now, label = w, BODY
            else:
                now = f"{now} {w}" if now else w
        if now:
            lines.append((now, label))
    out = []
    for index, k in enumerate(range(0, len(lines), height)):
        part = lines[k : k + height]
        out.append((Page("\n".join(x for x, _ in part), index), [y for _, y in part if y >= 0]))
    return out


def train(files: list[list[tuple[int, str]]], texts: Iterable[str] = (), rounds: int = 8, seed: int = 11) -> LineModel:
    """A model from the pages (index, text) of some files, each file's furniture labelling itself, and from texts whose
    paragraphs are known.

    Two pages of a file put together are learnt from as well, so that furniture is known in the midst of a page too.
    """
    rng, rows, open_ = random.Random(seed), [], Features()
    either = (1 << BODY) | (1 << BREAK)
    for f in files:
        pages = self_labels([Page(t, i) for i, t in sorted(f)])
        for p, labels in pages:
            off = {i: y for i, y in zip(p.edge, labels, strict=True) if y > BREAK}
            # a line that says the page's number may be meant to, also in a file whose numbers don't betray themselves
            perhaps = {i: either | 1 << NUMBER for i in {*p.full[:3], *p.full[-1:]} if p.index + 1 in numbers_in(p.lines[i])}
            rows.append((open_.of(p), [1 << off[i] if i in off else perhaps.get(i, either) for i in p.full]))
        if len(pages) > 1 and rng.random() < 0.5:
            (a, ya), (b, yb) = rng.sample(pages, 2)
            both = Page("\n".join([*a.lines, *b.lines]), a.index)
            off = {i: y for i, y in zip(a.edge, ya, strict=True) if y > BREAK} | {i + len(a.lines): y for i, y in zip(b.edge, yb, strict=True) if y > BREAK}
            # what the second page's number says on the first one's page isn't known
            may = {i: either | 1 << NUMBER for i, y in off.items() if y == NUMBER and i >= len(a.lines)}
            rows.append((open_.of(both), [may.get(i) or (1 << off[i] if i in off else either) for i in both.full]))
    for k, t in enumerate(texts):
        rows += [(open_.of(p), [1 << y for y in labels]) for p, labels in typeset(t, seed + k)]
    weights, moves, _ = fit(rows, len(open_.ids), rounds)
    return LineModel(open_.ids, weights, moves)
