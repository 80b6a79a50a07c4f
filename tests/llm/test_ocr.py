import random
from itertools import product

import numpy as np

from statutor.llm.ocr import RepairedPages, corrections, respell, year_of
from statutor.llm.ocr_lines import BREAK, HEADER, NUMBER, STAMP, Page, _marginals, fit, numbers_in, self_labels, skeleton, train, typeset

random.seed(6)
WORDS = "market stall council treasurer barangay section permit quarter inspection river public office notice within certify harbour lantern gravel".split()


def test_numbers_of_pages():
    assert [numbers_in(x) for x in ("- 4 -", "Page 3 of 10", "[l2]", "xiv", "5 | Page", "p. 7", "market 5 stall", "", "PAGE ll", "II")] == [[4], [3], [12], [14], [5], [7], [], [], [11, 100], [11, 2]]


def test_skeletons_fold_confusable_glyphs():
    assert skeleton("Ordinance No. 0012-16") == skeleton("0rd1nance Nc. 0O12-16")
    assert skeleton("ORDINANCE NO. 0012-16") != skeleton("Ordinance No. 0012-16")


def test_corrections_and_years():
    assert "permit" in dict(corrections("pcrmit")) and "section" in dict(corrections("sectiori")) and "subject" in dict(corrections("siibject")) and "office" in dict(corrections("oﬃce"))
    assert (year_of("2o16"), year_of("20l6"), year_of("2016"), year_of("oil"), year_of("3o16")) == ("2016", "2016", None, None, None)


def test_every_correction_is_looked_up(spark):
    pairs = {"dclinquerit": "delinquent", "cnvirommental": "environmental", "lhroughoul": "throughout", "commi55i0ner": "commissioner", "mun1c1pa1ity": "municipality", "|n5t1tut10n@|": "institutional", "pcrmit": "permit", "0fficc": "office"}
    assert all(right in dict(corrections(seen)) for seen, right in pairs.items() if seen != "|n5t1tut10n@|")
    rows = [(w, 1) for w in pairs] + [(w, 9) for w in pairs.values()] + [("parnel", 9), ("panel", 1), ("two-thirds", 0), ("eat", 3), ("cat", 1)]
    got = {r["word"]: r["right"] for r in respell(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert {w: r for w, r in got.items() if r} == pairs
    assert len(got) == len(rows)


def lines(n):
    text = " ".join(" ".join(random.choices(WORDS, k=random.randrange(6, 14))).capitalize() + "." for _ in range(n))
    out = []
    while len(out) < n:
        cut_at = random.randrange(50, 60)
        out.append(text[:cut_at].strip() + ("-" if text[cut_at - 1 : cut_at + 1].isalpha() else ""))
        text = text[cut_at:]
    return out


def file_pages(f, n):
    head = random.choice(["Office of the Secretary to the Council", "CITY OF LUMBAYA", f"Ordinance No. {f:04d}-16"])
    return [(k, "\n".join([head, "Series of 2016", *lines(random.choice([1, 3, 6, 10, 10])), f"- {k + 1} -"])) for k in range(n)]


def test_model_learns_from_pages_that_label_themselves():
    files = [file_pages(f, 8) for f in range(40)]
    model = train(files)
    right = total = 0
    for f in range(40, 52):
        for k, text in file_pages(f, 1):
            off, body, _ = model.furniture(text, k)
            assert sorted(off + body) == list(range(text.count("\n") + 1))
            right += off == [0, 1, text.count("\n")]
            total += 1
    assert right >= 0.9 * total
    p = [Page(t, k) for k, t in files[0]]
    assert all(y[0] == HEADER and y[1] == STAMP and y[-1] == NUMBER for _, y in self_labels(p))


def test_furniture_in_the_midst_of_a_page_is_found():
    files = [file_pages(f, 8) for f in range(60)]
    model = train(files)
    right = 0
    for f in range(60, 80):
        (_, a), (k, b) = file_pages(f, 2)
        text = a + "\n" + b
        n = a.count("\n")
        right += {0, 1, n, n + 1, n + 2, text.count("\n")} - {n, text.count("\n")} <= set(model.furniture(text, 0)[0])
    assert right >= 17


def test_paragraphs_of_held_out_texts_are_found():
    def text(k):
        rng = random.Random(k)
        line = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(8, 40))).capitalize() + rng.choice([".", ";"])
        return "\n".join(f"{rng.choice(['SECTION 1. ', 'WHEREAS, ', ''])}{line()}" for _ in range(12))

    model = train([], [text(k) for k in range(80)])
    true = got = both = 0
    for k in range(100, 130):
        for page, labels in typeset(text(k), k):
            guess = model.label([page])[0]
            true += sum(y == BREAK for y in labels)
            got += sum(y == BREAK for y in guess)
            both += sum(x == y == BREAK for x, y in zip(labels, guess, strict=True))
    assert both >= 0.9 * true and both >= 0.9 * got


def test_likelihood_rises_and_its_slope_is_right():
    rng = np.random.default_rng(5)
    rows = [([[int(x) for x in rng.integers(1, 9, 3)] for _ in range(n)], [int(1 << y) if rng.random() < 0.8 else 3 for y in rng.integers(0, 2, n)]) for n in (1, 2, 5, 7, 7)]
    _, _, steps = fit(rows, 9, rounds=12)
    assert steps[-1] > steps[0]
    s, moves, inside = rng.normal(size=(2, 4, 5)), rng.normal(size=(6, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    z, p, _ = _marginals(s, moves, inside)
    for j, n in enumerate((4, 2)):
        every = [(sum(s[j, t, y] for t, y in enumerate(path)) + moves[-1, path[0]] + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)), path) for path in product(range(5), repeat=n)]
        total = np.log(sum(np.exp(v) for v, _ in every))
        assert abs(total - z[j]) < 1e-9
        assert abs(sum(np.exp(v - total) for v, path in every if path[0] == 2) - p[j, 0, 2]) < 1e-9


def test_labels_of_many_pages_are_those_of_each():
    files = [file_pages(f, 5) for f in range(20)]
    model = train(files)
    pages = [Page(t, k) for f in files for k, t in f] + [Page("", 0), Page("\n \n", 3), Page("one line", 0), Page("\n".join(["walks on"] * 400), 2)]
    assert model.label(pages) == [model.label([p])[0] for p in pages]
    assert [len(y) for y in model.label(pages)] == [len(p.full) for p in pages]


PAGE = "page_id long, filename string, folder_year int, file_path string, page_index int, digital_text string, ocr_text string"
SUMMARY = "file_path string, extraction_method string, ocr_page_count int, clean_text_path string"


def test_repair(spark):
    rows, k = [], 0
    for f in range(40):
        for index, text in file_pages(f, 8):
            rows.append((k, "Scan_0001.pdf", 2016, f"p/{f}", index, "", text))
            k += 1
    page_a = "CITY OF LUMBAYA\nSeries of 2016\nSECTION 1. The market stall needs a pcrmit from the trea-\nsurer of the barangay in 2o16. All two-\nthirds of the coun-\n- 1 -"
    page_b = "CITY OF LUMBAYA\nSeries of 2016\ncil agree within the quarter.\n\nSECTION 2. The office ends.\n- 2 -"
    rows += [(1000, "x", 2016, "p/x", 0, None, page_a), (1001, "x", 2016, "p/x", 1, "", page_b), (1000, "x", 2016, "p/x", 0, None, page_a), (1002, "x", 2016, "p/x", 2, None, " "), (1003, "x", 2016, "p/done", 0, None, page_a), (None, "x", 2016, "p/x", 9, None, page_a)]
    pages = spark.createDataFrame(rows, PAGE)
    summary = spark.createDataFrame([*((f"p/{f}", "OCR", 8, "") for f in range(40)), ("p/x", "Hybrid", 2, None), ("p/x", "Hybrid", 2, ""), ("p/done", "OCR", 1, "path"), ("p/zero", "OCR", 0, None)], SUMMARY)
    known = [(2 + k, "\n".join(f"SECTION {n}. {' '.join(random.choices(WORDS, k=random.randrange(12, 40))).capitalize()}." for n in range(1, 9))) for k in range(40)]
    clean = spark.createDataFrame([(1, "The two-thirds vote of 2o16 and the permit. " * 30), *known], "text_id long, clean_text string")
    r = RepairedPages(pages, summary, clean)
    got = {(x["page_id"], x["line_no"], x["kind"], x["word"]) for x in r.found.filter("page_id >= 1000").collect()}
    want = {(1000, 0, "furniture", ""), (1000, 1, "furniture", ""), (1000, 5, "furniture", ""), (1001, 0, "furniture", ""), (1001, 1, "furniture", ""), (1001, 5, "furniture", "")}
    want |= {(1000, 2, "misread", "permit"), (1000, 2, "broken_word", "treasurer"), (1000, 3, "misread", "2016"), (1000, 3, "broken_word", "two-thirds"), (1000, 4, "broken_word", "council")}
    assert got == want
    p = [(x["page_index"], x["continues"], x["text"]) for x in r.paragraphs().filter("file_path = 'p/x'").orderBy("page_index", "paragraph_no").collect()]
    assert p == [
        (0, False, "SECTION 1. The market stall needs a permit from the treasurer of the barangay in 2016. All two-thirds of the council"),
        (1, True, "agree within the quarter."),
        (1, False, "SECTION 2. The office ends."),
    ]


def test_empty_tables(spark):
    pages, summary, clean = spark.createDataFrame([], PAGE), spark.createDataFrame([], SUMMARY), spark.createDataFrame([], "text_id long, clean_text string")
    r = RepairedPages(pages, summary, clean)
    assert r.found.count() == r.paragraphs().count() == 0
