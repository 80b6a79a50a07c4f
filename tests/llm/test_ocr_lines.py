from statutor.llm import ocr_lines
from statutor.llm.ocr_lines import Features, Page, own_features, skeleton

LINES = ["Stop! SECTION 1. All vendors!", "THE CITY! OF LUMBAYA!", "no later than noon! |", "Page 3 of 10"]


def forget():
    for cache in (v for k, v in vars(ocr_lines).items() if k.startswith("_FOLDED")):
        cache.clear()


def test_features_of_a_line_do_not_hang_on_what_was_read_before():
    forget()
    alone = [own_features(x) for x in LINES]
    skeletons = [skeleton(x) for x in LINES]
    forget()
    assert [skeleton(x) for x in LINES] == skeletons
    assert [own_features(x) for x in LINES] == alone


def test_emptied_caches_change_no_features():
    pages = [Page("\n".join(LINES[k:] + LINES[:k]), k) for k in range(4)]
    kept = Features()
    expected = [kept.of(p) for p in pages]
    emptied, got = Features(kept.ids), []
    for p in pages:
        forget()
        emptied._own.clear()
        emptied._opens.clear()
        got.append(emptied.of(p))
    assert got == expected
