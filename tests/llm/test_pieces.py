import random

from hypothesis import given, settings
from hypothesis import strategies as st

from statutor.llm.pieces import section_audit, section_starts, split_oversized, split_text

OWN = "AN ORDINANCE.\nBE IT ORDAINED: Section 1. Aims. One. Section 2 of Ordinance No. 5 is hereby amended to read as follows:\n“Section 9. Old. Text.\n\nSection 10. Older.”\nSection 2. Fees.\nSection 7 of this Code applies. Section 3. End."


def test_own_sections_only():
    assert [OWN[p : p + 10] for p in section_starts(OWN)] == ["Section 1.", "Section 2.", "Section 3."]
    heads = ["SECTION IV. TITLE - a", "SECTION V - b", "Sec. 6: c", "§ 7. d", "Seksyon 8. e", "SECTION 9.- f"]
    text = "\n".join(heads)
    assert section_starts(text) == [text.index(h) for h in heads]


def test_a_lost_closing_quote_hides_nothing():
    t = "Section 1. a.\n“Section 8. quoted, never closed.\nSection 2. b.\n“Section 9. quoted.”\nSection 3. c."
    assert [t[p : p + 10] for p in section_starts(t)] == ["Section 1.", "Section 2.", "Section 3."]


def test_a_damaged_heading_counts_where_its_number_is_missing():
    t = "Section 1 – A. x.\nSection 2 B – of. y.\nSection 9 Coverage z.\nSection 3 – C. z."
    assert len(section_starts(t)) == 3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .;\n§1“”", max_size=600), st.integers(5, 80), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[p["start_at"] : p["end_at"]] for p in pieces) == text
    assert all(len(p["piece_text"]) <= limit for p in pieces)
    assert all(p["start_at"] - p["piece_start"] == min(overlap, p["start_at"]) for p in pieces[1:])
    assert sorted(s for p in pieces for s in p["section_starts"]) == section_starts(text)


def test_pieces_are_balanced_and_begin_at_sections():
    random.seed(1)
    text = "\n".join(f"Section {k}. " + " ".join(random.choices(["tax", "road", "fee", "stall."], k=120)) for k in range(1, 30))
    pieces = split_text(text, 6000, 200)
    assert len(pieces) <= -(-len(text) // 5800) + 1
    assert {p["begins_at"] for p in pieces} == {"section"}
    sizes = [p["end_at"] - p["start_at"] for p in pieces]
    assert max(sizes) < 2 * min(sizes)


def test_no_boundary_at_all():
    assert max(len(p["piece_text"]) for p in split_text("x" * 1001, 100, 10)) <= 100


def test_operator(spark):
    rows = [(1, OWN, 0), (2, None, 0), (3, "", 0), (1, OWN, 0), (4, "word " * 5000, 0)]
    d = spark.createDataFrame(rows, "text_id long, clean_text string, start_at int")
    out = split_oversized(d, "text_id", "clean_text").collect()
    assert sorted({r["text_id"] for r in out}) == [1, 3, 4]
    assert sum(r["text_id"] == 1 for r in out) == 2
    assert split_oversized(d.filter("false"), "text_id", "clean_text").count() == 0
    assert "".join(r["piece_text"][r["start_at"] - r["piece_start"] :] for r in sorted((r for r in out if r["text_id"] == 4), key=lambda r: r["piece_no"])) == "word " * 5000


def test_audit_of_section_counts(spark):
    texts = spark.createDataFrame([(1, "p1", OWN)], "text_id long, clean_text_path string, clean_text string")
    idx = spark.createDataFrame([(7, "p1", 3), (7, "p1", 3), (8, "p1", None), (9, None, 2)], "scan_seq long, clean_text_path string, section_count int")
    got = {r["scan_seq"]: (r["n_sections"], r["agrees"]) for r in section_audit(idx, texts, split_oversized(texts, "text_id", "clean_text", with_text=False)).collect()}
    assert got == {7: (3, True), 8: (3, False), 9: (None, False)}


def test_headings_without_their_marks_follow_the_numbers():
    text = "Section 1 – Title. Name.\nSection 2 – Terms. Words. Section 3 Every stall counts. Section 4 No one shall shout; \nSection 5 The office acts.\nSection 9 Stray line.\nSection 14 OF this Code holds. As Section 6 The rule says."
    starts = section_starts(text)
    assert [text[s : s + 9] for s in starts] == ["Section 1", "Section 2", "Section 3", "Section 4", "Section 5"]
