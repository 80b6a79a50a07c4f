import pytest
from documents import ALL, frame
from pyspark.sql import Row
from pyspark.sql import functions as F

from statutor.functions import fixed as X
from statutor.functions import signals as S
from statutor.functions.anchors import anchors
from statutor.functions.cleaning import clean
from statutor.functions.consensus import resolve
from statutor.functions.metadata import keywords
from statutor.operators.audit import SUMMARY, audit


def one(spark, column, **values):
    row = spark.createDataFrame([Row(**values)], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("x")).first()
    return row["x"]


@pytest.fixture(scope="module")
def records(spark):
    return {r["filename"]: r for r in audit(frame(spark)).collect()}


def test_columns(spark):
    assert audit(frame(spark)).columns == SUMMARY
    assert len(SUMMARY) == 54
    assert audit(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("name", "years", "status", "confidence", "agree"), [
    ("Ordinance No. 0116-16.pdf", (2016, 2016, 2016, 2016), "valid", 1.0, 4),
    ("Ordinance No. 0118-16.pdf", (2016, 2016, 2016, 2016), "valid", 1.0, 4),
    ("Ordinance No. 0135-16.pdf", (None, 2016, None, None), "valid", 0.25, 1),
    ("Ordinance No. 0230-10.pdf", (2010, 2010, 2010, 2010), "out_of_scope", 1.0, 4),
    ("Ordinance No. 0301-16.pdf", (2016, 2016, 2016, 2016), "valid", 1.0, 4),
    ("Ordinance No. 0512-16.pdf", (None, 2016, 2016, 2016), "valid", 0.55, 3),
    ("Ordinance No. 0999-16.pdf", (None, 2016, None, None), "unresolved", 0.25, 1),
])
def test_years_and_status(records, name, years, status, confidence, agree):
    r = records[name]
    assert tuple(r[f"detected_{k}_year"] for k in ("enactment", "ordinance_no", "series", "approval")) == years
    assert (r["temporal_status"], r["confidence_score"], r["agreeing_signals"]) == (status, confidence, agree)


def test_dates_citations_and_title(records):
    a, b, c = (records[f"Ordinance No. {n}.pdf"] for n in ("0116-16", "0118-16", "0301-16"))
    assert (a["enactment_date"], a["approval_date"]) == ("2016-03-15", "2016-03-22")
    assert (b["enactment_date"], b["approval_date"]) == ("2016-04-05", "2016-04-12")
    assert (c["enactment_date"], c["approval_date"]) == ("2016-06-07", None)  # a stamp gives a year, no date
    assert b["cited_ordinances"] == "0234-15" and b["is_amendatory"] and b["subject_keywords"] == "where; carts; wait; bridges"
    assert b["citation_candidates_rejected"] == 0 and b["filename_header_number_match"]
    assert a["title"] == "AN ORDINANCE SETTING THE HOURS AND LANES OF NIGHT STALLS AND FOR OTHER PURPOSES"
    assert (a["council_term"], a["session_label"], a["section_count"], a["whereas_count"]) == (18, "22nd Regular Session", 2, 1)
    assert a["subject_keywords"] == "setting; hours; lanes; night; stalls"
    assert c["approving_mayor"] == "JUAN DELA CRUZ"


def test_cleaning_counts(records):
    a = records["Ordinance No. 0116-16.pdf"]
    assert (a["dropped_lines"], a["rejoined_words"]) == (3, 1)
    assert records["Ordinance No. 0999-16.pdf"]["clean_char_count"] == 0


@pytest.mark.parametrize(("token", "year"), [("16", 2016), ("10", 2010), ("99", 1999), ("456", None), ("35", 2035), ("36", 1936), ("1899", None), ("1900", 1900), ("2035", 2035), ("2036", None), ("", None), (None, None), ("1x", None)])
def test_suffix_year(spark, token, year):
    assert one(spark, S.suffix_year(F.col("t")), t=token) == year


@pytest.mark.parametrize(("header", "year"), [("15th City Council", 2007), ("18th COUNCIL", 2016), ("0th council", None), ("council", None)])
def test_council_year(spark, header, year):
    assert one(spark, S.council_year(F.col("t")), t=header) == year


def test_number_after_a_citation_is_found_and_counted(spark):
    h = one(spark, S.header_number(F.col("t")), t="Amending Ordinance No. 0100-15\n\nORDINANCE NO. 0200-16\n")
    assert (h["number"], h["year"], h["rejected"]) == ("0200-16", 2016, 1)


def test_three_digit_suffix_takes_the_year_of_the_header(spark):
    s = one(spark, S.year_signals(F.col("t"), F.col("f")), t="ORDINANCE NO. 0200-16\n", f="Ord 0200-123.pdf")
    assert (s["ordinance_number"], s["detected_ordinance_no_year"], s["ordinance_number_source"]) == ("0200-123", 2016, "filename")


def test_invalid_calendar_date_gives_a_year_but_no_date(spark):
    t = "ENACTED February 30, 2016"
    assert one(spark, S.full_dates(F.col("t"))[0], t=t) is None
    assert one(spark, S.enactment(F.col("t")), t=t)["year"] == 2016


def test_bare_year_only_in_the_first_half_of_the_window(spark):
    assert one(spark, S.enactment(F.col("t")), t="ENACTED in 2016") == Row(year=2016, kind="bare_year")
    assert one(spark, S.enactment(F.col("t")), t="ENACTED " + "x" * 300 + " 2016") == Row(year=None, kind="none")


def test_anchor_places(spark):
    assert [tuple(a) for a in one(spark, anchors(F.col("t"), "ab"), t="ab_abab")] == [(0, 2), (3, 5), (5, 7)]
    assert one(spark, anchors(F.col("t"), "ab"), t=None) == []


SIGNAL = "detected_enactment_year int, detected_ordinance_no_year int, detected_series_year int, detected_approval_year int, council_term_year int, ordinance_number_source string"


@pytest.mark.parametrize(("signals", "folder", "expected"), [
    ((2016, 2015, 2015, None, None), 2016, (2016, 0.23, "valid")),  # the tie goes to the enactment
    ((2018, 2018, None, None, None), 2016, (2018, 0.7, "misfiled")),
    ((None, 2018, None, None, None), 2016, (2018, 0.25, "review")),
    ((None, None, None, None, 2016), 2016, (2016, 0.0, "valid")),
    ((None, None, None, None, 2013), 2016, (2013, 0.0, "review")),
    ((2016, 2015, 2016, 2016, None), 2016, (2016, 0.62, "valid")),  # 0.625 rounds down
    ((2016, 2015, 2014, 2013, None), 2016, (2016, 0.17, "valid")),  # 0.175 too
    ((None, None, None, None, None), 2016, (None, 0.0, "unresolved")),
    ((2010, 2010, 2010, 2010, None), 2010, (2010, 1.0, "out_of_scope")),
])
def test_consensus(spark, signals, folder, expected):
    d = spark.createDataFrame([(*signals, "filename")], SIGNAL)
    r = d.select(resolve(F.struct(*d.columns), F.lit(folder), F.lit(True)).alias("r")).first()["r"]
    assert (r["resolved_year"], r["confidence_score"], r["temporal_status"]) == expected


def test_clean_joins_and_drops(spark):
    t = "Republic of the Philippines\n\n\n\n~~ ## ~~\nPage 3 of 9\n[12]\nthe regula-\n tion  of ﬁsh “stalls”\x85next"
    c = one(spark, clean(F.col("t")), t=t)
    assert c["clean"] == 'the regulation of fish "stalls"\nnext'
    assert (c["dropped_lines"], c["rejoined_words"], c["clean_word_count"]) == (4, 1, 6)


def test_clean_of_nothing(spark):
    for t in ("", None):
        c = one(spark, clean(F.col("t")), t=t)
        assert (c["clean"], c["removed_chars"], c["noise_line_ratio"]) == ("", 0, 0.0)


def test_keywords(spark):
    t = "AN ORDINANCE AMENDING THE FEES, SERIES OF 2012, FOR BOATS BOATS PIERS AND NETS AND ROPES AND OARS AND MASTS AND FOR OTHER PURPOSES"
    assert one(spark, keywords(F.col("t")), t=t) == ["fees", "boats", "piers", "nets", "ropes", "oars"]


def test_every_document_has_one_record(spark):
    assert audit(frame(spark)).count() == len(ALL)
    assert X.STATUSES[0] == "valid"
