"""Nine documents of our own wording whose audit gives the published figures of a folder year."""

import hashlib

import pytest
from pyspark.sql import functions as F

from statutor.operators import curate, report
from statutor.operators.audit import audit
from statutor.sources.documents import CONTRACT

FULL = "ORDINANCE NO. {n}\nSeries of {y}\nENACTED this 4th day of May, {y}.\nAPPROVED on the 11th day of May, {y}.\n"


def padded(head: str, length: int, words: int) -> str:
    """The text with words added until it has just so many, and just so many characters."""
    more = words - len(head.split())
    room = length - len(head) - (more - 1)
    sizes = [room // more + (k < room % more) for k in range(more)]
    out = head + " ".join("r" * n for n in sizes)
    assert len(out) == length and len(out.split()) == words
    return out


PAIR = padded(FULL.format(n="0301-16", y=2016), 241, 37)
ROWS = [
    ("Ordinance No. 0301-16.pdf", PAIR),
    ("Ordinance No. 0301-16 again.pdf", PAIR),
    ("Ordinance No. 0301-16 signed.pdf", padded(FULL.format(n="0301-16", y=2016), 400, 62)),
    ("Ordinance No. 0302-16.pdf", padded(FULL.format(n="0302-16", y=2016), 500, 80)),
    ("Ordinance No. 0303-16.pdf", padded(FULL.format(n="0303-16", y=2016), 540, 85)),
    ("Ordinance No. 0044-10.pdf", padded(FULL.format(n="0044-10", y=2010), 250, 38)),
    ("Ordinance No. 0304-16.pdf", padded("ORDINANCE NO. 0304-16\nSeries of 2016\nAPPROVED: May 20, 2016\n", 200, 32)),
    ("Ordinance No. 0305-16.pdf", padded("A list of those who came, and of what was said of drains and pumps. ", 150, 27)),
    ("Ordinance No. 0306-16.pdf", padded("Stamped page, unread. ", 45, 8)),
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    rows = [(2016, n, f"data/raw/2016/{n}", t, "Digital", 1, 0, hashlib.sha256(t.encode()).hexdigest()) for n, t in ROWS]
    at = str(tmp_path_factory.mktemp("golden") / "records")
    audit(spark.createDataFrame(rows, CONTRACT)).write.parquet(at)
    return spark.read.parquet(at)


def test_statuses_methods_and_confidence(records):
    assert {r["temporal_status"]: r["n"] for r in report.status_counts(records).collect()} == {"valid": 7, "misfiled": 0, "out_of_scope": 1, "review": 0, "unresolved": 1}
    assert {r["extraction_method"]: r["n"] for r in report.method_counts(records).collect()} == {"Digital": 9, "Hybrid": 0, "OCR": 0}
    i = report.inventory(records).first()
    assert (i["documents"], round(i["mean_confidence"], 2), i["median_confidence"], i["single_signal"]) == (9, 0.78, 1.0, 2)


def test_duplicates_and_coverage(records):
    assert {r["kind"]: (r["groups"], r["files"]) for r in report.duplicate_totals(records).collect()} == {"hash": (1, 2), "number": (1, 3)}
    cover = {r["signal"]: (r["extracted"], r["documents"]) for r in report.signal_coverage(records).collect()}
    assert cover == {"Enactment date": (6, 9), "Ordinance number": (9, 9), "Series header": (7, 9), "Approval date": (7, 9)}


def test_text_statistics(records):
    t = report.text_statistics(records).first()
    assert (t["mean_chars"], t["median_chars"], t["mean_words"]) == (285, 241, 45)


def test_corpus(records):
    index = curate.corpus_index(curate.flag_removals(records, row_order="file_path"))
    kept = {r["filename"] for r in index.filter("included_in_corpus").collect()}
    assert kept == {"Ordinance No. 0301-16 signed.pdf", "Ordinance No. 0302-16.pdf", "Ordinance No. 0303-16.pdf"}
    assert index.count() == 9 and len(index.columns) == 19


def test_report(records):
    text = report.render_year(records, 2016)
    for said in ("| all documents | 9 | 100.0% |", "| valid | 7 | 77.8% |", "| Digital | 9 | 100.0% |", "Mean confidence 0.78, median 1.00; 2 resolved on a single signal", "equal files: 1 group(s), 2 file(s)", "equal numbers: 1 group(s), 3 file(s)", "| Enactment date | 6 / 9 | 66.7% |", "| Series header | 7 / 9 | 77.8% |", "| mean chars | 285 |", "| median chars | 241 |", "| mean words | 45 |"):
        assert said in text, said
    assert "too thinly" not in text
    assert records.filter(F.col("enactment_date").isNotNull()).count() == 6
