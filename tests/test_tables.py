import hashlib
import re

from documents import ALL, frame
from pyspark.sql import functions as F

from statutor.operators import curate, duplicates, report, vault
from statutor.operators.audit import apply_overrides, audit, override_template
from statutor.plans.pipeline import Run, append_manifest, records, write, write_vault_files
from statutor.plans.views import live
from statutor.sources import documents as D
from statutor.sources import overrides as O
from statutor.sources.tables import ranked
from statutor.streaming.intake import audit_stream, stream

RECORD = "scan_seq long, filename string, file_path string, file_hash string, folder_year int, resolved_year int, ordinance_number string, confidence_score double, char_count int, temporal_status string, is_sparse boolean, manually_verified boolean"


def recs(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_duplicate_losers_are_independent_by_hash_and_number(spark):
    rows = [
        (1, "b.pdf", "p1", "H", 2016, 2017, "1-17", 1.0, 9, "valid", False, False),
        (2, "a.pdf", "p2", "H", 2017, 2017, "1-17", 1.0, 9, "valid", False, False),
        (3, "c.pdf", "p3", "K", 2017, 2017, "2-17", None, 5, "valid", False, False),
        (4, "d.pdf", "p4", None, 2017, 2017, "2-17", 0.5, None, "valid", False, False),
        (5, "e.pdf", "p5", None, 2017, 2017, None, 0.5, 1, "valid", False, False),
        (6, "f.pdf", "p6", "L", 2017, 2017, "3-17", 0.5, 7, "valid", False, False),
        (7, "g.pdf", "p7", "M", 2017, 2017, "3-17", 0.5, 7, "valid", False, False),
    ]
    got = {r["scan_seq"]: (r["loses_hash"], r["loses_number"]) for r in duplicates.duplicate_losers(recs(spark, rows)).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, True), 4: (False, False), 5: (False, False), 6: (False, False), 7: (False, True)}


def test_every_file_of_a_repeated_number_is_listed(spark):
    rows = [(i, f"f{i}", f"p{i}", "H", 2016, 2016, "N/A", 1.0, 9, "valid", False, False) for i in range(120)]
    rows += [(500, "x", "p", "H", 2016, None, "1-16", 1.0, 9, "valid", False, False), (501, "y", "p", "H", 2016, 2017, None, 1.0, 9, "valid", False, False), (502, "y", "p", "H", 2016, 2017, None, 1.0, 9, "valid", False, False)]
    parts = duplicates.listing(recs(spark, rows)).orderBy("part").collect()
    assert [(r["ordinance_number"], r["part"], r["n_files"]) for r in parts] == [("N/A", k, 120) for k in range(3)]
    assert ", ".join(r["files"] for r in parts) == ", ".join(f"f{i}" for i in range(120)) and {r["resolved_years"] for r in parts} == {"2016"}
    by_path = duplicates.listing(recs(spark, rows), row_order="file_path")
    assert sum(len(r["files"].split(", ")) for r in by_path.collect()) == 120
    got = duplicates.listed_files(recs(spark, rows)).orderBy("scan_seq").collect()
    assert [tuple(r) for r in got] == [("N/A", i, f"f{i}", 2016, 120) for i in range(120)]


def test_removal_and_index(spark):
    rows = [
        (1, "a", "p", "A", 2016, 2016, "1", 1.0, 9, "valid", False, False),
        (2, "b", "p", "A", 2016, 2016, "9", 1.0, 9, "valid", False, False),
        (3, "c", "p", "C", 2016, 2016, "2", 1.0, 9, "valid", True, True),  # verified but sparse
        (4, "d", "p", "D", 2016, 2010, "3", 1.0, 9, "out_of_scope", False, True),
        (5, "e", "p", "E", 2016, 2018, "4", 0.4, 9, "review", False, None),
        (6, "f", "p", "F", 2016, 2018, "5", 0.9, 9, "misfiled", False, None),
    ]
    d = curate.flag_removals(recs(spark, rows))
    assert {r["scan_seq"]: r["removal_reason"] for r in d.collect()} == {1: "", 2: "duplicate", 3: "", 4: "out_of_scope", 5: "", 6: ""}
    every = curate.flag_removals(recs(spark, rows), ("review", "misfiled"))
    assert {r["scan_seq"]: r["removal_reason"] for r in every.collect()} == {1: "", 2: "", 3: "", 4: "", 5: "low_confidence_review", 6: "misfiled"}
    i = {r["filename"]: (r["corpus_year"], r["included_in_corpus"]) for r in curate.corpus_index(d).collect()}
    assert i == {"a": (2016, True), "b": (2016, False), "c": (2016, False), "d": (2010, False), "e": (2016, True), "f": (2018, True)}
    assert [(r["filename"], r["eligible"]) for r in curate.relocation_plan(d).collect()] == [("f", True)]
    assert {r["quarantine_path"] for r in curate.removal_plan(d).collect()} == {"data/quarantine/duplicate/2016/b", "data/quarantine/out_of_scope/2016/d"}
    assert curate.flag_removals(recs(spark, [])).count() == 0


VERDICT = "override_id long, filename string, correct_year int, verified_by string, evidence string, note string, folder_year int, priority int"


def test_overrides(spark):
    v = spark.createDataFrame([
        (1, "Ordinance No. 0135-16.pdf", 2019, "ana", "scan", None, None, 0), (2, "Ordinance No. 0135-16.pdf", 2018, None, " ", None, 2016, 1),
        (3, " Ordinance No. 0116-16.pdf ", 2005, "ben", None, None, None, 0), (4, "Ordinance No. 0118-16.pdf", 1800, None, None, None, None, 9), (5, "Ordinance No. 0118-16.pdf", None, None, None, None, None, 9),
        (6, "Ordinance No. 0301-16.pdf", 2016, "eve", "", None, 2015, 3),
    ], VERDICT)
    d = audit(frame(spark))
    out = {r["filename"]: r for r in apply_overrides(d, v).collect()}
    a, b, c, e = (out[f"Ordinance No. {n}.pdf"] for n in ("0135-16", "0116-16", "0118-16", "0301-16"))
    assert (a["resolved_year"], a["temporal_status"], a["conflict_notes"], a["confidence_score"], a["agreeing_signals"]) == (2018, "misfiled", "manually verified", 1.0, 1)
    assert (b["resolved_year"], b["temporal_status"], b["is_misfiled"], b["conflict_notes"]) == (2005, "out_of_scope", True, "manually verified by ben")
    assert c["resolution_source"] == "consensus" and e["resolution_source"] == "consensus"
    assert len(out) == d.count()
    assert [tuple(r) for r in O.conflicts(v).collect()] == [("Ordinance No. 0135-16.pdf", 2, 2019, 2018)]
    t = override_template(d)
    assert {r["filename"] for r in t.collect()} == {"Ordinance No. 0230-10.pdf", "Ordinance No. 0999-16.pdf"}
    assert "signals E/O/S/A = 2010/2010/2010/2010" in t.filter("filename LIKE '%0230%'").first()["note"]


def test_override_files(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for n, body in (("manual_year_overrides.csv", "filename,correct_year\nx.pdf,2017\n"), ("manual_year_overrides_2016.csv", "filename,correct_year,evidence\nx.pdf,2018.0,seal\ny.pdf,18\n"), ("manual_year_overrides_TEMPLATE_2016.csv", "filename,correct_year\nx.pdf,2001\n")):
        (tmp_path / "data" / n).write_text(body)
    files = O.override_files(spark, str(tmp_path), 2016)
    assert [f.rsplit("/", 1)[1] for f in files] == ["manual_year_overrides.csv", "manual_year_overrides_2016.csv"]
    assert len(O.override_files(spark, str(tmp_path), 2016, str(tmp_path / "data"))) == 3
    d = O.read_overrides(spark, {files[0]: None, files[1]: 2016})
    assert {(r["filename"], r["folder_year"], r["correct_year"]) for r in O.merged(d).collect()} == {("x.pdf", None, 2017), ("x.pdf", 2016, 2018)}


PAGE = "page_id long, filename string, folder_year int, file_path string, page_index int, digital_text string, ocr_text string"


def test_documents_from_pages(spark):
    long = "d" * 120
    rows = [
        (1, "a", 2016, "p/a", 1, "second", None), (2, "a", 2016, "p/a", 0, " ", "scanned first"), (2, "a", 2016, "p/a", 0, " ", "scanned first"),
        (3, "b", 2016, "p/b", 0, long, "o" * 500), (4, "c", 2016, "p/c", 0, None, "x"), (5, "d", 2016, "p/d", 0, None, None),
    ]
    p = spark.createDataFrame(rows, PAGE)
    got = {r["file_path"]: (r["text"], r["extraction_method"], r["page_count"], r["ocr_page_count"]) for r in D.documents_from_pages(p).collect()}
    assert got == {"p/a": ("scanned first\nsecond", "Hybrid", 2, 1), "p/b": (long, "Digital", 1, 0), "p/c": ("x", "OCR", 1, 1), "p/d": ("", "Digital", 1, 0)}
    assert {r["file_path"]: r["extraction_method"] for r in D.page_counts(p).collect()} == {k: v[1] for k, v in got.items()}


def test_folder_scan_and_reader(spark, tmp_path):
    for y, n in (("2016", "a.pdf"), ("2016", "b.PDF"), ("2017", "c.pdf"), ("notes", "d.pdf")):
        (tmp_path / y).mkdir(exist_ok=True)
        (tmp_path / y / n).write_bytes(n.encode())
    files = D.scan_folders(spark, str(tmp_path))
    assert [r[0] for r in D.folder_years(files).collect()] == [2016, 2017]
    assert {r["filename"] for r in D.scan_folders(spark, str(tmp_path), [2016]).collect()} == {"a.pdf"}

    def reader(content):
        if content == b"a.pdf":
            raise ValueError
        return ["one", None]

    rows = D.read_pages(files, reader).orderBy("filename", "page_index").collect()
    assert [(r["filename"], r["page_index"], r["digital_text"]) for r in rows] == [("a.pdf", None, None), ("c.pdf", 0, "one"), ("c.pdf", 1, "")]
    assert rows[0]["error"] == "ValueError: " and rows[1]["error"] is None


def test_from_folders_of_files_to_records(spark, tmp_path):
    """Scan, readers in their order, a recogniser of pages, documents and records, with the files' own hashes."""
    bodies = {"2016/Ordinance No. 0116-16.pdf": b"digital", "2016/blank one.pdf": b"blank1", "2016/blank two.pdf": b"blank2", "2016/broken.pdf": b"broken", "2017/scan.pdf": b"scan", "2017/copy of scan.pdf": b"scan"}
    for name, body in bodies.items():
        (tmp_path / "raw" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "raw" / name).write_bytes(body)
    read = spark.sparkContext.accumulator(0)

    def first(content):
        raise RuntimeError("no such backend")

    def second(content):
        read.add(1)
        if content == b"broken":
            raise ValueError("bad file")
        return {b"digital": ["ORDINANCE NO. 0116-16\n" + "a rule of stalls " * 20], b"scan": ["", "p" * 150]}.get(content, ["", " "])

    def ocr(content, index):
        if content == b"scan":
            return f"Series of 2017, page {index}. " + "scanned words " * 12
        raise OSError

    files = D.scan_folders(spark, str(tmp_path / "raw"))
    pages = D.read_pages_once(files, str(tmp_path / "pages"), [first, second], ocr)
    docs = D.documents_from_pages(pages)
    got = {r["filename"]: r for r in audit(docs).collect()}
    assert {n: got[n.split("/")[1]]["file_hash"] for n in bodies} == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}
    assert [(got[n]["extraction_method"], got[n]["page_count"], got[n]["ocr_page_count"]) for n in ("scan.pdf", "Ordinance No. 0116-16.pdf", "broken.pdf")] == [("Hybrid", 2, 1), ("Digital", 1, 0), ("Digital", 0, 0)]
    assert pages.filter("filename = 'broken.pdf'").first()["error"] == "RuntimeError: no such backend; ValueError: bad file"
    assert got["scan.pdf"]["detected_series_year"] == 2017 and got["broken.pdf"]["temporal_status"] == "unresolved"
    flagged = {r["filename"]: r["removal_reason"] for r in curate.flag_removals(audit(docs), row_order="file_path").collect()}
    assert flagged["blank one.pdf"] == flagged["blank two.pdf"] == "sparse_or_unreadable"  # blank scans are no copies of each other
    assert sorted(flagged[n] for n in ("scan.pdf", "copy of scan.pdf")) == ["", "duplicate"]
    once = read.value
    assert D.read_pages_once(files, str(tmp_path / "pages"), [first, second], ocr).count() == pages.count()
    assert read.value == once > 0  # nothing is read again
    assert D.read_pages_once(files, str(tmp_path / "pages"), [first, second]).filter("ocr_text != ''").count() == 0


def test_pages_without_bytes_have_no_hash(spark):
    p = spark.createDataFrame([(1, "a", 2016, "p/a", 0, "", None), (2, "b", 2016, "p/b", 0, None, " ")], PAGE)
    assert [r["file_hash"] for r in D.documents_from_pages(p).collect()] == [None, None]
    known = spark.createDataFrame([("p/a", " AB "), ("p/a", "CD"), ("p/b", " "), ("p/b", None)], "file_path string, file_hash string")
    assert {r["file_path"]: r["file_hash"] for r in D.documents_from_pages(D.with_file_hashes(p, known)).collect()} == {"p/a": "ab", "p/b": None}


def test_ranks_of_a_group_that_is_most_of_the_table(spark):
    rows = [("hot", i * 7 % 1000) for i in range(1000)] + [("cold", i) for i in range(9)] + [(None, 5), (None, None)]
    d = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = sorted((r["k"] or "", -1 if r["v"] is None else r["v"], r["place"]) for r in ranked(d, ["k"], ["v"]).collect())
    want = sorted([("hot", i, i) for i in range(1000)] + [("cold", i, i) for i in range(9)] + [("", -1, 0), ("", 5, 1)])
    assert got == want


def test_bronze_round_trip(spark, tmp_path):
    d = frame(spark)
    back = D.bronze(d, str(tmp_path / "bronze"))
    assert back.columns == d.columns and back.count() == d.count()


def test_report_of_fixture(spark):
    d = audit(frame(spark))
    assert {r["temporal_status"]: r["n"] for r in report.status_counts(d).collect()} == {"valid": 6, "misfiled": 0, "out_of_scope": 1, "review": 0, "unresolved": 1}
    i = report.inventory(d).first()
    assert (i["documents"], i["single_signal"], i["numbered_by_filename"]) == (8, 2, 8)
    text = report.render_year(d, 2016)
    assert "| valid | 6 | 75.0% |" in text and "Ordinance No. 0230-10.pdf" in text
    assert report.render_year(d, 1999).endswith("No documents found.")
    assert "| 2016 | 6 | 0 | 1 | 0 | 1 | 8 |" in report.render_corpus(d)
    assert set(report.figures(d)) == {"status", "years", "coverage", "corpus"}
    empty = audit(frame(spark, []))
    assert [r["n"] for r in report.status_counts(empty).collect()] == [0] * 5
    assert report.signal_coverage(empty).first()["coverage"] == 0.0


def test_run_writes_everything(spark, tmp_path):
    out = str(tmp_path / "out")
    places = write(frame(spark), out, Run(vault=True, template=True, reports=[2016]))
    assert spark.read.parquet(places["records"]).count() == 8
    assert spark.read.option("header", True).csv(places["summary"]).columns[-1] == "removal_reason"
    assert len(spark.read.option("header", True).csv(places["corpus_index"]).columns) == 19
    v = {r["path"]: r["content"] for r in spark.read.parquet(places["vault"]).collect()}
    note = v["2016/Ordinance No. 0118-16.md"]
    assert note.startswith("---\ntitle: \"AN ORDINANCE AMENDING") and "- [[Ordinance No. 0234-15]]" in note and "## Cleaned text" in note
    assert 'aliases: ["Ordinance No. 0118-16", "0118-16"]' in note and "type/amendatory" in note
    assert sum(p.startswith("2016/Ordinance No. 0116-16") for p in v) == 2  # neither of two is overwritten
    assert (tmp_path / "out" / "report_corpus.md").exists()
    plan = spark.read.parquet(places["plan_removal"])
    append_manifest(plan, str(tmp_path / "manifest"))
    append_manifest(plan, str(tmp_path / "manifest"))
    back = curate.restore_plan(spark.read.parquet(str(tmp_path / "manifest")))
    assert back.count() == plan.select("quarantine_path").distinct().count() > 0


def test_report_of_a_run_lists_repeated_numbers(spark, tmp_path):
    out = str(tmp_path / "out")
    places = write(frame(spark), out, Run(reports=[2016], all_years=True))
    d = spark.read.parquet(places["records"]).filter("folder_year = 2016")
    want = duplicates.listing(d, "file_path").collect()
    text = (tmp_path / "out" / "report_2016.md").read_text(encoding="utf-8")
    assert want and all(f"| {r['ordinance_number']} | {r['n_files']} | {r['files']} | {r['resolved_years']} |" in text for r in want)
    whole = spark.read.parquet(f"{out}/report_2016_duplicates").collect()
    assert sorted(r["files"] for r in whole) == sorted(r["files"] for r in want)
    assert spark.read.parquet(f"{out}/report_2016_review").count() == 1
    assert text.index("## 1.") < text.index("## 2.") < text.index("| Ordinance No. |") < text.index("## 3.") < text.index("## 4.") < text.index("## 5.")
    short = report.render_year(d, 2016, listed=0)
    assert "the table report_2016_duplicates has all" in short


def test_run_takes_the_years_it_is_asked_for(spark, tmp_path):
    docs = frame(spark, [(y, f"Ordinance No. 0001-{y % 100}.pdf", "text") for y in (2009, 2016, 2024, 2025)])
    took = lambda run: sorted(r["folder_year"] for r in records(docs, run).collect())
    assert took(Run()) == [2016, 2024] and took(Run(all_years=True)) == [2009, 2016, 2024, 2025] and took(Run(years=[2025])) == [2025]


def test_plans_are_in_order_and_move_the_path(spark, tmp_path):
    places = write(frame(spark), str(tmp_path), Run(purge=True, sample=3))
    plan = spark.read.parquet(places["plan_removal"]).collect()
    assert [(r["removal_reason"], r["filename"]) for r in plan] == sorted((r["removal_reason"], r["filename"]) for r in plan)
    paths = {r["filename"]: r["file_path"] for r in spark.read.option("header", True).csv(places["corpus_index"]).collect()}
    assert plan and all(paths[r["filename"]] == r["quarantine_path"] for r in plan)
    assert spark.read.parquet(places["plan_purge"]).filter("action = 'purge'").count() == len(plan)
    assert spark.read.json(places["headers"]).count() == 3
    texts = spark.read.parquet(places["clean_text"])
    assert texts.join(spark.read.parquet(places["records"]).select("clean_text_path"), "clean_text_path").count() == texts.count() == 8


def test_live_queries_are_sorted(spark):
    d = audit(frame(spark)).withColumns({"corpus_year": F.col("folder_year")})
    got = [r["confidence_score"] for r in live(d, "thin_evidence").collect()]
    assert got == sorted(got) and len(got) == 2 and "resolution_source" in live(d, "thin_evidence").columns
    got = [r["confidence_score"] for r in live(d, "needs_attention").collect()]
    assert got == sorted(got)


def test_notes_without_number_or_year_and_links_to_equal_names(spark, tmp_path):
    d = curate.flag_removals(audit(frame(spark)), row_order="file_path")
    d = curate.with_corpus_year(d).withColumns({"ordinance_number": F.when(F.col("filename").contains("0135"), None).otherwise(F.col("ordinance_number")), "filename": F.when(F.col("filename").contains("0135"), None).otherwise(F.col("filename"))})
    d = d.withColumns({c: F.when(F.col("filename").isNull(), None).otherwise(F.col(c)) for c in ("corpus_year", "folder_year")})
    n = vault.named(d, "file_path")
    pages = vault.notes(n, order="file_path").withColumn("part", F.lit(0))
    assert pages.count() == pages.select("path").distinct().count() == len(ALL)
    parts = vault.year_indices(n, "file_path", size=3)
    vault_table = pages.unionByName(parts)
    write_vault_files(vault_table, str(tmp_path / "vault"))
    write_vault_files(vault_table, str(tmp_path / "vault"))
    files = {str(p.relative_to(tmp_path / "vault")): p.read_text(encoding="utf-8") for p in (tmp_path / "vault").rglob("*.md")}
    assert "undated/untitled.md" in files and "undated/_Index undated.md" in files
    index = files["2016/_Index 2016.md"]
    linked = re.findall(r"^\| \[\[(.+?)\]\]", index, re.MULTILINE)
    assert len(linked) == len(set(linked)) == 6 and all(f"2016/{x}.md" in files for x in linked)
    names = [r["filename"] for r in d.filter("corpus_year = 2016").orderBy("filename").collect()]
    assert len(names) == 6 and index.startswith("---\ntitle: \"Ordinance index 2016\"") and index.rstrip().endswith("Back to [[_Corpus MOC]]")


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    d = frame(spark)
    d.repartition(3).write.parquet(str(tmp_path / "in"))
    q = audit_stream(stream(spark, str(tmp_path / "in"), d.schema, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    cols = ["filename", "temporal_status", "resolved_year", "title"]
    got, want = (sorted(map(repr, x.select(cols).collect())) for x in (spark.read.parquet(str(tmp_path / "out")), audit(d)))
    assert got == want


def test_citation_edges(spark):
    d = spark.createDataFrame([(1, "1-16", "2-16; 3-16; 2-16"), (2, "2-16", ""), (3, None, None)], "scan_seq long, ordinance_number string, cited_ordinances string")
    assert {tuple(r) for r in vault.citation_edges(d).collect()} == {(1, "1-16", "2-16", True), (1, "1-16", "3-16", False)}


def test_entry_imports_without_training_data_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    names = set(e.queries())
    assert {"crosstab", "consensus", "corpus_index"} <= names
    assert set(e.oracle_sql()) <= names
    monkeypatch.setitem(sys.modules, "statutor.llm", None)
    e = importlib.reload(e)
    assert not any(n[0] == "p" and n[1].isdigit() for n in e.queries())
    monkeypatch.undo()
    importlib.reload(e)


def test_vault_of_nothing(spark):
    d = curate.flag_removals(audit(frame(spark, [])), row_order="file_path").withColumns({"corpus_year": F.col("folder_year"), "included_in_corpus": F.lit(True)})
    assert vault.notes(d, order="file_path").count() == 0
    assert vault.year_indices(d, "file_path").count() == 0
