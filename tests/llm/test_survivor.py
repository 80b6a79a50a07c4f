import random

from pyspark.sql import functions as F

from statutor.llm.components import components
from statutor.llm.distinctive import distinctive_terms, index_terms
from statutor.llm.survivor import group_records, number_key, ordinance_survivors, survivors


def test_number_keys(spark):
    cases = {"0116-16": "116-2016", "Ordinance No. 0116, Series of 2016": "116-2016", "0116 - 16": "116-2016", "O116-l6": "116-2016", "No. 0116-2016": "116-2016", "ORD. NO. 116-16": "116-2016", "0116/16": "116-2016",
             "0116_16": "116-2016", "0116–16": "116-2016", " 0116-16 ": "116-2016", "００３１-１７": "31-2017", "0021-95": "21-1995", "N/A": None, "": None, None: None, "none": None}
    d = spark.createDataFrame([(k,) for k in cases], "n string").select("n", number_key(F.col("n")).alias("k"))
    assert {r["n"]: r["k"] for r in d.collect()} == cases


def test_components_against_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1120)] + [(5000, k) for k in range(5001, 5300)] + [(None, 3), (7000, 7000)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


SUMMARY = "scan_seq long, run_at timestamp, ordinance_number string, file_hash string, char_count int, confidence_score double, page_count int, title string, approval_date string"


def summary(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(s, datetime(2024, 1, d), *rest) for s, d, *rest in rows], SUMMARY)


def test_survivors(spark):
    d = summary(spark, [
        (1, 1, "1-16", "AA", 9, 0.9, 2, "UNTITLED", ""), (2, 2, "Ordinance No. 0001, Series of 2016", None, 9, 0.9, 3, None, " "), (3, 3, None, "aa", 9, 100.0, 9, "AN ORDINANCE", "2016-01-02"),
        (4, 1, "2-16", "EE", 0, None, None, "x y", None), (5, 1, None, "ee", 0, 0.5, 1, "lone", None), (6, 1, "", "  ", 9, 0.5, 1, None, None), (7, 2, "N/A", "", 9, 0.5, 1, None, None), (1, 1, "1-16", "AA", 9, 0.9, 2, "UNTITLED", ""),
    ])
    got = {r["group_seq"]: r for r in ordinance_survivors(d).collect()}
    assert sorted(got) == [1, 4, 5, 6, 7]
    g = got[1]
    assert (g["n_records"], g["best_seq"], g["title"], g["title_seq"], g["approval_date_seq"]) == (3, 2, "AN ORDINANCE", 3, 3)
    assert (g["confidence_score"], g["page_count"], g["page_count_seq"]) == (0.9, 3, 2)
    assert (got[6]["title"], got[6]["title_seq"]) == (None, 0)
    assert ordinance_survivors(d.filter("false")).count() == 0


def test_ties_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, 3, 5), (1, 2, 5), (1, 4, None), (None, 9, 1)], "g long, seq long, low int")
    r = survivors(d, "g", [F.col("low")], "seq", {"low": (F.col("low").isNotNull(), F.col("low"))}).collect()
    assert [(x["g"], x["n_records"], x["best_seq"], x["low"], x["low_seq"]) for x in r] == [(1, 3, 2, 5, 2)]
    extra = d.withColumns({"n_records": F.lit("x"), "_order": F.lit(1), "group_seq": F.lit("y")})
    got = group_records(extra.withColumnRenamed("g", "key"), "seq", {"k": F.col("key")})
    assert {r["seq"]: r["group_seq"] for r in got.collect()} == {2: 2, 3: 2, 4: 2, 9: 9}
    assert got.columns.count("group_seq") == 1


def test_distinctive_terms_by_hand(spark):
    from math import log, sqrt

    d = spark.createDataFrame([(1, "Fishing boats boats", None), (1, "fishing BOATS boats", None), (2, "fishing nets", "nets; rope"), (3, None, ""), (None, "fishing", "")], "id long, a string, b string")
    got = {(r["id"], r["term"]): r for r in distinctive_terms(d, "id", [F.col("a"), F.col("b")], prior=10.0).collect()}
    assert set(got) == {(1, "fishing"), (1, "boats"), (2, "fishing"), (2, "nets"), (2, "rope")}
    assert got[1, "boats"]["n_in_record"] == 2 and got[1, "fishing"]["n_records"] == 2
    # 7 words in all; record 1 has 3 of them, two of them boats
    a = 10 * 2 / 7
    odds = log((2 + a) / (3 + 10 - 2 - a)) - log((0 + a) / (7 - 3 + 10 - 0 - a))
    assert abs(got[1, "boats"]["z"] - odds / sqrt(1 / (2 + a) + 1 / a)) < 1e-9
    assert got[1, "boats"]["z"] > got[1, "fishing"]["z"]


def test_hot_terms_and_empty_tables(spark):
    d = spark.createDataFrame([(k, f"common rare{chr(97 + k % 26) * 3}", "common") for k in range(300)], "scan_seq long, title string, subject_keywords string")
    out = index_terms(d)
    assert out.filter("term = 'common'").count() == 300 and out.count() == 600
    assert index_terms(d.filter("false")).count() == 0
    stand_ins = spark.createDataFrame([(1, "UNTITLED", None), (2, "(no title)", "n/a")], "scan_seq long, title string, subject_keywords string")
    assert index_terms(stand_ins).count() == 0


def test_a_key_on_a_third_of_all_rows(spark):
    rows = [(k, 1, "7-16" if k % 3 == 0 else f"{k}-17", "AA" if k % 3 == 1 else None, 9, 0.5, k, None, None) for k in range(1, 3001)]
    got = {r["group_seq"]: r for r in ordinance_survivors(summary(spark, rows)).collect()}
    assert (got[3]["n_records"], got[3]["best_seq"]) == (1000, 3000) and (got[1]["n_records"], got[1]["best_seq"]) == (1000, 2998)
    assert len(got) == 1002
