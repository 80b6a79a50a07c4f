import random
from collections import defaultdict

from statutor.llm.distinctive import index_terms

INDEX = "scan_seq long, title string, subject_keywords string, term string"


def few(spark, rows, most):
    d = spark.createDataFrame([(*r, "clash") for r in rows], INDEX)
    got = {(r["scan_seq"], r["term"]) for r in index_terms(d, most_records=most).filter(f"n_records BETWEEN 2 AND {most}").collect()}
    holds = defaultdict(set)
    for r in index_terms(d).collect():
        holds[r["term"]].add(r["scan_seq"])
    return got, {(i, t) for t, ids in holds.items() if 2 <= len(ids) <= most for i in ids}


def test_no_term_of_few_records_falls_short_of_the_floor(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(300)]
    heavy = [1 / (1 + k) for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, heavy, k=rng.randrange(1, 25))), " ".join(rng.choices(words, heavy, k=3)) * rng.choice([1, 1, 4])) for i in range(250)]
    rows += [(300, None, None), (301, "N/A", "; "), (None, "words here", ""), (5, rows[5][1], rows[5][2])]
    got, want = few(spark, rows, 5)
    assert got == want and len(want) > 100


def test_collections_of_one_term_and_of_none(spark):
    got, want = few(spark, [(1, "same", None), (2, "same", "")], 5)
    assert got == want == {(1, "same"), (2, "same")}
    assert few(spark, [(1, "", None)], 5) == (set(), set())
    assert few(spark, [], 5) == (set(), set())


def test_floor_leaves_common_terms_out(spark):
    rows = [(i, "everywhere " + ("rarity" if i < 3 else f"word{chr(97 + i % 20)}x"), None) for i in range(400)]
    d = spark.createDataFrame([(*r, "x") for r in rows], INDEX)
    kept = {r["term"] for r in index_terms(d, most_records=5).collect()}
    assert "rarity" in kept and "everywhere" not in kept
