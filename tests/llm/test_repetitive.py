import random

import numpy as np
from test_texts import brute_share

from statutor.llm.repetitive import POSSIBLE, WIDTH, fit_repetition_model, score_repetition, spliced, train

rng = random.Random(4)
VOCABULARY = ["".join(rng.choices("abcdefghijkl", k=rng.randrange(2, 9))) for _ in range(900)]


def text(n):
    out = []
    while len(out) < n:
        out += [*rng.choices(VOCABULARY, k=rng.randrange(5, 14)), "."]
    return " ".join(out)


def corpus(spark, n, first=0):
    rows = []
    for i in range(n):
        t = text(rng.randrange(20, 300))
        rows.append((first + i, (spliced(t, i) or t) if i % 3 == 0 else t))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_model_tells_held_out_texts_apart(spark):
    model = fit_repetition_model(corpus(spark, 600), "doc_id", "text")
    held = corpus(spark, 500, 10_000)
    got = {r["doc_id"]: r for r in score_repetition(held, "doc_id", "text", model).collect()}
    true = {r["doc_id"]: brute_share(r["text"]) for r in held.collect()}
    over = {i for i, (n, k) in true.items() if n >= 12 and k >= 0.4 * n}
    far = {i for i, (n, k) in true.items() if n >= 12 and not 0.3 < k / n < 0.5}
    assert over and {i for i in over if got[i]["verdict"] == "clean"} == set()
    likely = {i for i, r in got.items() if r["verdict"] == "repetitive"}
    assert likely & far == over & far
    brier = np.mean([(got[i]["probability"] - (i in over)) ** 2 for i in true])
    assert brier < 0.02
    for i, r in got.items():
        n, k = true[i]
        assert r["n_words"] == n and (r["share_repeated"] is None) == (r["probability"] < POSSIBLE)
        assert r["share_repeated"] is None or abs(r["share_repeated"] - k / max(1, n)) < 1e-12


def test_same_model_and_scores_however_rows_lie(spark):
    d = corpus(spark, 200)
    a, b = (sorted((r["doc_id"], r["verdict"], round(r["probability"], 6)) for r in score_repetition(d.repartition(k), "doc_id", "text").collect()) for k in (1, 5))
    assert a == b


def test_cases_at_the_edges(spark):
    part = text(30)
    texts = [None, "", "a", "!!!", "na " * 500, " ".join([part] * 40), part, "x" * 100_000, "İ" * 50, f"{part} " * 900]
    d = corpus(spark, 120).unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    d = d.selectExpr("doc_id", "text", "7 AS n_words", "'x' AS verdict")
    got = {r["doc_id"]: r for r in score_repetition(d.union(d), "doc_id", "text").collect()}
    assert len(got) == 130 and score_repetition(d.union(d), "doc_id", "text").count() == 260
    assert [got[1000 + i]["verdict"] for i in (0, 1, 2, 3)] == ["clean"] * 4
    assert [got[1000 + i]["verdict"] for i in (4, 5, 9)] == ["repetitive"] * 3
    assert got[1000]["n_words"] == 0 and got[1005]["share_repeated"] > 0.9
    assert score_repetition(d.filter("false"), "doc_id", "text").count() == 0
    null_key = score_repetition(spark.createDataFrame([(None, part)], "doc_id long, text string"), "doc_id", "text").collect()
    assert [r["doc_id"] for r in null_key] == [None]


def test_one_sided_samples():
    for y in (np.zeros(8), np.ones(8)):
        m = train(np.random.default_rng(1).random((8, WIDTH)), y, np.arange(8) % 2)
        assert np.isfinite(m.weights).all() and np.isfinite([m.bias, m.slope, m.shift]).all()
