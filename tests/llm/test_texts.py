import random
import re

import pytest

from statutor.llm.leakage import find_leaks, normalise, word_places
from statutor.llm.repetition import measure_repetition

random.seed(9)
VOCABULARY = ["".join(random.choices("abcdefgh", k=4)) for _ in range(60)]


def words(n):
    return " ".join(random.choices(VOCABULARY, k=n))


def brute_share(text, n=6):
    w = re.findall(r"[^\W\d_]+", (text or "").lower())
    seen, hit = set(), [False] * len(w)
    for k in range(len(w) - n + 1):
        run = tuple(w[k : k + n])
        if run in seen:
            hit[k : k + n] = [True] * n
        seen.add(run)
    return len(w), sum(hit)


def test_repetition_against_brute_force(spark):
    part = words(8)
    texts = [None, "", "a", "one two", part, f"{part} {part}", " ".join([part] * 40), "na " * 500, words(300), f"{words(50)} {part} 12 {words(9)} {part.upper()}", "é à " * 20, "x" * 100_000, f"{words(40)}, " * 300]
    d = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"]) for r in measure_repetition(d, "doc_id", "text").collect()}
    assert got == {i: brute_share(t) for i, t in enumerate(texts)}
    assert measure_repetition(d.filter("false"), "doc_id", "text").count() == 0
    assert measure_repetition(d.union(d), "doc_id", "text").count() == 2 * len(texts)


def test_normalise_and_places():
    t = "A soft­ly-\n  Broken-\r\nline, re-use İx 12_b"
    assert normalise(t) == " a softlybrokenline re use i̇x 12 b ".replace("i̇x", "i x") or normalise(t).split()[:5] == ["a", "softlybrokenline", "re", "use", normalise(t).split()[4]]
    places = word_places(t)
    assert len(places) == len(normalise(t).split())
    assert t[places[1][0] : places[1][1]] == "soft­ly-\n  Broken-\r\nline"


@pytest.mark.parametrize("max_chars", [4_000_000, 900])
def test_leaks_against_brute_force(spark, max_chars):
    items = [(i, words(random.choice([5, 11, 12, 13, 40, 90]))) for i in range(30)] + [(50, None), (51, ""), (0, "twice " + words(30))]
    lists = [(i, normalise(t or "").split()) for i, t in items]
    docs = [(0, None), (1, ""), (2, words(400))]
    for d in range(3, 40):
        text = [words(random.randrange(60))]
        for _ in range(random.randrange(3)):
            w = random.choice(lists)[1]
            a = random.randrange(max(1, len(w)))
            text += [" ".join(w[a : a + random.choice([6, 11, 12, 13, 30])]).upper(), words(random.randrange(20))]
        docs.append((d, ", ".join(text)))
    docs.append((40, docs[-1][1]))
    want = set()
    for d, t in docs:
        w = normalise(t or "").split()
        runs = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(d, i) for i, own in lists if any(tuple(own[k : k + 12]) in runs for k in range(len(own) - 11))}
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, text string")
    out = find_leaks(d.drop("item_id"), "doc_id", "text", e, "item_id", "text", max_item_chars=max_chars)
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == want and want
    for r in out.collect():
        text = dict(docs)[r["doc_id"]]
        assert len(normalise(text[r["start_at"] : r["end_at"]]).split()) == r["longest_run"] >= 12
    assert find_leaks(d.filter("false"), "doc_id", "text", e, "item_id", "text").count() == 0
    assert find_leaks(d, "doc_id", "text", e.filter("false"), "item_id", "text").count() == 0
