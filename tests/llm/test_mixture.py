from collections import Counter

import numpy as np
import pytest

from statutor.llm.mixture import EXACT_DRAW, _split, check_mix, draw_shards, encoding, mix, mix_texts, permuted, quotas

DOCS = "doc_id long, source string, text string"


def documents(spark, sizes):
    rows, k = [], 0
    for source, n, words in sizes:
        for _ in range(n):
            rows.append((k, source, f"document {k} " + "walks along the river road " * words))
            k += 1
    return spark.createDataFrame(rows, DOCS)


def test_permutation():
    for n in (1, 2, 7, 1000, 4097):
        for key in (1, 99):
            assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    assert list(permuted(np.arange(50), np.full(50, 50), np.full(50, 1))) != list(range(50))


def test_quotas_and_draws():
    q = quotas({"a": 10_000, "b": 1_000}, {"a": (0.5, 1), "b": (0.3, 2), "none": (0.2, 9)}, 10)
    assert q == {"a": 333, "b": 200}
    rows = list(draw_shards(q, 50, 3))
    assert [r[0] for r in rows] == list(range(11))
    done = np.zeros(2, np.int64)
    for _, own, first in rows:
        assert (first == done).all() and own.sum() in (50, 33)
        done += own
    assert list(done) == [333, 200] and len({tuple(r[1]) for r in rows}) > 1
    alone = [r for k in range(0, 11, 4) for r in draw_shards(q, 50, 3, k, k + 4)]
    assert repr(alone) == repr(rows)
    assert list(draw_shards({}, 50, 3)) == []


def test_draws_of_more_slots_than_can_be_drawn_exactly():
    counts = np.array([6 * EXACT_DRAW, 0, 3 * EXACT_DRAW, 5], np.int64)
    got = _split(np.random.default_rng(1), counts, int(counts.sum() // 3))
    assert got.sum() == counts.sum() // 3 and (got <= counts).all() and (got >= 0).all()
    assert abs(got[0] / got[2] - 2) < 1e-3


def test_shares_and_repeats(spark):
    docs = documents(spark, [("A", 60, 20), ("b ", 30, 12), ("B", 20, 6), (None, 5, 5), ("other", 5, 5)])
    docs = docs.union(spark.createDataFrame([(900, "A", None), (901, "A", ""), (None, "A", "x"), (0, "A", "document 0")], DOCS))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("empty", 0.1, 2)], "source string, target_share double, max_repeats int")
    m, report = mix(docs, targets, block_tokens=32, shard_slots=16)
    r = {x["source"]: x for x in report.collect()}
    rows = m.collect()
    block = 32 / sum(len(x["tokens"]) for x in rows)
    assert abs(r["a"]["actual_share"] - 0.5 / 0.9) <= block and abs(r["b"]["actual_share"] - 0.4 / 0.9) <= block
    assert (r["empty"]["used_tokens"], r["other"]["used_tokens"], r[None]["n_documents"]) == (0, 0, 5)
    assert len({(x["shard"], x["slot"]) for x in rows}) == len(rows)
    uses, limit = Counter(), {"a": 1, "b": 3}
    texts = {x["doc_id"]: x["text"] for x in docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").collect() if x["doc_id"] or len(x["text"]) > 20}
    enc = encoding()
    own = {d: enc.encode_ordinary(t) for d, t in texts.items()}
    for x in rows:
        place = 0
        for s in x["segments"]:
            assert s["position"] == place
            assert x["tokens"][place : place + s["to_token"] - s["from_token"]] == own[s["doc_id"]][s["from_token"] : s["to_token"]]
            place += s["to_token"] - s["from_token"]
            for t in range(s["from_token"], s["to_token"]):
                uses[x["source"], s["doc_id"], t] += 1
        assert place == len(x["tokens"]) == 32
    assert all(n <= limit[s] for (s, _, _), n in uses.items()) and max(uses.values()) == 2
    check = check_mix(m, report, 32).collect()
    assert len(check) == 5 and all(x["meets_target"] and x["within_repeats"] and x["none_twice"] and x["full_blocks"] for x in check)
    broken = check_mix(m.filter("use_no = 1"), report, 32).filter("NOT meets_target").count()
    assert broken == 1


def test_texts_of_a_mix_are_whole(spark):
    words = "ñandú €uro 漢字 🙂🙃 ﬁsh plain words "
    docs = spark.createDataFrame([(k, "s", f"{k} {words * (3 + k)}") for k in range(9)] + [(0, "s", "x")], DOCS)
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    m, _ = mix(docs, targets, block_tokens=7, shard_slots=5)
    parts = [(s["doc_id"], s["from_token"], x["shard"], x["slot"], s["position"]) for x in m.collect() for s in x["segments"]]
    rows = mix_texts(m).collect()
    assert len(rows) == len(parts) and len({(r["shard"], r["slot"], r["position"]) for r in rows}) == len(rows)
    text = {(r["shard"], r["slot"], r["position"]): r["text"] for r in rows}
    whole = {}
    for d, _, *at in sorted(parts):
        whole[d] = whole.get(d, "") + text[tuple(at)]
    want = {k: f"{k} {words * (3 + k)}" for k in range(9)}
    cut_off = [d for d in want if whole.get(d) != want[d]]
    assert len(cut_off) <= 1 and all(want[d].startswith(whole.get(d, "").rstrip("\ufffd")) for d in cut_off)  # the end that fills no block
    assert "\ufffd" not in "".join(whole[d] for d in want if d not in cut_off)


def test_repeatable(spark):
    docs = documents(spark, [("a", 20, 5), ("b", 20, 5)])
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.7, 2)], "source string, target_share double, max_repeats int")
    a, b = (sorted(map(repr, mix(docs.repartition(n), targets, 16, 8)[0].collect())) for n in (1, 5))
    assert a == b


@pytest.mark.parametrize("what", ["documents", "targets"])
def test_empty(spark, what):
    docs, targets = documents(spark, [("a", 2, 2)]), spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    m, report = mix(docs.filter("false") if what == "documents" else docs, targets.filter("false") if what == "targets" else targets)
    assert m.count() == 0 and report.count() == 1


def test_a_source_of_most_rows_is_packed_in_buckets(spark):
    from pyspark.sql import functions as F

    from statutor.llm.mixture import pack, tokenised

    docs = documents(spark, [("big", 400, 10), ("small", 20, 10)])
    tokens = tokenised(docs, "doc_id", "text", ["source"])
    totals = {r[0]: r[1] for r in tokens.groupBy("source").agg(F.sum("n_tokens")).collect()}
    quota = {s: n // 64 for s, n in totals.items()}
    blocks = pack(tokens, totals, quota, 64, 1, bucket_tokens=500)
    rows = {(r["source"], r["block"]): r["pieces"] for r in blocks.collect()}
    assert set(rows) == {(s, b) for s, n in quota.items() for b in range(n)}
    assert all(sum(p["to_token"] - p["from_token"] for p in x) == 64 for x in rows.values())
    used = Counter((p["doc_id"], t) for x in rows.values() for p in x for t in range(p["from_token"], p["to_token"]))
    assert max(used.values()) == 1 and len(used) == 64 * sum(quota.values())
