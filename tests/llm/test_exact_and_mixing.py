import hashlib
import random
from collections import Counter, defaultdict

from llm_helpers import words
from pyspark.sql import functions as F

from fixity_spark.llm import exact, mixing
from fixity_spark.llm.exact import CuckooIndex


def test_index_inserts_finds_deletes_and_grows():
    index, keys = CuckooIndex(buckets=2), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert([k, i])
    assert index.resizes > 0 and index.live == 3000
    assert all(index.find(k)[1] == i for i, k in enumerate(keys))
    for k in keys[::2]:
        assert index.delete(k)
    assert not index.delete(keys[0]) and index.live == 1500
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))
    assert sorted(x[1] for x in index.entries()) == list(range(1, 3000, 2))


def test_index_verifies_fingerprints():
    index = CuckooIndex(buckets=2)
    one = b"\x01\x02" + bytes(30)
    index.insert([one, 1])
    assert index.find(one[:-1] + b"\x09") is None  # same fingerprint and buckets, other key


def test_messy_groups(messy):
    rows = exact.exact_duplicates(messy).collect()
    assert len(rows) == 13
    got = sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id is not None)
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(1, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True), (3, 4, 3, False), (4, 4, 3, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True)]
    assert {(r.keep_id, r.kept) for r in rows if r.doc_id is None} == {(None, True), (4, False)}


def test_drop_keeps_columns_and_one_of_each(messy):
    out = exact.drop_exact_duplicates(messy)
    assert out.columns == messy.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect() if r.doc_id is not None) == [(False, i) for i in (2, 4, 5, 6, 7, 8, 9, 10)]
    assert out.where("doc_id IS NULL").count() == 1


def test_empty_tables(none):
    assert exact.exact_duplicates(none).count() == 0
    assert exact.drop_exact_duplicates(none).count() == 0
    assert mixing.mix_report(none).count() == 0
    assert mixing.mix_documents(none).count() == 0


def targets(sizes, weights=(1, 2, 3), most=3):
    """Shares of the total by weight, capped, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def test_targets_by_resharing(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 5, 100, 5000]) for s in [None, "", "B", "a", "é", "z"]}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
        want = targets(sizes)
        assert {r.source: round(r.target, 6) for r in got.collect()} == {s: round(t, 6) for s, t in want.items()}


def test_messy_mix(messy, messy_rows):
    rows = mixing.mix_report(messy).collect()
    assert len(rows) == 13
    assert sorted(r["size"] for r in rows) == sorted(len(words(r[1])) for r in messy_rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)


def test_mix_comes_near_targets_and_reruns_agree(sample):
    first = mixing.mix_report(sample).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, mixing.mix_report(sample.repartition(5)).collect()), key=str)
    taken, goal, top = defaultdict(int), {}, defaultdict(int)
    for r in first:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        top[r.source] = max(top[r.source], r["size"])
    assert all(abs(taken[s] - goal[s]) <= 2 * top[s] for s in goal)


def test_documents_are_repeated_as_reported(sample):
    out = mixing.mix_documents(sample)
    assert out.columns == sample.columns
    want = {r.doc_id: r.copies for r in mixing.mix_report(sample).collect() if r.copies}
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == want


def test_ties_share_one_offset(spark):
    docs = spark.createDataFrame([(i, "a b c", s) for i, s in enumerate(["x"] * 30 + ["y"] * 30)], "doc_id long, text string, source string")
    got = mixing.mix_report(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 3 for r in got)
