import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixity_spark.llm import toxicity


def brute_marginals(scores, begins, moves):
    """Marginals by summing over all labellings of each chain."""
    out, cuts = [], [*[k for k, b in enumerate(begins) if b], len(scores)]
    for a, b in itertools.pairwise(cuts):
        mass = np.zeros((b - a, 2))
        for ys in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(scores[a + k] * y for k, y in enumerate(ys)) + sum(moves[x, y] for x, y in itertools.pairwise(ys)))
            for k, y in enumerate(ys):
                mass[k, y] += w
        out += list(mass[:, 1] / mass.sum(axis=1))
    return np.array(out)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12])
def test_marginals_equal_the_sum_over_labellings(n):
    rng = np.random.default_rng(n)
    scores, moves = rng.normal(0, 3, 3 * n), rng.normal(0, 2, (2, 2))
    begins = np.zeros(3 * n, bool)
    begins[[0, n, n + n // 2 if n > 1 else 2]] = True
    p, _ = toxicity.marginals(scores, begins, moves)
    assert np.allclose(p, brute_marginals(scores, begins, moves), atol=1e-12)


def test_marginals_of_extreme_scores_and_long_chains():
    scores = np.tile([500.0, -500.0, 0.0], 20_000)
    begins = np.zeros(len(scores), bool)
    begins[0] = True
    p, _ = toxicity.marginals(scores, begins, np.array([[2.0, -1.0], [-1.0, 2.0]]))
    assert np.isfinite(p).all() and (p[::3] > 0.999).all() and (p[1::3] < 0.001).all()
    one, _ = toxicity.marginals(scores[:300], begins[:300], np.zeros((2, 2)))
    assert np.allclose(one, 1 / (1 + np.exp(-np.clip(scores[:300], -700, 700))))


def test_moves_are_expected_as_often_as_summed():
    rng = np.random.default_rng(9)
    scores, moves = rng.normal(0, 1, 6), rng.normal(0, 1, (2, 2))
    begins = np.array([True, False, False, False, False, False])
    _, pairs = toxicity.marginals(scores, begins, moves, pairs=True)
    mass, total = np.zeros((2, 2)), 0.0
    for ys in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(s * y for s, y in zip(scores, ys, strict=True)) + sum(moves[x, y] for x, y in itertools.pairwise(ys)))
        total += w
        for x, y in itertools.pairwise(ys):
            mass[x, y] += w
    assert np.allclose(pairs, mass / total)


BAD = ["vorgal", "snarfik", "blormish"]


def made(seed, n, noise=0.0):
    """(doc_id, text, toxic): toxic texts hold bad words; a bad word between quiet ones is no offence."""
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('bcdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice('aeiou')}{k}" for k in range(300)]
    out = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = rng.choices(vocabulary, k=rng.randrange(5, 80))
        for _ in range(rng.randrange(1, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "!!", "."]))
        out.append((seed * 100_000 + i, " ".join(words), toxic if rng.random() >= noise else 1 - toxic))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = made(1, 1500, noise=0.02)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels, {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}


def test_held_out_documents(scored):
    rows, _, _, got = scored
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r.doc_id for r in got.values() if r.held_out} == {i for i, _, _ in held}
    truth = {i: int(any(b in t for b in BAD)) for i, t, _ in held}
    assert sum(got[i].predicted == truth[i] for i in truth) >= 0.99 * len(truth)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_spans_cover_the_offending_words(scored):
    rows, _, _, got = scored
    right = wrong = missed = 0
    for i, t, _ in rows:
        spans = [tuple(map(int, s.split(":"))) for s in got[i].spans.split(",") if s]
        inside = " ".join(t[a:b] for a, b in spans)
        right += sum(inside.count(b) for b in BAD)
        missed += sum(t.count(b) for b in BAD) - sum(inside.count(b) for b in BAD)
        wrong += sum(not any(b in w for b in BAD) for w in inside.split())
    assert missed <= 0.02 * right and wrong <= 0.05 * right


def test_scores_come_from_texts_alone(spark, scored):
    rows, docs, labels, got = scored
    again = {r.doc_id: r for r in toxicity.score_toxicity(docs.repartition(2).withColumn("lang", F.lit(None).cast("string")), labels).collect()}
    assert all(abs(again[i].score - got[i].score) < 1e-9 and again[i].spans == got[i].spans for i in got)
    # labels of held-out ids change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.doc_id: r for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(other[i].score == again[i].score or abs(other[i].score - got[i].score) < 1e-9 for i in got)


def test_copies_are_no_evidence(spark):
    rows = made(2, 900)
    clean = "this quiet little text was copied again and again by everyone who came along here"
    rows += [(500_000 + k, clean, 1) for k in range(300)]  # a label that copies share
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).where("doc_id >= 500000").collect()
    assert not any(r.spans for r in got)


def test_documents_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    area = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in got for b in got if a.toxic > b.toxic]
    assert sum(area) / len(area) > 0.75


def test_odd_rows(spark, messy, none, scored):
    _, docs, labels, _ = scored
    odd = [(1, None), (2, ""), (3, " \n"), (4, "?! ..."), (None, "vorgal"), (5, "ü " * 3 + "vorgal, ü"), (5, "ü " * 3 + "vorgal, ü"), (6, "quiet " * 60_000 + "snarfik")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1))
    got = toxicity.score_toxicity(both, labels).where("doc_id IS NULL OR doc_id < 1000").collect()
    assert len(got) == len(odd)
    five = [r for r in got if r.doc_id == 5]
    assert [r.spans for r in five] == ["6:13"] * 2 and five[0] == five[1]
    assert next(r for r in got if r.doc_id is None).held_out is False
    empty = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1 and empty.pop() < 0.5
    assert next(r for r in got if r.doc_id == 6).spans == f"{6 * 60_000}:{6 * 60_000 + 7}"
    assert toxicity.score_toxicity(none, labels).collect() == []
    few = labels.where("toxic = 0")
    assert {r.score for r in toxicity.score_toxicity(messy, few).collect()} == {0.0}
    assert len(toxicity.score_toxicity(messy, labels.limit(0)).collect()) == messy.count()
    twice = labels.unionByName(labels.withColumn("toxic", 1 - F.col("toxic"))).unionByName(labels.withColumn("doc_id", F.lit(None).cast("long")))
    assert {r.score for r in toxicity.score_toxicity(docs, twice).collect()} == {0.0}
