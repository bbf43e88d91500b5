import hashlib
import random

import pytest
from llm_helpers import low, words

from fixity_spark.llm import chunks, ngram_join, substring


def repeats(rows, w):
    """Brute force: words covered by windows that also start earlier."""
    order = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in rows:
        ws = words(t)
        for p in range(len(ws) - w + 1):
            key, at = tuple(ws[p : p + w]), (order(i), p)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, t in rows:
        ws = words(t)
        gone = set()
        for p in range(len(ws) - w + 1):
            if first[tuple(ws[p : p + w])] < (order(i), p):
                gone |= set(range(p, p + w))
        kept = " ".join(x for k, x in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_of_sample(sample):
    got = substring.remove_repeats(sample).collect()
    assert sorted(map(tuple, got), key=str) == repeats([(r.doc_id, r.text) for r in sample.collect()], 20)


def test_repeats_of_messy(messy, messy_rows):
    got = substring.remove_repeats(messy, with_text=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == repeats([r[:2] for r in messy_rows], 20)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_small_alphabets(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, "", " ", " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))])) for _ in range(50)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 5, 3).collect()
    assert sorted(map(tuple, got), key=str) == repeats(rows, 5)


def test_blocks_must_fit(spark):
    with pytest.raises(ValueError):
        substring.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 5, 4)


def shingles(text, k):
    w = words(low(text))
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, k, percent):
    """Brute force: components of the documents that link."""
    sets, parent, held = [shingles(t, k) for _, t in rows], list(range(len(rows))), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in enumerate(sets):
        near = set()
        for x in s:
            near.update(held.setdefault(x, []))
            held[x].append(a)
        for b in near:
            if 100 * len(s & sets[b]) >= percent * len(s | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    return sorted(((i, len(sets[a]), i if not sets[a] else least.get(root(a))) for a, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_groups_of_sample(sample, k, percent):
    got = ngram_join.jaccard_groups(sample, k, percent).collect()
    assert sorted(map(tuple, got), key=str) == groups([(r.doc_id, r.text) for r in sample.collect()], k, percent)


def test_groups_of_messy(messy, messy_rows):
    got = ngram_join.jaccard_groups(messy).collect()
    assert sorted(map(tuple, got), key=str) == groups([r[:2] for r in messy_rows], 5, 80)
    kept = ngram_join.keep_one_of_each(messy)
    assert kept.columns == messy.columns
    assert sorted({r.doc_id for r in kept.collect()} - {None}) == [1, 3, 4, 5, 6, 8, 9, 10]


@pytest.mark.parametrize("seed", range(3))
def test_groups_chain_and_cross(spark, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 30))) for _ in range(6)]
    rows = []
    for i in range(200):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice("xyzw")
        rows.append((i, rng.choice([None, "", " ", "A b"]) if rng.random() < 0.1 else " ".join(w)))
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 60).collect()
    assert sorted(map(tuple, got), key=str) == groups(rows, 2, 60)


@pytest.mark.parametrize(("percent", "shared"), [(60, (1, 2, 3, 4)), (85, (1, 2)), (40, (1, 3)), (30, (1, 2, 8))])
def test_keys_of_many_sets_are_told_apart_by_more_shingles(spark, monkeypatch, percent, shared):
    """No leader rounds, and every key that two sets have counts as one of many."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "PAIRED", 1)
    monkeypatch.setattr(ngram_join, "SHARED", shared)
    rng = random.Random(percent)
    base = [[rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 4, 8, 30]))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice("xyzw")
        rows.append((i, " ".join(w + rng.choice(base)[:2])))
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, percent).collect()
    assert sorted(map(tuple, got), key=str) == groups(rows, 2, percent)


def test_lines_of_many_sets_give_few_pairs(spark, monkeypatch):
    """Texts made of lines that each occur in one of eight texts; only some near copies link."""
    rng, seen, links = random.Random(4), [], ngram_join._links
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, *rest: seen.append(pairs.count()) or links(pairs, *rest))
    rows = [(i, [f"l{line}w{k}" for line in rng.sample(range(100), 12) for k in range(6)]) for i in range(2500)]
    rows = [(i, " ".join(w)) for i, w in rows] + [(2500 + i, " ".join([*w, "more"])) for i, w in rows[:50]]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % 2500 for i in range(2550)}
    assert sum(seen) < 2500 * 300 / 2  # pairs under a single line's shingles


def test_leader_alone_does_not_decide(spark):
    """A chain in which the first document is near the second alone, and so on."""
    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w[i * 3 : i * 3 + 30])) for i in range(10)]
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 70).collect()
    assert sorted(map(tuple, got)) == groups(rows, 2, 70)
    assert {r.component_id for r in got} == {0}


def test_chunks_that_ask_together(sample, monkeypatch):
    """As on large inputs, with small chunks."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 4096)
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 4096)
    total = sum(len((r.text or "").encode()) for r in sample.collect())
    monkeypatch.setattr(chunks, "MESSAGE_BYTES", 6 * 4096 * 6 * 4096 // total)
    assert chunks.shares(total)[0] >= 5
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert sorted(map(tuple, substring.remove_repeats(sample).collect()), key=str) == repeats(rows, 20)
    assert sorted(map(tuple, ngram_join.jaccard_groups(sample, 4, 85).collect()), key=str) == groups(rows, 4, 85)


def test_shares_grow_with_the_root():
    assert chunks.shares(0) == (1, 8)
    assert chunks.shares(500 << 20) == (1, 256)
    assert chunks.shares(4 << 40)[0] == 6
    together, buckets = chunks.shares(100 << 40)
    assert together == 16 and buckets == (100 << 40) // (64 << 20)


def test_empty_tables(none):
    assert substring.remove_repeats(none).count() == 0
    assert ngram_join.jaccard_groups(none).count() == 0
    assert ngram_join.keep_one_of_each(none).count() == 0


def test_cuts_share_the_weight():
    cuts = ngram_join.fragment_cuts([(2, 50), (3, 30), (9, 20)], 4)
    assert [f for f, _ in cuts] == [2, 2, 3] and cuts[0][1] < cuts[1][1]
    assert ngram_join.fragment_cuts([], 4) == []
