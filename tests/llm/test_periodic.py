import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixity_spark.llm import periodic


def naive_common(s, i, j):
    n = 0
    while j + n < len(s) and s[i + n] == s[j + n]:
        n += 1
    return n


def naive_runs(w):
    """(start, length, period) by comparing every word with the one a period on."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - i >= max(6, 4 * q):
                found.setdefault((i, e + q), q)
            i = e
    return sorted((s, e - s, q) for (s, e), q in found.items())


def naive_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = naive_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def strings():
    rng = random.Random(5)
    out = [[1] * n for n in (1, 2, 5, 6, 7, 64)] + [[1, 2] * 20, [1, 2, 1] * 9 + [1, 2], [3] + [1, 2] * 8 + [1, 1] * 5 + [2]]
    for alphabet in (2, 3, 8):
        for n in (30, 200, 600):
            s = [rng.randrange(alphabet) for _ in range(n)]
            at, p = rng.randrange(n), rng.randrange(1, 30)
            out.append(s[:at] + (s[at : at + p] or [0]) * 7 + s[at:])
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 500:
        fib.append(fib[-1] + fib[-2])
    return [*out, fib[-1]]


@pytest.mark.parametrize("k", range(19))
def test_extensions_equal_word_by_word_comparison(k):
    s = strings()[k]
    g = periodic.Grammar(np.array([*s, max(s) + 1]))
    i, j = np.array([(i, j) for i in range(0, len(s), 1 + len(s) // 90) for j in range(i + 1, len(s))] or [(0, 1)]).T
    assert g.common(i, j).tolist() == [naive_common([*s, -1], x, y) for x, y in zip(i, j, strict=True)]


def test_runs_of_many_texts_at_once():
    texts = [np.array(s) for s in strings()] + [np.zeros(0, int), np.arange(50)]
    size = np.array([len(t) for t in texts])
    text, start, length, period = periodic.find_runs(np.concatenate(texts), np.cumsum(size) - size, size)
    got = {d: [] for d in range(len(texts))}
    for d, s, n, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        got[d].append((s, n, q))
    for d, t in enumerate(texts):
        assert got[d] == naive_runs(t.tolist()), d


def test_grammar_of_a_power_is_small():
    g = periodic.Grammar(np.array([1, 2, 3] * 5000 + [9]))
    assert len(g.levels) < 40 and sum(len(np.unique(x.below)) for x in g.levels) < 200


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in periodic.periodic_runs(docs, plant=True).collect()}
    want = {r.doc_id: naive_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    assert got == want
    assert sum(v[0] > 0 for v in want.values()) > 10


def test_odd_rows(spark):
    long = "x y " * 30_000
    odd = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (4, "a a a a a a"), (None, "b  b\tb b b b c"), (5, long), (6, "é ü é ü é ü é ü"), (7, "a b c d"), (8, " a  a  a  a  a  a")]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in odd], "doc_id long, text string, n_runs int, `Start` string")
    got = sorted((tuple(r) for r in periodic.periodic_runs(docs).collect()), key=str)
    plain = lambda t: naive_row("no", t) if zlib.crc32(b"no") % 10 else None
    quick = (1, 0, 60_000, 2, 30_000_000, hashlib.sha256(b"0,60000,2\n").hexdigest(), hashlib.sha256(b"x y").hexdigest())
    assert got == sorted(((i, *(quick if t is long else plain(t))) for i, t in odd), key=str)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_collapsed_texts_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b", "k", 1), (2, None, None, 2), (3, "x  y", "m", 3)], "doc_id long, text string, source string, n_runs int")
    got = sorted(tuple(r) for r in periodic.collapse_runs(docs).collect())
    assert got == [(1, "a b", "k", 1), (2, None, None, 2), (3, "x  y", "m", 3)]
    again = periodic.collapse_runs(periodic.collapse_runs(docs))
    assert sorted(tuple(r) for r in again.collect()) == got


def test_rows_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = lambda df: df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]
    assert digest(periodic.periodic_runs(docs, plant=True)) == digest(periodic.periodic_runs(docs.repartition(7), plant=True))
