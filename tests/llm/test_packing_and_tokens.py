import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import low, words

from fixity_spark.llm import packing, tokens


def brute_pack(rows, capacity, per_source):
    """Each piece, largest first, to the compatible bin with the least room left that holds it."""
    bins, out = [], [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: -rows[i][0]):
        size, source, cluster = rows[i]
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and cluster not in b["clusters"] and b["sources"].get(source, 0) < per_source]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "clusters": set(), "sources": {}})
        b = bins[k]
        out[i] = (k, capacity - b["room"])
        b["room"] -= size
        b["clusters"].add(cluster)
        b["sources"][source] = b["sources"].get(source, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 50), rng.choice("abc"), rng.choice(range(12))) for _ in range(300)]
    assert packing.pack_shard(rows, 60, 2) == brute_pack(rows, 60, 2)


def check_packing(docs, rows, capacity=packing.CAPACITY):
    by_bin, by_doc = defaultdict(list), defaultdict(int)
    for r in rows:
        by_doc[r.doc_id] += r.n_words
        if r.n_words:
            by_bin[r.bin_id].append(r)
    size = defaultdict(int)
    text = {}
    for d in docs:
        size[d.doc_id] += len(words(d.text))
        text[d.doc_id] = low(d.text)
    assert by_doc == size
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
        assert at <= capacity
        known = [text[r.doc_id] for r in pieces if r.doc_id is not None]
        assert len(set(known)) == len(known)
        for s in {r.source for r in pieces}:
            assert sum(r.source == s for r in pieces) <= packing.PER_SOURCE


def test_packing_of_sample(sample):
    check_packing(sample.collect(), packing.pack_documents(sample).collect())


def test_packing_of_messy(messy, none):
    rows = packing.pack_documents(messy).collect()
    check_packing(messy.collect(), rows)
    assert sum(r.n_words == 0 and r.bin_id is None for r in rows) == 4
    assert sum(r.doc_id == 6 for r in rows) == -(-30_000 // packing.CAPACITY)
    assert packing.pack_documents(none).count() == 0


def test_code_is_a_prefix_code_of_bounded_length():
    rng = np.random.default_rng(1)
    for limit in (12, 20):
        counts = np.zeros(5000, np.int64)
        counts[rng.integers(0, 5000, 1500)] = (rng.pareto(0.3, 1500) * 10 + 1).astype(np.int64).clip(1, 10**15)
        lengths = tokens.code_lengths(counts, limit)
        assert lengths.max() <= limit and ((lengths > 0) == (counts > 0)).all()
        assert sum(2.0 ** -float(n) for n in lengths[lengths > 0]) == pytest.approx(1)


def test_code_lengths_are_optimal():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 1])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        best += a
        heapq.heappush(heap, a)
    assert int((tokens.code_lengths(counts) * counts).sum()) == best


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_bits_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(1, 60_000).astype(np.uint32)
    lengths = tokens.code_lengths(np.bincount(ids, minlength=3))
    data, runs = tokens.pack_bits(ids, tokens.canonical_codes(lengths), lengths)
    assert (tokens.unpack_bits(data, runs, n, tokens.decode_table(lengths)) == ids).all()


def expected(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_of_sample(sample):
    got = tokens.token_report(sample).collect()
    assert sorted(map(tuple, got)) == sorted(expected([(r.doc_id, r.text) for r in sample.collect()]))


def test_files_of_messy(messy, messy_rows, none):
    rows = [r for r in messy_rows if r[0] is not None]
    got = tokens.token_report(messy.where("doc_id IS NOT NULL")).collect()
    assert sorted(map(tuple, got)) == sorted(expected([r[:2] for r in rows]))
    assert tokens.token_report(messy).where("doc_id IS NULL").count() == 2
    assert tokens.token_report(none).count() == 0


def test_ids_come_back(spark, tmp_path):
    texts = ["a  b", " a b ", "<|endoftext|> x <|endoftext|>", "don't\n\n it's  12 34", "é à ñ  q", "x" * 5000 + " y", "\x1c x \x85 y", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens.write_tokens(docs, str(tmp_path / "t"))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    for r in tokens.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect():
        assert r.ids == [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
