"""Removal of repeated passages, found by fixed-block anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fixity_spark.llm import chunks as C
from fixity_spark.llm.common import Scratch
from fixity_spark.llm.words import ngram_hashes, slices, span_hashes, word_spans

#: Words of a window that counts as a repeat, and of a reference block. Twice the block less one must not
#: exceed the window: then any window holds a whole block of the passage it repeats.
WINDOW, BLOCK = 20, 10
_LAST = np.iinfo(np.int64).max


def _windows(blobs: list[bytes], want: tuple[tuple[int, int], ...]):
    """Words of the chunks that ask together and, for each (length, hash function), window positions and hashes."""
    raw, off, ids = C.open_chunk(blobs)
    starts, ends, docs = [], [], []
    hashed: dict[int, list] = {w: [] for w in {which for _, which in want}}
    for i, j in slices(off):
        s, e, d = word_spans(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        for which, parts in hashed.items():
            parts.append(span_hashes(raw[off[i] : off[j]], s, e, which))
        starts.append(s + off[i])
        ends.append(e + off[i])
        docs.append(d + i)
    join = lambda parts, kind=np.int64: np.concatenate(parts) if parts else np.zeros(0, kind)
    start, end, doc = join(starts), join(ends), join(docs)
    words = {which: join(parts, np.uint64) for which, parts in hashed.items()}
    return raw, off, ids, start, end, doc, [ngram_hashes(words[which], doc, n, which) for n, which in want]


def _doc_keys(ids: pa.Array) -> np.ndarray:
    """Ids as an order; null comes last."""
    return ids.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _ask_blocks(buckets: int, block: int):
    def ask(batches):
        for chunk, blobs in C.asking(batches):
            *_, doc, [(at, h)] = _windows(blobs, ((block, 0),))
            first = np.searchsorted(doc, doc[at])  # first word of the window's document
            reference = (at - first) % block == 0
            order = np.argsort(h)
            keys = h[order]
            begin = C.runs(keys)
            many = np.diff(np.append(begin, len(keys))) > 1
            flags = (np.logical_or.reduceat(reference[order], begin) * 1 + many * 2).astype(np.uint8) if len(begin) else np.zeros(0, np.uint8)
            keys = keys[begin]
            rows = C.messages(chunk, keys, buckets, {"keys": lambda c, k=keys: C.pack_keys(k[c]), "flags": lambda c, f=flags: f[c].tobytes()})
            if rows is not None:
                yield rows

    return ask


def _answer_blocks(table: pa.Table) -> pa.Table:
    """For each chunk the keys that are a reference block somewhere and occur at least twice in all."""
    data = table["keys"].to_pylist()
    keys = C.unpack_keys(b"".join(data))
    flags = np.frombuffer(C.joined(table["flags"]), np.uint8)
    source = np.repeat(np.arange(len(data)), [len(x) // C.SHORT for x in data])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = C.runs(keys)
    size = np.diff(np.append(begin, len(keys)))
    flags = flags[order]
    hot = (size > 1) | (np.maximum.reduceat(flags, begin) >= 2) if len(begin) else np.zeros(0, bool)
    hot &= np.bitwise_or.reduceat(flags, begin) & 1 == 1 if len(begin) else hot
    keep = np.repeat(hot, size)
    source, keys = source[order][keep], keys[keep]
    order = np.argsort(source, kind="stable")
    source, keys = source[order], keys[order]
    begin = C.runs(source)
    chunk, bucket = table["chunk"].to_numpy(), table["bucket"].to_numpy()
    return pa.table({"chunk": pa.array(chunk[source[begin]], pa.int64()), "bucket": pa.array(bucket[source[begin]], pa.int32()), "keys": pa.array([C.pack_keys(k) for k in np.split(keys, begin[1:])] if len(begin) else [], pa.binary())})


def _ask_windows(buckets: int, window: int, block: int):
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        """The windows of a chunk that hold an anchor hit: distinct ones, each with its first place in the chunk."""
        empty = pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("keys", "more", "place", "spot", "many")}})
        if not left.num_rows or not right.num_rows:
            return empty
        known = np.sort(np.concatenate([C.unpack_keys(k) | np.uint64(b) << np.uint64(8 * C.SHORT) for k, b in zip(right["keys"].to_pylist(), right["bucket"].to_pylist(), strict=True)]))
        _, _, ids, _, _, doc, [(at, h), (wide, one), (_, two)] = _windows(left["blob"].to_pylist(), ((block, 0), (window, 0), (window, 1)))
        hit = np.zeros(len(doc) + 1, np.int64)
        hit[at + 1] = C.member(C.short_keys(h, buckets), known)
        hits = np.cumsum(hit)
        held = hits[wide + window - block + 1] > hits[wide]
        wide, one, two = wide[held], one[held], two[held].astype("<u4")
        if not len(wide):
            return empty
        place, first_word = _doc_keys(ids)[doc[wide]], np.searchsorted(doc, doc[wide])
        spot = wide - first_word
        order = np.lexsort((spot, place, two, one))
        one, two, place, spot = one[order], two[order], place[order], spot[order].astype("<u4")
        begin = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        many = (np.diff(np.append(begin, len(one))) > 1).astype(np.uint8)
        one, sent = one[begin], {"more": two[begin], "place": place[begin], "spot": spot[begin], "many": many}
        packed = {"keys": lambda c: C.pack_planes(one[c])} | {k: lambda c, v=v: C.pack_planes(v[c]) for k, v in sent.items()}
        return pa.Table.from_batches([C.messages(int(left["chunk"][0].as_py()), one, buckets, packed)])

    return ask


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each chunk the windows that start earlier elsewhere (again), or only in itself but more than once (own)."""
    one, two, place, spot, many = (C.unpack_planes(table[c], kind) for c, kind in (("keys", "<u8"), ("more", "<u4"), ("place", "<i8"), ("spot", "<u4"), ("many", "u1")))
    source = np.repeat(np.arange(table.num_rows), [len(x) // 8 for x in table["keys"].to_pylist()])
    order = np.lexsort((spot, place, two, one))
    one, two, place, spot, source, many = (x[order] for x in (one, two, place, spot, source, many))
    fresh = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
    begin = np.flatnonzero(fresh)
    first = begin[np.cumsum(fresh) - 1]
    # rows that repeat an id may share the first place itself; none of them is earlier
    earliest = (place == place[first]) & (spot == spot[first])
    chunk = table["chunk"].to_numpy()
    again, own = ~earliest, earliest & (many > 0)
    parts = {}
    for name, chosen in (("again", again), ("own", own)):
        s, k = source[chosen], one[chosen]
        o = np.argsort(s, kind="stable")
        s, k = s[o], k[o]
        cut = C.runs(s)
        for row, part in zip(s[cut].tolist(), np.split(k, cut[1:]) if len(cut) else [], strict=True):
            parts.setdefault(row, {})[name] = part.tobytes()
    return pa.table({"chunk": pa.array([int(chunk[r]) for r in parts], pa.int64()), "again": pa.array([p.get("again", b"") for p in parts.values()], pa.binary()), "own": pa.array([p.get("own", b"") for p in parts.values()], pa.binary())})


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _remove(window: int, with_text: bool):
    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {x.split()[0]: [] for x in _RESULT.split(", ")} | ({"kept_text": []} if with_text else {})
        if left.num_rows:
            raw, off, ids, start, end, doc, [(at, h)] = _windows(left["blob"].to_pylist(), ((window, 0),))
            again, own = (np.sort(np.frombuffer(C.joined(right[c]), np.uint64)) if right.num_rows else np.zeros(0, np.uint64) for c in ("again", "own"))
            repeated = C.member(h, again)
            inside = np.flatnonzero(C.member(h, own))
            if len(inside):
                place, spot = _doc_keys(ids)[doc[at[inside]]], at[inside] - np.searchsorted(doc, doc[at[inside]])
                order = np.lexsort((spot, place, h[inside]))
                begin = C.runs(h[inside][order])
                group = np.repeat(begin, np.diff(np.append(begin, len(order))))
                p, s = place[order], spot[order]
                repeated[inside[order[(p != p[group]) | (s != s[group])]]] = True
            # consecutive repeated windows are one maximal repeat; its words go
            cover = np.zeros(len(doc) + 1, np.int64)
            np.add.at(cover, at[repeated], 1)
            np.add.at(cover, at[repeated] + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            data = raw.tobytes()
            bounds = np.searchsorted(doc, np.arange(len(off)))
            for i in range(len(off) - 1):
                a, b = int(bounds[i]), int(bounds[i + 1])
                kept = [data[s:e] for s, e, g in zip(start[a:b].tolist(), end[a:b].tolist(), gone[a:b].tolist(), strict=True) if not g]
                text = b" ".join(kept)
                for name, value in zip(rows, [ids[i].as_py(), b - a, b - a - len(kept), hashlib.sha256(text).hexdigest(), *[text.decode()] * with_text], strict=True):
                    rows[name].append(value)
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text, when asked for).

    A word goes when a window of `window` words that covers it also starts earlier: in a smaller doc_id, or
    earlier in the same document. Every document is cut into non-overlapping reference blocks of `block` words,
    which are indexed; every rolling window of `block` words of every document probes them. A block that occurs
    at least twice is an anchor. Anchors are extended word by word: each `window`-word stretch that holds one is
    compared, by a 96-bit hash, with all others, and consecutive repeated stretches form a maximal exact repeat.
    A passage that many documents share is one key with many places, and only its first place is kept; places
    are never paired.

    A null or blank text has no words; its digest is that of the empty text. A null id comes after all others.
    Rows that repeat an id at the same position are not earlier than each other. An empty table gives no rows.
    Other columns are not read.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole reference block wherever it starts")
    scratch = Scratch(docs.sparkSession, "repeats")
    held, buckets = C.deal(C.write_chunks(docs, scratch))
    asked = held.mapInArrow(_ask_blocks(buckets, block), "bucket int, chunk long, keys binary, flags binary")
    anchors = scratch.write(asked.groupBy("bucket").applyInArrow(_answer_blocks, "chunk long, bucket int, keys binary"), "anchors")
    scratch.tidy()
    windows = held.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_ask_windows(buckets, window, block), "bucket int, chunk long, keys binary, more binary, place binary, spot binary, many binary")
    repeats = scratch.write(windows.groupBy("bucket").applyInArrow(_answer_windows, "chunk long, again binary, own binary"), "repeats")
    scratch.drop("anchors")
    scratch.tidy()
    return held.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_remove(window, with_text), _RESULT + ", kept_text string" * with_text)
