"""Word and n-gram hashing over Arrow text columns, with numpy on whole buffers instead of Python per word.

A word is a maximal run of bytes other than space and 0x09-0x0D. All separators are ASCII, so words can be
cut from UTF-8 bytes without decoding. Hashes are polynomial sums modulo 2**64 over random byte values,
finished by a mixer; they are the same in every process and on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes of text hashed at once; a longer document is hashed in one piece of its own size.
SLICE = 1 << 20

_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [(6364136223846793005, 3202034522624059733), (2862933555777941757, 3935559000370003845)]
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string or binary array; null counts as empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges of documents of at most limit bytes together, or one longer document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word; documents end words."""
    if len(raw) == 0:
        return (np.zeros(0, np.int64),) * 3
    sep = _IS_SEP[raw]
    first, last = ~sep, ~sep
    first[1:] &= sep[:-1]
    last[:-1] &= sep[1:]
    full = offsets[1:] > offsets[:-1]
    begins, ends = offsets[:-1][full], offsets[1:][full] - 1
    first[begins] = ~sep[begins]
    last[ends] = ~sep[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base and of its inverse modulo 2**64."""
    held = _POWERS.get((base, 0))
    if held is None or len(held[0]) < n:
        size = max(n, SLICE + 2)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        held = (out[0], out[1])
        if size <= 4 * SLICE:
            _POWERS[(base, 0)] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing permutation of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of raw[start:end] for each span; which selects one of two independent functions."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    base = _BASES[which][0]
    power, inverse = _powers(base, len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[which][raw] * power[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, doc: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-grams that lie within one document, and their hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = _powers(_BASES[which][1], len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, mix((total[at + n] - total[at]) * inverse[at] + np.uint64(n))


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each document."""
    raw, off = text_buffer(column)
    out = np.zeros(len(off) - 1, np.int64)
    for i, j in slices(off):
        part = off[i : j + 1] - off[i]
        _, _, doc = word_spans(raw[off[i] : off[j]], part)
        out[i:j] = np.bincount(doc, minlength=j - i)
    return out


class HashIndex:
    """Positions by 64-bit hash, in a large sorted array and a small recent one that is merged into it now and then."""

    def __init__(self):
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def __len__(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The position of each hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        for keys, places in self.parts:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, places[at], out)
        return out

    def add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Adds hashes that are not held yet."""
        (old, old_at), (new, new_at) = self.parts
        new, new_at = _sorted(np.concatenate([new, hashes]), np.concatenate([new_at, places]))
        if len(new) > max(50_000, len(old) // 4):
            old, old_at = _sorted(np.concatenate([old, new]), np.concatenate([old_at, new_at]))
            new, new_at = new[:0], new_at[:0]
        self.parts = [(old, old_at), (new, new_at)]


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


class Store:
    """Rows appended to one array that grows by doubling."""

    def __init__(self, like: np.ndarray):
        self.rows, self.n = like[:0].copy(), 0

    def append(self, more: np.ndarray) -> int:
        """Adds rows; the position of the first."""
        if self.n + len(more) > len(self.rows):
            grown = np.empty((max(2 * len(self.rows), self.n + len(more), 1024), *self.rows.shape[1:]), self.rows.dtype)
            grown[: self.n] = self.rows[: self.n]
            self.rows = grown
        self.rows[self.n : self.n + len(more)] = more
        self.n += len(more)
        return self.n - len(more)
