"""Periodic runs of words: stretches that repeat a period of words, found with a run-length grammar.

A run of period q and at least 4q words holds four places of the grid 0, q, 2q, ..., so grids whose words agree three
times in a row are candidates, over all periods n log n places. Each candidate is extended exactly, to both sides, by
longest-common-extension queries on a grammar that recompression makes of the words: blocks of one symbol, then pairs
of adjacent symbols, become new symbols, in turns, until one symbol is left.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.llm.common import free_worker, tune
from fixity_spark.llm.words import _IS_SEP, mix, text_buffer, word_spans

#: A run has at least LEAST words, and POWER times its period.
LEAST, POWER = 6, 4
#: Up to so many documents, their grids are looked at one by one.
FEW = 4


class Level(NamedTuple):
    """One step of recompression over the symbols below it: blocks, or pairs."""

    below: np.ndarray  #: symbols that this step replaces
    first: np.ndarray  #: place below of the first symbol of each new one, and the end
    up: np.ndarray  #: place of the new symbol that each symbol below belongs to
    blocks: bool


class Grammar:
    """A run-length grammar of a sequence; equal symbols of a level have equal expansions.

    Every symbol of the sequence that stands at an end of a text must occur once only, so that no extension passes it.
    """

    def __init__(self, sequence: np.ndarray):
        self.levels: list[Level] = []
        now, names, turn = sequence.astype(np.int64), int(sequence.max(initial=0)) + 1, 0
        while len(now) > 1:
            turn += 1
            for blocks in (True, False):
                head = self._heads(now, None if blocks else turn)
                first = np.append(np.flatnonzero(head), len(now))
                size = np.diff(first)
                new, many = now[first[:-1]], size > 1
                if many.any():
                    at = first[:-1][many]
                    # what a new symbol stands for: a symbol and its count, or a symbol and the next one
                    second = size[many] if blocks else now[at + 1]
                    _, name = np.unique(now[at] * (int(second.max()) + 1) + second, return_inverse=True)
                    new[many] = names + name
                    names += int(name.max()) + 1
                    self.levels.append(Level(now.astype(np.int32), first.astype(np.int32), (np.cumsum(head) - 1).astype(np.int32), blocks))
                    now = new

    @staticmethod
    def _heads(now: np.ndarray, turn: int | None) -> np.ndarray:
        """Where blocks (no turn) or pairs begin. Symbols are dealt to two sides by a hash, another one each turn; a pair
        is one of the left, then one of the right side, whichever way round gives more of them. As no neighbours are
        equal, that is a quarter of all."""
        head = np.ones(len(now), bool)
        if turn is None:
            head[1:] = now[1:] != now[:-1]
            return head
        side = (mix(now.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) >> np.uint64(17)).astype(np.int64) & 1
        step = side[1:] - side[:-1]
        up, down = step == 1, step == -1
        head[1:] = ~(up if up.sum() >= down.sum() else down)
        return head

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension to the right of each pair of different places.

        Upwards, a pair of places that both begin new symbols goes a level up; else the symbols there are compared, and
        the rest of a block, or of a pair, is passed. As equal symbols are dealt alike whatever stands before them,
        one comparison a level is enough. Downwards, the first differing symbols are opened level by level.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        begin, stop = a.copy(), np.full(len(a), -1)  # stop: level whose symbols differ at a, b
        live = np.arange(len(a))
        for k, (below, first, up, blocks) in enumerate(self.levels):
            if not len(live):
                break
            x, y = a[live], b[live]
            p, q = up[x].astype(np.int64), up[y].astype(np.int64)
            inside = (first[p] != x) | (first[q] != y)
            differ = inside & (below[x] != below[y])
            left, right = np.where(inside, first[p + 1] - x, 0), np.where(inside, first[q + 1] - y, 0)
            least = np.minimum(left, right)
            # a block that goes on where the other one ends differs there
            ends = inside & ~differ & (left != right) if blocks else np.zeros(len(live), bool)
            done = differ | ends
            a[live], b[live] = np.where(differ, x, np.where(ends, x + least, np.where(inside, p + 1, p))), np.where(differ, y, np.where(ends, y + least, np.where(inside, q + 1, q)))
            stop[live[done]] = k
            live = live[~done]
        for k in range(len(self.levels) - 1, 0, -1):  # stop k: symbols below level k, made by level k - 1
            rows = np.flatnonzero(stop >= k)
            below, first, _, blocks = self.levels[k - 1]
            x, y = first[a[rows]].astype(np.int64), first[b[rows]].astype(np.int64)
            same = below[x] == below[y]
            skip = np.minimum(first[a[rows] + 1] - x, first[b[rows] + 1] - y) if blocks else 1
            a[rows], b[rows] = x + same * skip, y + same * skip
        return a - begin


def _grids(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Chains (period, first place, last place): places of a grid where four in a row hold one word.

    ids holds the words of all texts, text d being ids[first[d] : first[d] + size[d]].
    """
    found = []
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    neg = -size
    for q in range(1, int(size[0]) // POWER + 1 if len(size) else 1):
        n = int(np.searchsorted(neg, -max(LEAST, POWER * q), side="right"))
        if n <= FEW:
            parts = [(ids[f : f + s : q], f, np.zeros(1, np.int64), None) for f, s in zip(first[:n].tolist(), size[:n].tolist(), strict=True)]
        else:
            count = -(-size[:n] // q)
            begin = np.cumsum(count) - count
            place = np.repeat(first[:n] - begin * q, count) + np.arange(int(count.sum())) * q
            parts = [(ids[place], 0, begin, place)]
        for words, at, begin, place in parts:
            same = words[1:] == words[:-1]
            if place is not None:
                same[begin[1:] - 1] = False  # the grid of another text
            if len(same) < POWER - 1:
                continue
            hit = same[2:] & same[1:-1] & same[:-2]
            if not hit.any():
                continue
            edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
            low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            low, high = (place[low], place[high]) if place is not None else (at + low * q, at + high * q)
            found.append(np.stack([np.full(len(low), q), low, high]))
    return np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)


def find_runs(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, length, period) of every run of the texts ids[first[d] : first[d] + size[d]], by start, period.

    Places of ids are in order of text.
    """
    q, low, high = _grids(ids, first, size)
    empty = (np.zeros(0, np.int64),) * 4
    if not len(q):
        return empty
    # one sequence of the texts that have candidates, each between symbols that occur once
    texts = np.unique(np.searchsorted(first, low, side="right") - 1)
    low_text = np.searchsorted(texts, np.searchsorted(first, low, side="right") - 1)
    ends = int(ids.max()) + 1 + np.arange(len(texts) + 1)
    joined, begin, at = [ends[:1]], [], 1
    for d, end in zip(texts.tolist(), ends[1:].tolist(), strict=True):
        joined += [ids[first[d] : first[d] + size[d]], [end]]
        begin.append(at)
        at += int(size[d]) + 1
    sequence, begin = np.concatenate(joined), np.array(begin)
    ahead, back = Grammar(sequence), Grammar(sequence[::-1])
    shift = begin[low_text] - first[texts][low_text]
    i, last = low + shift, high + shift
    starts, stops, periods, whose = [], [], [], []
    while len(i):
        stop = i + q + ahead.common(i, i + q)
        start = i - back.common(len(sequence) - i, len(sequence) - i - q)
        good = stop - start >= np.maximum(LEAST, POWER * q)
        starts.append(start[good])
        stops.append(stop[good])
        periods.append(q[good])
        whose.append(low_text[good])
        # the next place of the chain that this stretch does not hold
        i = i + q * ((stop - q - i) // q + 1)
        on = i <= last
        i, last, q, low_text = i[on], last[on], q[on], low_text[on]
    start, stop, period, text = map(np.concatenate, (starts, stops, periods, whose))
    # one stretch may have several periods, all multiples of the smallest: it has four of each
    order = np.lexsort((period, stop, start))
    start, stop, period, text = start[order], stop[order], period[order], text[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period, text = start[keep], stop[keep], period[keep], text[keep]
    order = np.lexsort((period, start))
    start, stop, period, text = start[order], stop[order], period[order], text[order]
    return texts[text], start - begin[text], stop - start, period


def word_ids(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words; words are compared, not hashes."""
    if not len(start):
        return np.zeros(0, np.int32)
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(raw[~_IS_SEP[raw]])])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on repeat the p words there; null ids and empty texts stay as they are."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _report(batch: pa.RecordBatch, plant: bool) -> pa.RecordBatch:
    raw, off = text_buffer(batch.column(1))
    start, end, doc = word_spans(raw, off)
    size = np.bincount(doc, minlength=batch.num_rows)
    first = np.cumsum(size) - size
    index, touched = np.arange(len(start)), np.zeros(batch.num_rows, bool)
    if plant:
        for d, doc_id in enumerate(batch.column(0).to_pylist()):
            if at := planted(doc_id, int(size[d])):
                f, (a, p) = int(first[d]), at
                index[f + a : f + size[d]] = f + a + np.arange(size[d] - a) % p
                touched[d] = True
    text, begin, length, period = find_runs(word_ids(raw, start, end)[index], first, size)
    order = np.argsort(text, kind="stable")
    text, begin, length, period = text[order], begin[order], length[order], period[order]
    bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
    n_runs = np.diff(bounds)
    touched |= n_runs > 0
    # words after the first period of a run go
    at = first[text] + begin
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, at + period, 1)
    np.add.at(cover, at + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    # the words of a text that stays as it is: its bytes with one space for each stretch of separators between words
    sep = _IS_SEP[raw]
    stays = ~sep
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    stays[end[inner]] = True
    copy = raw.copy()
    copy[end[inner]] = 32
    best = {k: np.zeros(batch.num_rows, np.int64) for k in ("start", "length", "period")}
    runs_sha, text_sha = [], []
    nothing = hashlib.sha256().hexdigest()
    for d in range(batch.num_rows):
        low, high = int(bounds[d]), int(bounds[d + 1])
        if high > low:
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in zip(begin[low:high].tolist(), length[low:high].tolist(), period[low:high].tolist(), strict=True))
            runs_sha.append(hashlib.sha256(lines.encode()).hexdigest())
            top = low + int(np.argmax(length[low:high]))  # the first of the longest: runs are by start, period
            best["start"][d], best["length"][d], best["period"][d] = begin[top], length[top], period[top]
        else:
            runs_sha.append(nothing)
        if touched[d]:
            f = int(first[d])
            rows = index[f : f + size[d]][kept[f : f + size[d]]]
            data = memoryview(raw)
            body = b" ".join([data[s:e] for s, e in zip(start[rows].tolist(), end[rows].tolist(), strict=True)])
        else:
            body = copy[off[d] : off[d + 1]][stays[off[d] : off[d + 1]]]
        text_sha.append(hashlib.sha256(body).hexdigest())
    none = n_runs == 0
    milli = 1000 * best["length"] // np.maximum(best["period"], 1)
    nullable = lambda x: pa.array(x, pa.int64(), mask=none)
    columns = [batch.column(0), pa.array(n_runs.astype(np.int64)), nullable(best["start"]), nullable(best["length"]), nullable(best["period"]), nullable(milli), pa.array(runs_sha), pa.array(text_sha)]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests of all
    runs and of the text without the repeats.

    A run is a stretch of consecutive words of smallest period q, at least max(6, 4q) words long, that no neighbouring
    word extends. The longest one is given; of equally long ones the first, then that of the smaller period; without
    runs its four columns are null. Words of a run after its first q words go from the collapsed text, whose words are
    joined by one space. A null text counts as empty; rows repeated with one id get a row each; other columns are not
    read. With plant, the words of every tenth document by the CRC of its id first repeat from some word on (planted).
    Each text is worked on where it is, without a shuffle; a task holds a batch of texts or one longer text.
    """
    tune(docs.sparkSession)

    def scan(batches):
        free_worker()
        for b in batches:
            if b.num_rows:
                yield _report(b, plant)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, _SCHEMA)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """docs with the words of each text that repeat a run's first period taken out; texts without runs stay as they are.

    Null texts stay null; all other columns are kept whatever their names.
    """
    tune(docs.sparkSession)
    where = docs.columns.index("text")

    def scan(batches):
        free_worker()
        for b in batches:
            raw, off = text_buffer(b.column(where))
            start, end, doc = word_spans(raw, off)
            size = np.bincount(doc, minlength=b.num_rows)
            first = np.cumsum(size) - size
            text, begin, length, period = find_runs(word_ids(raw, start, end), first, size)
            texts = b.column(where).to_pylist() if len(text) else None
            for d in np.unique(text).tolist():
                gone = np.zeros(size[d] + 1, np.int64)
                own = text == d
                np.add.at(gone, (begin + period)[own], 1)
                np.add.at(gone, (begin + length)[own], -1)
                rows = first[d] + np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                texts[d] = b" ".join([bytes(raw[s:e]) for s, e in zip(start[rows].tolist(), end[rows].tolist(), strict=True)]).decode()
            yield b if texts is None else pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(where).type) if k == where else c for k, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(scan, docs.schema)
