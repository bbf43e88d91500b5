"""Exact deduplication with a cuckoo-filter index of live digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixity_spark.llm.common import Scratch, free_worker, own_names, shuffle_partitions
from fixity_spark.llm.words import lower_ascii, text_buffer

SLOTS = 4
MAX_KICKS = 64
#: Live digests that one index holds, about 260 bytes each.
LIVE = 400_000


class CuckooIndex:
    """Live digests: 16-bit fingerprints in two candidate buckets of four slots, keys stored beside them.

    A fingerprint hit is verified against the key stored in the same slot, so false positives cost a
    comparison, never a wrong answer. When an insertion finds no room after MAX_KICKS evictions the table
    doubles and is refilled from the stored keys.
    """

    def __init__(self, buckets: int = 256):
        self.size, self.live, self.resizes = buckets, 0, 0
        self._clear()

    def _clear(self) -> None:
        self.prints = [[0] * SLOTS for _ in range(self.size)]
        self.keys: list[list] = [[None] * SLOTS for _ in range(self.size)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        one = int.from_bytes(digest[2:10], "little") & (self.size - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.size - 1)

    def find(self, digest: bytes):
        """The stored [digest, payload...] entry of a live digest, or None."""
        mark, one, two = self._places(digest)
        for b in (one, two):
            marks = self.prints[b]
            if mark in marks:
                for slot in range(SLOTS):
                    if marks[slot] == mark and self.keys[b][slot][0] == digest:
                        return self.keys[b][slot]
        return None

    def delete(self, digest: bytes) -> bool:
        mark, one, two = self._places(digest)
        for b in (one, two):
            for slot in range(SLOTS):
                if self.prints[b][slot] == mark and self.keys[b][slot][0] == digest:
                    self.prints[b][slot], self.keys[b][slot] = 0, None
                    self.live -= 1
                    return True
        return False

    def insert(self, entry: list) -> None:
        """Add a live entry; a full table doubles and is refilled from the stored keys."""
        self.live += 1
        left = self._place(entry)
        if left is None:
            return
        held = [*self.entries(), left]
        while left is not None:
            self.size *= 2
            self.resizes += 1
            self._clear()
            left = next((x for x in map(self._place, held) if x is not None), None)

    def _place(self, entry: list):
        """Store the entry; the entry left without a place, or None."""
        mark, b, two = self._places(entry[0])
        for place in (b, two):
            if 0 in self.prints[place]:
                slot = self.prints[place].index(0)
                self.prints[place][slot], self.keys[place][slot] = mark, entry
                return None
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            mark, self.prints[b][slot] = self.prints[b][slot], mark
            entry, self.keys[b][slot] = self.keys[b][slot], entry
            b = self._other(b, mark)
            if 0 in self.prints[b]:
                slot = self.prints[b].index(0)
                self.prints[b][slot], self.keys[b][slot] = mark, entry
                return None
        return entry

    def entries(self) -> Iterator[list]:
        return (x for row in self.keys for x in row if x is not None)


def _digests(batches):
    """Adds _fx_digest: SHA-256 of the text after lower-casing A-Z only; null counts as empty."""
    for batch in batches:
        raw, off = text_buffer(batch.column(1))
        low = lower_ascii(raw).tobytes()
        found = [hashlib.sha256(low[off[i] : off[i + 1]]).digest() for i in range(len(off) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["_fx_id", "_fx_digest"])


_LIVE = {"_fx_digest": pa.binary(), "_fx_keep": pa.int64(), "_fx_n": pa.int64(), "_fx_m": pa.int64()}


def _handed_on(index: CuckooIndex):
    rows = list(index.entries())
    for i in range(0, len(rows), 10_000):
        part = list(zip(*rows[i : i + 10_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(part, _LIVE.values(), strict=True)], list(_LIVE))


def _merge(most: int | None):
    """Merges (digest, id, count, count of that id) rows through one index: a newer holder replaces the live one.

    An index of most live digests hands its entries on and a new one takes over, so that a digest may leave a task more
    than once; without most it grows, by resizing, to all digests of the task.
    """

    def run(batches):
        free_worker()
        index = CuckooIndex()
        for batch in batches:
            if most is not None and index.live >= most:
                yield from _handed_on(index)
                index = CuckooIndex()
            for digest, doc, n, m in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                hit = index.find(digest)
                if hit is None:
                    index.insert([digest, doc, n, m])
                elif doc is not None and (hit[1] is None or doc > hit[1]):
                    index.delete(digest)
                    index.insert([digest, doc, hit[2] + n, m])
                else:
                    hit[2] += n
                    hit[3] += m if doc == hit[1] else 0
        yield from _handed_on(index)

    return run


def live_digests(digests: DataFrame) -> DataFrame:
    """(_fx_digest, _fx_keep, _fx_n, _fx_m) of (_fx_id, _fx_digest): the largest id, the size of each group and the
    rows in it that bear that id, as the indexes hold them.

    Each task first merges its own rows in an index, so a digest leaves a task once, or once for LIVE others, however
    many copies it has; the rows that remain are dealt by digest, about LIVE / 2 digests to a task by their number, and
    merged by one index for each task, which holds every digest dealt to it: its entries are the result.
    """
    schema = "_fx_digest binary, _fx_keep long, _fx_n long, _fx_m long"
    one = F.lit(1).cast("long")
    partial = digests.select("_fx_digest", F.col("_fx_id").alias("_fx_keep"), one.alias("_fx_n"), one.alias("_fx_m")).mapInArrow(_merge(LIVE), schema)
    tasks = max(shuffle_partitions(digests.sparkSession), digests.count() // (LIVE // 2))
    return partial.repartition(tasks, "_fx_digest").mapInArrow(_merge(None), schema)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays. A null text
    is the empty text. A null id is smaller than any other; rows repeated with the same id all count, and
    all carry kept for the id that stays. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    narrow = docs.select(F.col(id_col).cast("long").alias("_fx_id"), F.col(text_col).alias("_fx_text"))
    digests = scratch.write(narrow.mapInArrow(_digests, "_fx_id long, _fx_digest binary"), "digests")
    live = scratch.write(live_digests(digests), "live")
    return digests.join(live, "_fx_digest").select(
        F.col("_fx_id").alias(id_col),
        F.col("_fx_keep").alias("keep_id"),
        F.col("_fx_n").alias("group_size"),
        F.col("_fx_id").eqNullSafe(F.col("_fx_keep")).alias("kept"),
        F.lower(F.hex("_fx_digest")).alias("text_sha256"),
    )


def _with_digests(batches):
    """Adds the digest of the text, which comes last, in its place."""
    for batch in batches:
        found = next(iter(_digests([pa.RecordBatch.from_arrays([batch.columns[-1]] * 2, ["_fx_id", "_fx_text"])]))).column(1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "_fx_digest"])


@own_names
def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its duplicates, every column kept; of rows repeated with the same id and text one stays.

    Each row is judged by its text's digest and its id, in one join with the live digests. Only groups in which
    several rows bear the id that stays are then reduced to one, first within each task.
    """
    scratch = Scratch(docs.sparkSession, "exact-kept")
    narrow = docs.select(F.col(id_col).cast("long").alias("_fx_id"), F.col(text_col).alias("_fx_text"))
    digests = scratch.write(narrow.mapInArrow(_digests, "_fx_id long, _fx_digest binary"), "digests")
    live = scratch.write(live_digests(digests).select("_fx_digest", "_fx_keep", "_fx_m"), "live")
    scratch.drop("digests")
    schema = T.StructType([*docs.schema.fields, T.StructField("_fx_digest", T.BinaryType())])
    marked = docs.select("*", F.col(text_col).alias("_fx_text")).mapInArrow(_with_digests, schema)

    def kept(live: DataFrame) -> DataFrame:
        # most documents stay, so their digests are never a small side: the plan is the same at every size
        return marked.join(live.hint("merge"), "_fx_digest").where(F.col(id_col).cast("long").eqNullSafe(F.col("_fx_keep")))

    once = kept(live.where("_fx_m = 1")).select(*docs.columns)
    if live.where("_fx_m > 1").isEmpty():
        return once
    again = kept(live.where("_fx_m > 1")).groupBy("_fx_digest").agg(F.any_value(F.struct(*docs.columns)).alias("_fx_row"))
    return once.unionByName(again.select("_fx_row.*"))
