"""Best-fit packing of documents into fixed-size training sequences, with conflicts."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.llm.common import Scratch
from fixity_spark.llm.words import lower_ascii, text_buffer, word_counts

#: Words in a bin, and documents of one source that may share a bin.
CAPACITY, PER_SOURCE = 2048, 4
#: Rests packed together; shards are independent, so their number grows with the input. Larger shards pack tighter
#: and take longer: at sf0.1 shards of 1,000 give 1,798 bins, one shard 1,792, and 1,788.9 is the least there can be.
SHARD = 1000


def _measure(batches):
    """Adds _fx_words and _fx_cluster, a 64-bit digest of the text after lower-casing A-Z."""
    for b in batches:
        raw, off = text_buffer(b.columns[-1])
        low = lower_ascii(raw).tobytes()
        marks = [int.from_bytes(hashlib.blake2b(low[off[i] : off[i + 1]], digest_size=8).digest(), "little", signed=True) for i in range(len(off) - 1)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(word_counts(b.columns[-1]), pa.int64()), pa.array(marks, pa.int64())], [*b.schema.names[:-1], "_fx_words", "_fx_cluster"])


class Bins:
    """Open bins ordered by room left; each carries a bitmap of source slots and one of duplicate clusters."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (room, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The tightest compatible bin and the offset in it; a new bin where there is none.

        The successor search starts at the smallest room that holds the piece and goes on to roomier bins
        while the bin holds a piece of the same cluster or has no free slot for the source.
        """
        mine = ((1 << self.per_source) - 1) << (source * self.per_source)
        own = 1 << cluster
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, b = self.order[at]
            if not self.clusters[b] & own and self.sources[b] & mine != mine:
                del self.order[at]
                break
            at += 1
        else:
            room, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        free = mine & ~self.sources[b]
        self.sources[b] |= free & -free
        self.clusters[b] |= own
        if room > size:
            insort(self.order, (room - size, b))
        return b, self.capacity - room


def pack_shard(rows: list[tuple], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster) row, placed from the largest down in the order given."""
    bins, names, groups = Bins(capacity, per_source), {}, {}
    out: list = [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: -rows[i][0]):
        size, source, cluster = rows[i]
        out[i] = bins.place(size, names.setdefault(source, len(names)), groups.setdefault(cluster, len(groups)))
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, source, piece, start, n_words, bin_id, bin_offset.

    Sizes are counts of words. A document over the capacity is cut into full pieces, each a bin of its own,
    and a rest; rests and shorter documents are placed by best fit, largest first. A bin never holds two
    pieces of equal texts (after lower-casing A-Z) nor more than per_source pieces of one source; a null
    source is a source of its own. Null, empty and blank texts take no room and give one row with piece 0, no
    words and a null bin. Rows repeated with the same id are packed each. An empty table gives no rows.

    Rows are dealt to shards of about `shard` rows by a hash of id and row, so that neither a hot source nor
    copies meet in one task; each shard is packed alone, at a loss of at most some half-filled bins a shard. Bins are
    numbered within their shard, those of full pieces after the others, so no two bins share a number. Which row goes
    to which shard follows the order of the files; reading the same files again gives the same bins.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    narrow = docs.select(F.monotonically_increasing_id().alias("_fx_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").alias("_fx_text"))
    sized = scratch.write(narrow.mapInArrow(_measure, "_fx_row long, doc_id long, source string, _fx_words long, _fx_cluster long"), "sized")
    shards = max(1, sized.where("_fx_words > 0").count() // shard)
    key = F.pmod(F.xxhash64("doc_id", "_fx_row"), F.lit(shards)).cast("int")
    held = sized.where("_fx_words > 0").select(key.alias("_fx_shard"), "_fx_row", "doc_id", "source", "_fx_cluster", F.expr(f"_fx_words div {capacity}").alias("piece"), F.expr(f"_fx_words div {capacity} * {capacity}").alias("start"), F.expr(f"_fx_words % {capacity}").alias("n_words"))
    columns = ["doc_id", "source", "piece", "start", "n_words"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("_fx_row", "ascending")])
        rest = table.filter(pc.greater(table["n_words"], 0))
        got = pack_shard(list(zip(rest["n_words"].to_pylist(), rest["source"].to_pylist(), rest["_fx_cluster"].to_pylist(), strict=True)), capacity, per_source)
        # full pieces come before the rest of a document, which names their number
        pieces = table["piece"].to_numpy()
        whole = table.select(columns).take(pa.array(np.repeat(np.arange(len(pieces)), pieces)))
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        for name, values in (("piece", nth), ("start", nth * capacity), ("n_words", np.full(len(nth), capacity))):
            whole = whole.set_column(columns.index(name), name, pa.array(values, pa.int64()))
        out = pa.concat_tables([rest.select(columns), whole])
        bins = np.array([x[0] for x in got], np.int64)
        bins = np.append(bins, bins.max(initial=-1) + 1 + np.arange(len(nth))) + (np.int64(table["_fx_shard"][0].as_py()) << 32)
        return out.append_column("bin_id", pa.array(bins)).append_column("bin_offset", pa.array([*(x[1] for x in got), *[0] * len(nth)], pa.int64()))

    packed = held.groupBy("_fx_shard").applyInArrow(pack, "doc_id long, source string, piece long, start long, n_words long, bin_id long, bin_offset long")
    none = F.lit(None).cast("long")
    empty = sized.where("_fx_words = 0").select("doc_id", "source", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"), none.alias("bin_id"), none.alias("bin_offset"))
    return packed.unionByName(empty)
