"""Text kept in chunks, and questions about keys that chunks send to buckets and get answered.

Operators that compare word windows of all documents do so in three steps: each chunk sends its distinct keys
to buckets dealt by key, a bucket sees which keys several chunks share, and it answers each chunk with those of
its keys that matter. Keys travel packed, some bytes each, and a key that a chunk holds many times travels once,
so a hot key costs at most one entry per chunk.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.llm.common import Scratch
from fixity_spark.llm.words import slices, text_buffer

#: Least bytes of text that ask together (a longer document does so alone), of text for each bucket of keys, and of text
#: for each message between the two; what the first two may grow to.
CHUNK_BYTES, BUCKET_BYTES, MESSAGE_BYTES = 2 << 20, 8 << 20, 48
MOST_BYTES, MOST_BUCKET_BYTES = 32 << 20, 64 << 20
LEAST_BUCKETS = 256
#: Bytes of a key that a bucket compares; the bucket's own number holds more.
SHORT = 4


def write_chunks(docs: DataFrame, scratch: Scratch, table: str = "chunks") -> DataFrame:
    """(chunk, n_bytes, blob) of docs(doc_id, text), written once; blob is a compressed Arrow stream."""

    def pack(batches):
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            _, off = text_buffer(b.column(1))
            rows = pa.table({"doc_id": b.column(0), "text": b.column(1)})
            for i, j in slices(off, CHUNK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.slice(i, j - i).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([int(off[j] - off[i])]), pa.array([sink.getvalue().to_pybytes()])], ["chunk", "n_bytes", "blob"])
                chunk += 1

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.write(narrow.mapInArrow(pack, "chunk long, n_bytes long, blob binary"), table)


def open_chunk(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text bytes, document offsets and ids of the chunks that ask together."""
    rows = pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in blobs)
    if len(blobs) > 1:  # offsets of 32 bits may not reach over all of them
        rows = rows.set_column(1, "text", rows["text"].cast(pa.large_string()))
    rows = rows.combine_chunks()
    text = rows["text"].chunk(0) if rows["text"].num_chunks else pa.array([], pa.string())
    ids = rows["doc_id"].chunk(0) if rows["doc_id"].num_chunks else pa.array([], pa.int64())
    return *text_buffer(text), ids


def asking(batches):
    """(chunk, blobs) of rows (chunk, blob) that follow each other with one chunk number."""
    rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for chunk, found in itertools.groupby(rows, key=lambda row: row[0]):
        yield chunk, [blob for _, blob in found]


def shares(total: int) -> tuple[int, int]:
    """For total bytes of text: how many chunks ask together, and the number of buckets.

    Each group of chunks sends each bucket a message, so the bytes of both grow with the root of the total, and a
    key that all documents hold is an entry for each group.
    """
    together = max(1, min(math.isqrt(MESSAGE_BYTES * total), MOST_BYTES) // CHUNK_BYTES)
    each = min(max(BUCKET_BYTES, MESSAGE_BYTES * total // (together * CHUNK_BYTES)), MOST_BUCKET_BYTES)
    return together, max(LEAST_BUCKETS if total > 4 << 20 else 8, total // each)


def deal(chunks: DataFrame) -> tuple[DataFrame, int]:
    """chunks (chunk, blob) with one number for those that ask together, and the number of buckets."""
    together, buckets = shares(chunks.agg(F.sum("n_bytes").alias("n")).first().n or 0)
    task = F.expr("chunk - chunk % 4294967296")
    return chunks.select((task + F.expr(f"chunk % 4294967296 div {together}")).alias("chunk") if together > 1 else "chunk", "blob"), buckets


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys, so sorted keys fall into them in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def short_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What tells keys apart once they are in buckets: the bucket and the low bytes."""
    return bucket_of(keys, buckets) << np.uint64(8 * SHORT) | keys & np.uint64((1 << 8 * SHORT) - 1)


def pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]).tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(data, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").reshape(-1)


def pack_planes(values: np.ndarray) -> bytes:
    """Fixed-width values byte plane by byte plane; planes of high bytes are mostly constant and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpack_planes(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The values of all messages of a column."""
    width = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).reshape(-1) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def messages(chunk: int, keys: np.ndarray, buckets: int, columns: dict[str, list]) -> pa.RecordBatch | None:
    """One row (bucket, chunk, columns) for each bucket that the sorted keys fall into.

    columns: for each name a function of a slice of positions that packs what is sent.
    """
    if not len(keys):
        return None
    bucket = bucket_of(keys, buckets)
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    cut = [slice(a, b) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), pa.array([chunk] * len(cut), pa.int64()), *(pa.array([pack(c) for c in cut], pa.binary()) for pack in columns.values())], ["bucket", "chunk", *columns])


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each key is among the sorted known ones."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
