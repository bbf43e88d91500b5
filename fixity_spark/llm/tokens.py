"""Token ids of all documents as Huffman-coded blocks, written and read back."""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixity_spark.llm.common import Scratch, shuffle_partitions
from fixity_spark.llm.langid import _byte_of, vocabulary_path
from fixity_spark.llm.words import HashIndex, Store, slices, span_hashes, text_buffer

#: Id appended to each document, bits of a code at most, tokens between checkpoints, tokens of a block at least.
END, MAX_BITS, STRIDE, BLOCK = 2, 20, 64, 1 << 18
#: Bytes of text encoded together.
TEXT = 2 << 20


class Encoder:
    """Token ids of whole texts through the tokenizers library, each distinct stretch of text encoded once.

    Before a single space between two graphic characters a pre-token always begins, so a text may be cut
    there and the ids of the parts joined. Stretches are kept by 64-bit hash for the life of a worker.
    """

    KEPT = 2_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        table = _byte_of()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.width = np.zeros(vocabulary_size(path), np.int64)
        for piece, k in model["model"]["vocab"].items():
            self.width[k] = len(piece) if all(c in table for c in piece) else len(piece.encode())
        for x in model["added_tokens"]:
            self.width[x["id"]] = len(x["content"].encode())
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex()
        self.at, self.count, self.ids = Store(np.zeros(0, np.int64)), Store(np.zeros(0, np.int32)), Store(np.zeros(0, np.uint32))

    def _fresh(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the stretches, joined in some order, and where those of each begin and how many they are.

        Plain stretches are encoded in runs and told apart by the bytes that their ids stand for.
        """
        parts, held = [], 0
        begin, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        rows = np.flatnonzero(plain)
        for i in range(0, len(rows), 4000):
            some = rows[i : i + 4000]
            size = end[some] - start[some]
            ids = np.array(self.tokenizer.encode(raw[ragged(start[some], size)].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            cut = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(size)) + 1
            count[some] = np.diff(cut, prepend=0)
            begin[some] = held + cut - count[some]
            parts.append(ids)
            held += len(ids)
        for k in np.flatnonzero(~plain):
            ids = np.array(self.tokenizer.encode(raw[start[k] : end[k]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            begin[k], count[k] = held, len(ids)
            parts.append(ids)
            held += len(ids)
        return np.concatenate(parts), begin, count

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents, joined, and the count of each document."""
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        graphic = (raw > 0x20) & (raw < 0x7F)
        latin = raw == 0xC3
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:] = graphic[:-1]
        before[2:] |= latin[:-2]
        after[:-1] = (graphic | latin)[1:]
        cut = (raw == 32) & before & after
        heads = off[:-1][off[1:] > off[:-1]]
        near = np.concatenate([heads, heads + 1, heads - 1])
        cut[near[(near >= 0) & (near < len(raw))]] = False  # neighbours must be of the same document
        inner = cut.copy()
        cut[heads] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(raw))
        last_ok = graphic[end - 1] | np.append(inner[start[1:]], False)
        plain = inner[start] & last_ok
        h = span_hashes(raw, start, end)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        row = self.index.find(distinct)
        if (new := row < 0).any():
            if len(self.index) + int(new.sum()) > self.KEPT:
                self._forget()
                new = np.ones(len(distinct), bool)
            f = first[new]
            ids, begin, count = self._fresh(raw, start[f], end[f], plain[f])
            row[new] = self.at.append(self.ids.append(ids) + begin) + np.arange(len(f))
            self.count.append(count)
            self.index.add(distinct[new], row[new])
        row = row[back]
        counts = self.count.rows[row].astype(np.int64)
        ids = self.ids.rows[ragged(self.at.rows[row], counts)]
        doc = np.searchsorted(off, start, side="right") - 1
        return ids, np.bincount(doc, counts, minlength=n).astype(np.int64)


def ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions begin[0].. begin[0]+count[0]-1, begin[1]..., joined."""
    total = int(count.sum())
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(total)


def with_ends(ids: np.ndarray, counts: np.ndarray, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Appends the end id to each document."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits, by package-merge; 0 for symbols never seen."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    leaves, merged = [np.ones(len(order), bool)], weights
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        leaves.append(rank < len(weights))
    take, got = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for level in reversed(leaves):
        k = int(level[:take].sum())
        got[:k] += 1
        take = 2 * (take - k)
    lengths[order] = got
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        size = lengths[order].astype(np.uint64)
        step = np.uint64(1) << (size.max() - size)
        codes[order] = (np.cumsum(step) - step) >> (size.max() - size)
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids' codes, high bits first, and the bits of each run of STRIDE ids."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at, code = ends - size, codes[ids]
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    word, over = at >> 6, (at & 63) + size - 64
    split = over > 0
    left = np.where(split, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
    firsts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    if len(firsts):
        words[word[firsts]] = np.bitwise_or.reduceat(left, firsts)
        words[word[split] + 1] |= code[split] << (64 - over[split]).astype(np.uint64)
    marks = at[::STRIDE]
    return words.astype(">u8").tobytes()[: (total + 7) // 8], np.diff(np.append(marks, total)).astype(np.uint16)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each MAX_BITS bits that a code may begin."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    fill = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.int64)
    total = int(fill.sum())
    symbols[:total], sizes[:total] = np.repeat(order, fill), np.repeat(lengths[order], fill)
    return symbols, sizes


def unpack_bits(payload: bytes, runs: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block; all runs between checkpoints are decoded side by side."""
    symbols, sizes = table
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.int64)
    at = np.cumsum(runs.astype(np.int64)) - runs
    out = np.zeros((STRIDE, len(runs)), np.uint32)
    tail = n - STRIDE * (len(runs) - 1) if len(runs) else 0
    for k in range(STRIDE):
        if k == tail:
            at = at[:-1]
        byte = at >> 3
        window = ((raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]) >> (32 - MAX_BITS - (at & 7))) & ((1 << MAX_BITS) - 1)
        out[k, : len(at)] = symbols[window]
        at = at + sizes[window]
    return out.T.reshape(-1)[:n]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_IDS = "doc_id long, ids binary, tokens binary, counts binary"


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids) of docs(doc_id, text), end id included, and one row (tokens, counts) of each task.

    ids is little-endian, two bytes an id where the vocabulary allows, else four.
    """

    def encode(batches):
        encoder = _encoder(path)
        kind = _kind(len(encoder.width))
        total = np.zeros(len(encoder.width), np.int64)
        for b in batches:
            raw, off = text_buffer(b.column(1))
            for i, j in slices(off, TEXT):
                ids, counts = with_ends(*encoder.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i]))
                total += np.bincount(ids, minlength=len(total))
                data = ids.astype(kind)
                ends = np.append(0, np.cumsum(counts)) * data.itemsize
                rows = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                none = pa.nulls(j - i, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), rows, none, none], ["doc_id", "ids", "tokens", "counts"])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([used.astype("<i4").tobytes()], pa.binary()), pa.array([total[used].astype("<i8").tobytes()], pa.binary())], ["doc_id", "ids", "tokens", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, _IDS)


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    return 1 + max([*model["model"]["vocab"].values(), *(x["id"] for x in model["added_tokens"])])


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def token_counts(encoded: DataFrame) -> np.ndarray:
    """Count of each id over all rows of token_ids; one row per id reaches the driver."""

    def add(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for tokens, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if tokens:
                    more = np.bincount(np.frombuffer(tokens, "<i4"), np.frombuffer(counts, "<i8")).astype(np.int64)
                    both = np.zeros(max(len(total), len(more)), np.int64)
                    both[: len(total)] += total
                    both[: len(more)] += more
                    total = both
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    rows = encoded.where("ids IS NULL").select("tokens", "counts").mapInArrow(add, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 + int(rows["token"].max() if len(rows) else END), np.int64)
    out[rows["token"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


#: Bytes of ids that a shard holds, about; a task sorts one.
SHARD_BYTES = 256 << 20
BLOCKS = "shard int, block int, offset long, n_tokens long, n_docs long, doc_ids binary, null_ids binary, doc_tokens binary, runs binary, payload binary"


def write_tokens(docs: DataFrame, out: str, path: str | None = None) -> None:
    """Writes docs(doc_id, text) as token ids in ascending doc_id order: out/codebook and out/blocks.

    codebook: (token, bits), the lengths of a canonical Huffman code of at most MAX_BITS bits from the
    global counts. blocks: rows (shard, block, offset, n_tokens, n_docs, doc_ids, null_ids, doc_tokens, runs,
    payload); shards are ranges of doc_id in order, offset counts the shard's ids before the block, runs holds
    the bits between checkpoints every STRIDE ids, and payload decodes without any other block. Blocks end
    with a document. Null ids come first; rows repeated with the same id follow each other.
    """
    path = path or vocabulary_path()
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    encoded = scratch.write(token_ids(docs, path), "ids")
    lengths = code_lengths(token_counts(encoded))
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist(), strict=True)), "token long, bits int").coalesce(1).write.mode("overwrite").parquet(f"{out}/codebook")
    shared = spark.sparkContext.broadcast(lengths)
    kind = _kind(vocabulary_size(path))

    def block(shard, number, offset, rows):
        lengths = shared.value
        if 0 not in _CODES or _CODES[0][0] is not lengths:
            _CODES[0] = (lengths, canonical_codes(lengths))
        ids = np.frombuffer(b"".join(data for _, data in rows), kind)
        counts = np.array([len(data) for _, data in rows], np.int64) // ids.itemsize
        payload, runs = pack_bits(ids, _CODES[0][1], lengths)
        docs = np.array([doc or 0 for doc, _ in rows], np.int64)
        null = np.packbits([doc is None for doc, _ in rows])
        values = [shard, number, offset, len(ids), len(counts), docs.tobytes(), null.tobytes(), counts.tobytes(), runs.tobytes(), payload]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK_TYPES, strict=True)], names=_BLOCK_NAMES)

    def encode(batches):
        _ENCODERS.clear()  # a worker that goes on from the step before holds a large one
        width = np.dtype(kind).itemsize
        shard, number, offset, rows, held = TaskContext.get().partitionId(), 0, 0, [], 0
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.append((doc, data))
                held += len(data) // width
                if held >= BLOCK:
                    yield block(shard, number, offset, rows)
                    number, offset, rows, held = number + 1, offset + held, [], 0
        if rows:
            yield block(shard, number, offset, rows)

    # shards by counted bytes; rows of one id may be of several shards, in order of a hash
    held = encoded.agg(F.sum(F.length("ids").cast("long")).alias("n")).first().n or 0
    shards = max(shuffle_partitions(spark), -(-held // SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h").asc()]
    ordered = encoded.where("ids IS NOT NULL").select("doc_id", "ids", F.xxhash64("ids").alias("_h")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "ids").mapInArrow(encode, BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{out}/blocks")
    scratch.drop("ids")


_CODES: dict = {}
_TABLES: dict = {}
_BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
_BLOCK_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in BLOCKS.split(", ")]


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and ids, when asked for) of each document in the files at out."""
    book = spark.read.schema("token long, bits int").parquet(f"{out}/codebook").toPandas()
    lengths = np.zeros(1 + int(book["token"].max() if len(book) else END), np.uint8)
    lengths[book["token"].to_numpy(np.int64)] = book["bits"].to_numpy(np.uint8)
    shared = spark.sparkContext.broadcast(lengths)

    def decode(batches):
        lengths = shared.value
        if 0 not in _TABLES or _TABLES[0][0] is not lengths:
            _TABLES[0] = (lengths, decode_table(lengths))
        table = _TABLES[0][1]
        for b in batches:
            for r in b.to_pylist():
                ids = unpack_bits(r["payload"], np.frombuffer(r["runs"], np.uint16), r["n_tokens"], table)
                counts = np.frombuffer(r["doc_tokens"], np.int64)
                ends = np.cumsum(counts)
                plain = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(memoryview(plain)[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                null = np.unpackbits(np.frombuffer(r["null_ids"], np.uint8))[: len(counts)].astype(bool)
                columns = [pa.array([r["shard"]] * len(counts), pa.int32()), pa.array(np.frombuffer(r["doc_ids"], np.int64), mask=null), pa.array(r["offset"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "within", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = blocks.mapInArrow(decode, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return rows.join(starts, "shard").select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes docs, reads the files back and returns doc_id, start, n_tokens and ids_crc32 from them.

    A null or empty text has the end id alone. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    out = scratch.path("files")
    write_tokens(docs, out, path)
    return read_tokens(docs.sparkSession, out)
