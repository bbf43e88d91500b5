"""Toxic spans by a linear-chain conditional random field over words, and document scores from its marginals.

Labels come per document. Words, and beginnings of words, that toxic documents hold far more often than others label the
tokens of toxic documents; the field is fitted on windows of such tokens, so that context, parts of words and runs of
toxic words count, too. Forward-backward marginals of all words of a text give its offending offsets, and their largest
value, sum and number of words give its score, calibrated on labelled documents that nothing was fitted on.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixity_spark.llm.common import Scratch, free_worker, tune
from fixity_spark.llm.words import _BASES, _BYTES, _LOWER, _powers, mix, slices, text_buffer, word_spans

#: Labelled documents drawn of each class, in expectation: half to fit the field on, half to calibrate scores.
TRAIN_DOCS = 10_000
#: Words of a window that is fitted on, windows of a document around evidence and elsewhere.
WINDOW, AROUND, ELSEWHERE = 24, 3, 2
#: A word or beginning is evidence if toxic documents hold it so many times as often as others, and at least so often.
LIFT, LEAST = 4, 3
#: Steps of fitting, their size and the penalty on weights.
STEPS, RATE, RIDGE = 60, 0.5, 1e-5

#: Bytes of beginnings and of the ending that are features, and weights.
BEGINNINGS, ENDING = (4, 5, 6, 7, 8, 9), 4
BITS = 18
_EVIDENCE = 1 + len(BEGINNINGS)
FEATURES = _EVIDENCE + 1 + 2 + 1

_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class Model(NamedTuple):
    weights: np.ndarray  #: by feature; the first one stands for features that a word does not have
    moves: np.ndarray  #: scores of going from one state to the next; state 1 is toxic
    score: np.ndarray  #: weights of a document's largest marginal, sum, number of words, and constant


def _features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts (start, end, text) and 64-bit hashes of each one's evidence features, 0 where it has none.

    A word counts without signs at its ends and with A-Z lower-cased.
    """
    start, end, doc = word_spans(raw, off)
    if not len(start):
        return start, end, doc, np.zeros((0, _EVIDENCE), np.uint64)
    places = np.arange(len(raw))
    letter = _LETTER[raw]
    following = np.minimum.accumulate(np.where(letter, places, len(raw))[::-1])[::-1]
    last = np.maximum.accumulate(np.where(letter, places, -1))
    a = np.minimum(following[start], end)
    b = np.maximum(last[end - 1] + 1, a)
    power, inverse = _powers(_BASES[0][0], len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[0][_LOWER[raw]] * power[: len(raw)], out=total[1:])

    def hashes(x, y, kind):
        h = (total[y] - total[x]) * inverse[x]
        return np.where(y > x, mix(h + (y - x).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(kind)) | np.uint64(1), 0)

    out = np.zeros((len(start), _EVIDENCE), np.uint64)
    out[:, 0] = hashes(a, b, 1)
    for k, size in enumerate(BEGINNINGS, 1):
        out[:, k] = hashes(a, np.where(b - a >= size, a + size, a), 2)
    return start, end, doc, out


def _inputs(raw: np.ndarray, off: np.ndarray):
    """Words (start, end, text), hashes of evidence features, and the weights' places of all features of each word."""
    start, end, doc, own = _features(raw, off)
    n = len(start)
    place = np.zeros((n, FEATURES), np.int32)
    if not n:
        return start, end, doc, own, place
    at = lambda h: np.where(h > 0, (h >> np.uint64(64 - BITS)).astype(np.int32) + 1, 0)
    place[:, :_EVIDENCE] = at(own)
    # the ending: the word's last bytes, hashed as they stand
    tail = np.maximum(end - ENDING, start)
    code = np.zeros(n, np.uint64)
    for k in range(ENDING):
        code = code * np.uint64(256) + np.where(tail + k < end, _LOWER[raw[np.minimum(tail + k, len(raw) - 1)]], 0).astype(np.uint64)
    place[:, _EVIDENCE] = at(mix(code + np.uint64(3 << 40)))
    word = own[:, 0]
    same = doc[1:] == doc[:-1]
    place[1:, _EVIDENCE + 1] = np.where(same, at(mix(word[:-1] + np.uint64(5)) | np.uint64(1)), 0)
    place[:-1, _EVIDENCE + 2] = np.where(same, at(mix(word[1:] + np.uint64(7)) | np.uint64(1)), 0)
    place[:, _EVIDENCE + 3] = (1 << BITS) + 1  # the constant
    return start, end, doc, own, place


def marginals(toxic: np.ndarray, begins: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probability of state 1 for each word of chains that follow each other, and, with pairs, the expected moves.

    toxic: score of state 1 of each word, of state 0 it is 0; begins: whether a chain begins there. All chains are one,
    with a matrix that forgets what was before where one begins. It is cut into blocks: products of the matrices of a
    block are taken for all blocks at once, then states are carried from block to block.
    """
    n = len(toxic)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    m = np.empty((blocks * size, 2, 2))
    peak = np.maximum(toxic, 0)
    emit = np.stack([np.exp(-peak), np.exp(toxic - peak)], axis=1)
    step = np.exp(moves - moves.max())
    m[:n] = np.where(begins[:, None, None], 1.0, step[None]) * emit[:, None, :]
    m[n:] = np.eye(2)
    m = m.reshape(blocks, size, 2, 2)

    def scan(matrices, carry):
        """States after each matrix, blocks x size x 2, scaled to sum 1."""
        product, held = np.tile(np.eye(2), (blocks, 1, 1)), np.empty((size, blocks, 2, 2))
        for k in range(size):
            product = product @ matrices[:, k]
            product /= product.sum(axis=(1, 2), keepdims=True)
            held[k] = product
        whole, into = held[-1].tolist(), []
        x, y = carry
        for (a, b), (c, d) in whole:
            into.append((x, y))
            x, y = x * a + y * c, x * b + y * d
            x, y = x / (x + y), y / (x + y)
        out = (np.array(into)[None, :, None, :] @ held)[:, :, 0, :].transpose(1, 0, 2)
        return out / out.sum(axis=2, keepdims=True)

    ahead = scan(m, (0.5, 0.5)).reshape(-1, 2)[:n]
    # from the end: the state before a word, of what comes from it on
    turned = np.ascontiguousarray(m.reshape(-1, 2, 2)[::-1].transpose(0, 2, 1)).reshape(blocks, size, 2, 2)
    before = scan(turned, (0.5, 0.5)).reshape(-1, 2)[::-1]
    behind = np.concatenate([before[1:], [[0.5, 0.5]]])[:n]
    both = ahead * behind
    p = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return p, None
    inner = np.flatnonzero(~begins)
    joint = ahead[inner - 1][:, :, None] * m.reshape(-1, 2, 2)[inner] * behind[inner][:, None, :]
    return p, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit_field(place: np.ndarray, toxic: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of the field that make the labels of the windows' words likeliest, by steps of their own size
    for each weight (Adagrad)."""
    weights, moves = np.zeros((1 << BITS) + 2), np.zeros((2, 2))
    seen_w, seen_m = np.full(len(weights), 1e-8), np.full((2, 2), 1e-8)
    inner = np.flatnonzero(~begins)
    observed = np.bincount(2 * toxic[inner - 1] + toxic[inner], minlength=4).reshape(2, 2)
    flat = place.ravel()
    for _ in range(STEPS):
        p, expected = marginals(weights[place].sum(axis=1), begins, moves, pairs=True)
        g = np.bincount(flat, np.repeat(p - toxic, place.shape[1]), minlength=len(weights)) / len(p) + RIDGE * weights
        g[0] = 0
        seen_w += g * g
        weights -= RATE * g / np.sqrt(seen_w)
        g = (expected - observed) / len(p) + RIDGE * moves
        seen_m += g * g
        moves -= RATE * g / np.sqrt(seen_m)
    return weights.astype(np.float32), moves


def _document_inputs(p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Log odds of the largest marginal, logs of their sum and of the number of words, and 1, for each text."""
    top, total = np.zeros(n_docs), np.bincount(doc, p, minlength=n_docs)
    np.maximum.at(top, doc, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log1p(total), np.log1p(np.bincount(doc, minlength=n_docs)), np.ones(n_docs)], axis=1)


def fit_scores(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - w), -4, 4)
    return w


def _texts(batch: pa.RecordBatch, column: int):
    """(first row, rows, raw, offsets) of stretches of a batch."""
    raw, off = text_buffer(batch.column(column))
    for i, j in slices(off):
        yield i, j - i, raw[off[i] : off[j]], off[i : j + 1] - off[i]


def _signatures(batches):
    """Two smallest hashes of three words in a row of each text, by two functions: near copies share them."""
    for b in batches:
        free_worker()
        out = np.zeros((2, b.num_rows), np.int64)
        for i, n, raw, off in _texts(b, 1):
            _, _, doc, own = _features(raw, off)
            word, m = own[:, 0], len(own) - 2
            if m > 0:
                triple = mix(word[:m] + np.uint64(3) * mix(word[1 : m + 1]) + np.uint64(5) * mix(word[2:] + np.uint64(1)))
                inside = np.flatnonzero(doc[:m] == doc[2:])
                for k in range(2):
                    least = np.full(n, np.uint64(2**64 - 1))
                    np.minimum.at(least, doc[inside], mix(triple[inside] + np.uint64(k)))
                    out[k, i : i + n] = least.view(np.int64)
        # texts of fewer than three words share one signature
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0]), pa.array(out[1])], [*b.schema.names, "s1", "s2"])


def _evidence(batches):
    """(feature, toxic documents, other documents) of the texts of a task, each text counted once."""
    for b in batches:
        free_worker()
        for i, n, raw, off in _texts(b, 0):
            _, _, doc, own = _features(raw, off)
            y = b.column(1).to_numpy(zero_copy_only=False)[i : i + n]
            h = own.ravel()
            key = np.unique(np.stack([h, np.repeat(doc, _EVIDENCE).astype(np.uint64)], axis=1)[h > 0], axis=0)
            if len(key):
                names, at = np.unique(key[:, 0], return_inverse=True)
                toxic = np.bincount(at, y[key[:, 1].astype(np.int64)], minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(names)) - toxic)], ["h", "t", "c"])


def _windows(lexicon: np.ndarray):
    """Windows of the texts of a task: (key, places of features, labels) in order of key."""

    def run(batches):
        for b in batches:
            free_worker()
            keys, places, labels = [], [], []
            for i, n, raw, off in _texts(b, 0):
                _, _, doc, own, place = _inputs(raw, off)
                hit = np.isin(own, lexicon).any(axis=1)
                size = np.bincount(doc, minlength=n)
                first = np.cumsum(size) - size
                y, draw = b.column(1).to_numpy(zero_copy_only=False)[i : i + n], b.column(2).to_numpy(zero_copy_only=False)[i : i + n].astype(np.uint64)
                for d in np.flatnonzero(size).tolist():
                    f, m = int(first[d]), int(size[d])
                    order = np.argsort(mix(np.arange(m, dtype=np.uint64) + draw[d]))  # places in no order of the text
                    own_hits = order[hit[f : f + m][order]][:AROUND]
                    for at in sorted({max(0, min(int(k) - WINDOW // 2, m - WINDOW)) for k in (*own_hits, *order[:ELSEWHERE])}):
                        rows = slice(f + at, f + min(at + WINDOW, m))
                        keys.append((int(draw[d] >> np.uint64(1)), at))
                        places.append(place[rows].tobytes())
                        labels.append((hit[rows] & (y[d] == 1)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([a for _, a in keys], pa.int64()), pa.array(places, pa.binary()), pa.array(labels, pa.binary())], ["draw", "at", "place", "label"])

    return run


def _scored(raw: np.ndarray, off: np.ndarray, n: int, model: Model):
    start, end, doc, _, place = _inputs(raw, off)
    begins = np.ones(len(doc), bool)
    begins[1:] = doc[1:] != doc[:-1]
    p, _ = marginals(model.weights[place].sum(axis=1, dtype=np.float64), begins, model.moves)
    return start, end, doc, p, _document_inputs(p, doc, n)


def learned(doc_id: Column | None = None) -> Column:
    """Rows that labels are learned from: the CRC of the id is no multiple of 5."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | float:
    """The model, or, where no word tells toxic documents from others, the share of toxic labels.

    Learned from the text and label of a bounded draw of labelled rows with learned(); ids labelled both ways are left
    out, and of texts that share a smallest hash of three words in a row one is taken, as is one of all texts of fewer words, so
    that a group of copies does not make its words evidence. Only the drawn labels are broadcast, about 2 train_docs of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(learned())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_high")).where("y = _high").drop("_high")
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return float(n.get(1, 0) > 0)
    base = n[1] / (n[0] + n[1])
    rate = {y: min(1.0, train_docs / n[y]) for y in n}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 1)
    drawn = known.withColumn("draw", draw).where(F.col("draw") < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]) * F.lit(2.0**63))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.select("doc_id", "text", "y", "draw").mapInArrow(_signatures, "doc_id long, text string, y int, draw long, s1 long, s2 long")
    least = lambda df, s: df.join(df.groupBy(s).agg(F.min(F.struct("doc_id", F.xxhash64("text"))).alias("_m")).select(s, "_m.doc_id").distinct(), [s, "doc_id"], "left_semi")
    kept = scratch.write(rows, "drawn")
    kept = scratch.write(least(least(kept, "s1"), "s2").select("text", "y", "draw"), "kept")
    half = F.col("draw").bitwiseAND(1)
    fitted, held = kept.where(half == 0), kept.where(half == 1)
    sizes = {r.y: r.n for r in fitted.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counts = scratch.write(fitted.select("text", "y").mapInArrow(_evidence, "h long, t long, c long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(f"t >= {LEAST}"), "counts")
    n1, n0, tried = sizes.get(1, 0), sizes.get(0, 0), counts.count()
    # twice the log likelihood ratio of different shares; as many features are tried, chance gives some of them much
    both, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
    gain = 2 * (t * F.log(t * (n0 + n1) / (both * max(n1, 1))) + F.when(c > 0, c * F.log(c * (n0 + n1) / (both * max(n0, 1)))).otherwise(0.0))
    strong = counts.where(gain >= 2 * (math.log(max(tried, 1)) + 3)).where(t * n0 >= LIFT * c * n1)
    lexicon = np.sort(np.array([r.h for r in strong.select("h").collect()], np.int64).view(np.uint64))  # of a bounded draw
    if not len(lexicon):
        return base
    windows = fitted.mapInArrow(_windows(lexicon), "draw long, at long, place binary, label binary").collect()
    windows.sort(key=lambda r: (r.draw, r["at"], bytes(r.place)))
    place = np.concatenate([np.frombuffer(bytes(r.place), np.int32).reshape(-1, FEATURES) for r in windows])
    toxic = np.concatenate([np.frombuffer(bytes(r.label), np.uint8) for r in windows]).astype(np.int64)
    begins = np.zeros(len(toxic), bool)
    begins[np.cumsum([0, *(len(r.label) for r in windows[:-1])])] = True
    del windows
    field = Model(*fit_field(place, toxic, begins), np.zeros(4))
    del place
    shared = spark.sparkContext.broadcast(field)

    def inputs(batches):
        for b in batches:
            free_worker()
            for i, m, raw, off in _texts(b, 0):
                x = _scored(raw, off, m, shared.value)[-1]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, m), b.column(2).slice(i, m), pa.array(list(x), pa.list_(pa.float64()))], ["y", "draw", "x"])

    got = sorted(((r.draw, r.y, tuple(r.x)) for r in held.mapInArrow(inputs, "y int, draw long, x array<double>").collect()))
    x, y = np.array([r[2] for r in got]).reshape(-1, 4), np.array([r[1] for r in got])
    return field._replace(score=fit_scores(x, y, np.where(y == 1, 1 / rate[1], 1 / rate[0])))


_SCHEMA = "doc_id long, held_out boolean, score double, predicted int, spans string"


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, spans.

    score: how likely label 1 is, from the text alone; predicted is 1 from a score of 0.5 on. held_out: labels of this id
    are not learned from; false where the id is null. spans: words whose marginal is 0.5 or more, as start:end in code
    points, end exclusive, neighbouring words joined, comma-joined. A null text counts as empty; empty texts are scored
    as texts without words; rows repeated with one id get a row each; other columns are not read. Without labels of both
    kinds, or where no word tells them apart, every row gets the share of label 1 among the labels. A text is scored as a
    whole, in one task, in time and memory that grow with its length.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, train_docs))

    def scan(batches):
        model = shared.value
        for b in batches:
            free_worker()
            score, spans = np.zeros(b.num_rows), [""] * b.num_rows
            if not isinstance(model, Model):
                score[:] = model
            else:
                for i, n, raw, off in _texts(b, 1):
                    start, end, doc, p, x = _scored(raw, off, n, model)
                    score[i : i + n] = 1 / (1 + np.exp(-np.clip(x @ model.score, -30, 30)))
                    hits = np.flatnonzero(p >= 0.5)
                    if not len(hits):
                        continue
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    joined = (np.diff(hits) == 1) & (doc[hits[1:]] == doc[hits[:-1]])
                    low, high = hits[np.concatenate([[True], ~joined])], hits[np.concatenate([~joined, [True]])]
                    base = chars[off[doc[low]]]
                    for d, s, e in zip((doc[low] + i).tolist(), (chars[start[low]] - base).tolist(), (chars[end[high]] - base).tolist(), strict=True):
                        spans[d] += f"{',' if spans[d] else ''}{s}:{e}"
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans)], ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", F.coalesce(~learned(), F.lit(False)).alias("held_out")).mapInArrow(scan, _SCHEMA)
