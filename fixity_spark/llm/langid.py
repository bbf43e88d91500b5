"""Language identification by unigram pieces, summing over all segmentations of each word."""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.llm.common import HELD, own_names, tune
from fixity_spark.llm.words import _BASES, _BYTES, HashIndex, Store, _powers, lower_ascii, mix, slices, span_hashes, text_buffer, word_spans

#: Labelled documents of each language that the model is fitted on, in expectation; counts of labels use all.
TRAIN_DOCS = 300
#: Bytes of a stretch that is summed over together with others; a longer one that no place cuts is summed alone.
STRETCH = 64
#: Pieces of up to this many bytes are looked up at every place, longer ones where their beginning is found.
SHORT = 12
#: Bytes of distinct words scored at once.
SCORED = 200_000
#: Languages at most: the model is a table of pieces and languages that every task holds.
LANGUAGES = 500
#: Mass added to each piece of each language.
SMOOTHING = 0.05
UNKNOWN = "und"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            table[chr(256 + extra)] = b
            extra += 1
    return table


@functools.cache
def pieces(path: str) -> list[bytes]:
    """All pieces of a byte-level vocabulary, lower-cased as texts are, without repeats."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    table = _byte_of()
    found = {bytes(table[c] for c in piece) for piece in vocabulary if all(c in table for c in piece)}
    found |= {bytes([b]) for b in range(256)}
    return sorted({fold(np.frombuffer(p, np.uint8)).tobytes() for p in found if p})


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 capitals, byte for byte."""
    raw = lower_ascii(raw)
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    capital = after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    return np.where(capital, raw + 0x20, raw).astype(np.uint8)


class _Run:
    """The forward sum over one long stretch: what is ahead of a place is kept in a ring and brought back to size."""

    def __init__(self, model: Forward, begin: int):
        self.model, self.now = model, begin
        self.ring = np.zeros((model.longest + 1, model.langs))
        self.ring[begin % len(self.ring)] = 1.0
        self.logs = np.zeros(model.langs)

    def _move(self, to: int) -> None:
        for k in range(self.now, to):
            self.ring[k % len(self.ring)] = 0.0
        self.now = to
        most = self.ring.max(0)
        if (most < 1e-100).any():
            most = np.maximum(most, 1e-300)
            self.logs += np.log(most)
            self.ring /= most

    def feed(self, found: dict, begin: int, end: int, shift: int = 0) -> None:
        """The pieces that begin from begin on and before end; places of the stretch are shift further on."""
        own = [(n, at[lo:hi], piece[lo:hi]) for n, (at, piece) in found.items() for lo, hi in [np.searchsorted(at, [begin, end])]]
        at = np.concatenate([np.zeros(0, np.int64), *(a for _, a, _ in own)])
        order = np.argsort(at, kind="stable")
        piece = np.concatenate([np.zeros(0, np.int64), *(p for _, _, p in own)])[order].tolist()
        length = np.concatenate([np.zeros(0, np.int64), *(np.full(len(a), n) for n, a, _ in own)])[order].tolist()
        ring, prob = self.ring, self.model.prob
        for i, n, p in zip((at[order] + shift).tolist(), length, piece, strict=True):
            if i != self.now:
                self._move(i)
            ring[(i + n) % len(ring)] += ring[i % len(ring)] * prob[p]

    def close(self, end: int) -> np.ndarray:
        return np.log(np.maximum(self.ring[end % len(self.ring)], 1e-300)) + self.logs


class Forward:
    """Scores distinct words of a batch together, position by position over all of them.

    log p(word | language) sums the products of piece probabilities over all segmentations, whatever the length of
    the word. Words are kept by hash, so a worker scores a word once while it stays in the table.
    """

    KEPT = 2_000_000
    #: Factor for each byte, which keeps sums of STRETCH bytes within the range of doubles.
    SCALE = 1000.0

    def __init__(self, path: str, logp: np.ndarray):
        found = pieces(path)
        raw = np.frombuffer(b"".join(found), np.uint8)
        size = np.array([len(p) for p in found])
        off = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(h := span_hashes(raw, off[:-1], off[1:]))
        self.hashes, self.prob = h[order], np.exp(logp)[order]  # pieces x languages
        self.seen = np.zeros(1 << 21, bool)
        self.seen[h >> np.uint64(43)] = True
        self.scaled = self.prob * self.SCALE ** np.minimum(size[order], STRETCH)[:, None]
        self.langs = logp.shape[1]
        self.longest = int(size.max(initial=1))
        # beginnings of the long pieces, and their lengths
        long = np.flatnonzero(size > SHORT)
        self.begins = np.unique(span_hashes(raw, off[long], off[long] + SHORT))
        self.lengths = np.unique(size[long]).tolist()
        self._forget()

    def _forget(self) -> None:
        self.index, self.scores = HashIndex(), Store(np.zeros((0, self.langs), np.float32))

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece of each hash, -1 where there is none; most are told by their first bits."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(43)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == h[maybe], at, -1)
        return out

    def hits(self, raw: np.ndarray, limit: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and numbers of the pieces of each length in raw; a piece at place i ends before limit[i]."""
        power, _ = _powers(_BASES[0][0], max(self.longest, SHORT) + 1)
        room = limit - np.arange(len(raw))
        found, at, h = {}, np.arange(len(raw)), np.zeros(len(raw), np.uint64)
        for n in range(1, min(self.longest, SHORT) + 1):
            fits = room[at] >= n
            at, h = at[fits], h[fits]
            h = h + _BYTES[0][raw[at + n - 1]] * power[n - 1]
            done = mix(h + np.uint64(n * 0xD6E8FEB86659FD93 % 2**64))
            piece = self.lookup(done)
            hit = piece >= 0
            if hit.any():
                found[n] = at[hit], piece[hit]
        if len(self.begins) and len(at):
            where = np.minimum(np.searchsorted(self.begins, done), len(self.begins) - 1)
            at = at[self.begins[where] == done]
            for n in self.lengths:
                at = at[room[at] >= n]
                if not len(at):
                    break
                piece = self.lookup(span_hashes_at(raw, at, n))
                hit = piece >= 0
                if hit.any():
                    found[n] = at[hit], piece[hit]
        return found

    def score_words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probabilities (words x languages) of raw[start:end]; words lie one after the other, without gaps."""
        if len(start) == 1 and len(raw) > 2 * SCORED:
            return self._in_blocks(raw)[None]
        found = self.hits(raw, np.repeat(end, end - start))
        if (end - start).max(initial=0) <= STRETCH:
            return self._side_by_side(start, end - start, found, len(raw))
        cut = self._uncrossed(found, len(raw))
        cut[start] = True
        begin = np.flatnonzero(cut)
        out = self._stretches(begin, np.diff(np.append(begin, len(raw))), found, len(raw))
        return np.add.reduceat(out, np.searchsorted(begin, start))

    @staticmethod
    def _uncrossed(found: dict, places: int) -> np.ndarray:
        """Places inside no piece: all segmentations part there, so the sum over them is a product."""
        crossed = np.zeros(places + max(found, default=1) + 1, np.int64)
        for n, (at, _) in found.items():
            if n > 1:
                crossed[at + 1] += 1
                crossed[at + n] -= 1
        return np.cumsum(crossed)[:places] == 0

    def _stretches(self, begin: np.ndarray, size: np.ndarray, found: dict, places: int) -> np.ndarray:
        """Log probabilities of stretches that no piece leaves."""
        out = np.zeros((len(begin), self.langs))
        short = size <= STRETCH
        out[short] = self._side_by_side(begin[short], size[short], found, places)
        for i in np.flatnonzero(~short).tolist():
            run = _Run(self, int(begin[i]))
            run.feed(found, int(begin[i]), int(begin[i] + size[i]))
            out[i] = run.close(int(begin[i] + size[i]))
        return out

    def _in_blocks(self, raw: np.ndarray) -> np.ndarray:
        """The same for one very long word, SCORED bytes at a time; what is open at the end of a block goes on in the next."""
        total, run, over = np.zeros(self.langs), _Run(self, 0), 0
        for b in range(0, len(raw), SCORED):
            e = min(len(raw), b + SCORED)
            part = raw[b : min(len(raw), e + self.longest)]
            found = {n: (at[: (k := np.searchsorted(at, e - b))], p[:k]) for n, (at, p) in self.hits(part, np.full(len(part), len(part))).items()}
            cuts = np.flatnonzero(self._uncrossed(found, e - b))
            cuts = cuts[cuts + b >= over]
            over = max([over, *(int(at[-1]) + n + b for n, (at, _) in found.items() if len(at))])
            if len(cuts):
                first, last = int(cuts[0]), int(cuts[-1])
                run.feed(found, 0, first, b)
                total += run.close(b + first)
                if last > first:
                    total += self._stretches(cuts[:-1], np.diff(cuts), found, len(part)).sum(0)
                run = _Run(self, b + last)
                run.feed(found, last, e - b, b)
            else:
                run.feed(found, 0, e - b, b)
        return total + run.close(len(raw))

    def _side_by_side(self, begin: np.ndarray, size: np.ndarray, found: dict, places: int) -> np.ndarray:
        """Sums over the segmentations of stretches: what is at a place is handed on by each piece that begins there."""
        row = np.full(places, -1, np.int64)
        row[np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.repeat(np.arange(len(begin)), size)
        top = int(size.max(initial=0))
        alpha = np.zeros((top + 1, len(begin), self.langs))
        alpha[0] = 1.0
        steps: list[list] = [[] for _ in range(top)]
        for n, (at, piece) in found.items():
            mine = row[at]
            at, piece, mine = at[mine >= 0], piece[mine >= 0], mine[mine >= 0]
            j = at - begin[mine]
            order = np.argsort(j, kind="stable")
            cuts = np.flatnonzero(np.diff(j[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                steps[int(j[part[0]])].append((n, mine[part], piece[part]))
        for j, step in enumerate(steps):
            for n, mine, piece in step:
                alpha[j + n, mine] += alpha[j, mine] * self.scaled[piece]
        return np.log(np.maximum(alpha[size, np.arange(len(begin))], 1e-300)) - np.log(self.SCALE) * size[:, None]

    def documents(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities (documents x languages) and scored words of each document."""
        raw = fold(raw)
        start, end, doc = word_spans(raw, off)
        distinct, first, back = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
        row = self.index.find(distinct)
        if (new := row < 0).any():
            if len(self.index) + int(new.sum()) > self.KEPT:
                self._forget()
                new = np.ones(len(distinct), bool)
            # each word is preceded by one space, as pieces of running text are
            s, e = start[first[new]], end[first[new]]
            size = e - s + 1
            begin = np.cumsum(size) - size
            spaced = np.full(int(size.sum()), 32, np.uint8)
            inner = np.ones(len(spaced), bool)
            inner[begin] = False
            spaced[inner] = raw[np.repeat(s - begin, size - 1) + np.flatnonzero(inner) - 1]
            row[new] = np.arange(len(s)) + self.scores.n
            for i, j in slices(np.append(begin, len(spaced)), SCORED):
                self.scores.append(self.score_words(spaced[begin[i] : begin[j - 1] + size[j - 1]], begin[i:j] - begin[i], begin[i:j] + size[i:j] - begin[i]))
            self.index.add(distinct[new], row[new])
        n = len(off) - 1
        scores = self.scores.rows[row[back]]
        return np.stack([np.bincount(doc, scores[:, k], minlength=n) for k in range(self.langs)], 1), np.bincount(doc, minlength=n)


def span_hashes_at(raw: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """span_hashes of n bytes at each start, cheaper at scattered places."""
    power, _ = _powers(_BASES[0][0], n + 1)
    h = np.zeros(len(start), np.uint64)
    for i in range(n):
        h += _BYTES[0][raw[start + i]] * power[i]
    return mix(h + np.uint64(n * 0xD6E8FEB86659FD93 % 2**64))


def fit(docs: DataFrame, labelled, path: str, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and log piece probabilities (pieces x languages).

    Piece counts come from the vocabulary's own segmentation of a sample of about train_docs whole texts of
    each language, drawn by a hash of doc_id under a rate from the counts of all labels. What reaches the driver
    is one row per language and piece; more than LANGUAGES distinct labels are refused, as they are no languages.
    """
    usable = docs.where(labelled).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    totals = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(totals) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    langs = sorted(totals)
    found = pieces(path)
    if not langs:
        return langs, np.zeros((len(found), 0))
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, train_docs / totals[k])))])
    drawn = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_003)) < F.element_at(rate, F.col("lang")) * 1_000_003)

    def count(batches):
        from collections import Counter

        from tokenizers import Tokenizer

        tokenizer, table = Tokenizer.from_file(path), _byte_of()
        number = {p: i for i, p in enumerate(pieces(path))}
        of: dict[int, list[int]] = {}

        def pieces_of(token: int) -> list[int]:
            if token not in of:
                text = tokenizer.id_to_token(token)
                raw = fold(np.frombuffer(bytes(table[c] for c in text), np.uint8)).tobytes() if all(c in table for c in text) else b""
                of[token] = [number[raw]] if raw else []
            return of[token]

        total: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                low = " " + " ".join(fold(np.frombuffer(text.encode(), np.uint8)).tobytes().decode("utf-8", "replace").split())
                total.setdefault(lang, Counter()).update(tokenizer.encode(low, add_special_tokens=False).ids)
        for lang, counts in total.items():
            sums: Counter = Counter()
            for token, n in counts.items():
                for p in pieces_of(token):
                    sums[p] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], ["lang", "piece", "n"])

    rows = drawn.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(found), len(langs)), SMOOTHING)
    np.add.at(counts, (rows["piece"].to_numpy(np.int64), rows["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(np.int64)), rows["n"].to_numpy(float))
    return langs, np.log(counts / counts.sum(0))


_LOADED: dict = {}
HELD.append(_LOADED.clear)


def _judge(docs: DataFrame, labelled, path: str | None, train_docs: int):
    """A function of Arrow arrays (text, whether it has a letter) that gives lang_pred, score and margin."""
    tune(docs.sparkSession)
    path = path or vocabulary_path()
    langs, logp = fit(docs, labelled, path, train_docs)
    held = docs.sparkSession.sparkContext.broadcast((langs, logp.astype(np.float32)))  # languages x pieces

    def judge(texts, letter) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs, logp = held.value
        key = hash(logp.tobytes())
        if langs and key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Forward(path, logp.astype(float))
        model = _LOADED.get(key)
        raw, off = text_buffer(texts)
        total, words = np.zeros((len(texts), max(1, len(langs)))), np.zeros(len(texts), np.int64)
        if langs:
            for i, j in slices(off, 4 << 20):
                total[i:j], words[i:j] = model.documents(raw[off[i] : off[j]], off[i : j + 1] - off[i])
        mean = total / np.maximum(words, 1)[:, None]
        odds = np.exp(mean - mean.max(1, keepdims=True))
        letters = letter.to_numpy(zero_copy_only=False).astype(bool) & bool(langs)
        score, least = np.where(letters, 1 / odds.sum(1), 0.0), 1 / max(1, len(langs))
        margin = np.where(letters, (score - least) / (1 - least) if least < 1 else 1.0, 0.0)
        return [langs[k] if ok else UNKNOWN for k, ok in zip(mean.argmax(1), letters, strict=True)], score, margin

    return judge


#: Whether a text has a letter.
_LETTER = r"\p{L}"


def predict_languages(docs: DataFrame, labelled, path: str | None = None, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id") -> DataFrame:
    """doc_id (what id_col holds), lang_pred, score and margin, one row per row of docs.

    Learns from text and lang of the rows where the condition labelled holds; predictions use the whole text
    alone. score is the posterior under equal priors of the text's mean log probability per word, so it tells
    clear texts from mixed ones at any length; margin is what it has above chance, 0 to 1 whatever the number of
    languages. A text that is null or holds no letter is `und` with score 0,
    as is every text when no language is known. Ties go to the first language in order. Rows repeated with
    the same id get a row each; other columns are not read.
    """
    judge = _judge(docs, labelled, path, train_docs)

    def predict(batches):
        for b in batches:
            lang, score, margin = judge(b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(margin)], ["doc_id", "lang_pred", "score", "margin"])

    letter = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text").alias("_fx_text"), letter.alias("_fx_letter")).mapInArrow(predict, "doc_id long, lang_pred string, score double, margin double")


@own_names
def keep_clear(docs: DataFrame, labelled, least: float, path: str | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs whose language is known with at least this margin (see predict_languages), every column kept.

    Rows are judged one by one as they pass, so nothing is joined or shuffled.
    """
    judge = _judge(docs, labelled, path, train_docs)

    def keep(batches):
        for b in batches:
            lang, _, margin = judge(b.column(b.num_columns - 2), b.column(b.num_columns - 1))
            good = pa.array((margin >= least) & np.array([x != UNKNOWN for x in lang], bool))
            yield pa.RecordBatch.from_arrays(b.columns[:-2], b.schema.names[:-2]).filter(good)

    letter = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    return docs.select("*", F.col("text").alias("_fx_text"), letter.alias("_fx_letter")).mapInArrow(keep, docs.schema)


def held_out(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
