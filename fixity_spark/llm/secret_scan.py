"""Secrets in texts and in what is encoded inside them."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import io
import itertools
import re
import zlib
from array import array
from bisect import bisect_right
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.llm.common import tune
from fixity_spark.llm.words import text_buffer

KINDS = ("assign", "access", "hex")
#: Bytes of a compressed layer that are held at once; a larger one is scanned in windows that overlap by OVERLAP.
LAYER_BYTES, OVERLAP = 64 << 20, 1 << 20

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: An escaped escape sign before more digits is another layer of the same escape; all are taken at once.
_ESCAPE = re.compile(r"%(?:25)*[0-9A-Fa-f]{2}|\\(?:u005[cC]|x5[cC])*(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2})|&(?:#38;|#[xX]26;|amp;)*(?:#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})|[A-Za-z][A-Za-z0-9]{1,31});")
_NAMED = re.compile(r"(?<=[&;])[A-Za-z][A-Za-z0-9]*;\Z")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_HEXED = re.compile(r"[0-9a-fA-F]{24,}")
#: The same wrapped over lines; only the last line may be short.
_BASE64_LINES = re.compile(r"[A-Za-z0-9+/_-]{20,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]{20,}+)*+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)?={0,2}")
_HEXED_LINES = re.compile(r"[0-9a-fA-F]{24,}+(?:\r?\n[\x20\t]*+[0-9a-fA-F]{24,}+)*+(?:\r?\n[\x20\t]*+[0-9a-fA-F]++)?")
_URL_SAFE = str.maketrans("-_", "+/")
#: Where compressed bytes may begin, and stretches of text long enough to hold a secret (16 characters).
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]", re.DOTALL)
_PLAIN = rb"[\t\r\n\x20-\x7e]"
_STRETCHES = (
    (re.compile(rb"(?:" + _PLAIN + rb"|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){16,}+"), "utf-8"),
    (re.compile(rb"(?:" + _PLAIN + rb"\x00){16,}+"), "utf-16-le"),
    (re.compile(rb"(?:\x00" + _PLAIN + rb"){16,}+"), "utf-16-be"),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, by start, then kind in the order of KINDS."""
    out = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Places:
    """Where each character of a decoded text stands in the text that encodes it: stretches in which every character
    takes the same number of characters, so plain text and runs of like escapes cost one entry each."""

    def __init__(self):
        self.out, self.first, self.step, self.width = (array("q") for _ in range(4))

    def add(self, out: int, first: int, step: int, width: int) -> None:
        """From character out on, characters are width long, step apart, and the first one is at first."""
        if self.out and self.step[-1] == step and self.width[-1] == width and self.first[-1] + step * (out - self.out[-1]) == first:
            return
        self.out.append(out)
        self.first.append(first)
        self.step.append(step)
        self.width.append(width)

    def begin(self, k: int) -> int:
        i = bisect_right(self.out, k) - 1
        return self.first[i] + self.step[i] * (k - self.out[i])

    def end(self, k: int) -> int:
        return self.begin(k) + self.width[bisect_right(self.out, k) - 1]


def _unescape(text: str) -> tuple[str, Places]:
    """The text with URL, HTML and Unicode escapes resolved, and where each of its characters came from."""
    out, places = io.StringIO(), Places()
    size, at, pending, since = 0, 0, bytearray(), 0

    def put(got: str, first: int, step: int, width: int) -> None:
        nonlocal size
        if got:
            places.add(size, first, step, width)
            out.write(got)
            size += len(got)

    def flush(upto: int) -> None:
        if pending:
            got = pending.decode("utf-8", "replace")
            put(got, since, upto - since if len(got) == 1 else 0, upto - since)
            pending.clear()

    for m in _ESCAPE.finditer(text):
        s, code = m[0], None
        if s[0] == "&" and (named := _NAMED.search(s)):
            code = html5.get(named[0])
            if code is None:
                continue  # no entity: text
        if m.start() > at:
            flush(at)
            put(text[at : m.start()], at, 1, 1)
        if s[0] == "%":  # bytes of one character may be spread over several escapes
            if pending and pending[-1] < 0x80:
                flush(m.start())
            since = since if pending else m.start()
            pending.append(int(s[-2:], 16))
        else:
            flush(m.start())
            if code is None:
                digits = (s[-2:] if s[-3] == "x" else s[-4:]) if s[0] == "\\" else s[s.rindex("#") + 1 : -1]
                number = int(digits.lstrip("xX"), 16) if s[0] == "\\" or digits[0] in "xX" else int(digits)
                code = chr(number) if number < 0xD800 or 0xDFFF < number < 0x110000 else "�"
            put(code, m.start(), len(s) if len(code) == 1 else 0, len(s))
        at = m.end()
    flush(at)
    put(text[at:], at, 1, 1)
    return out.getvalue(), places


def _unpacked(raw: bytes):
    """What compressed bytes unpack to, as far as they do, piece by piece."""
    try:
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw))
            while got := reader.read(1 << 20):
                yield got
        elif raw[:3] == b"BZh":
            while raw[:3] == b"BZh":
                unpack, rest = bz2.BZ2Decompressor(), raw
                while not unpack.eof and ((got := unpack.decompress(rest, 1 << 20)) or not unpack.needs_input):
                    rest = b""
                    yield got
                raw = unpack.unused_data
        else:
            first = raw[:2]
            while raw[:2] == first:  # files may follow each other
                unpack = zlib.decompressobj(31 if first == b"\x1f\x8b" else 15)
                while not unpack.eof and (got := unpack.decompress(raw, 1 << 20)):
                    raw = unpack.unconsumed_tail
                    yield got
                raw = unpack.unused_data
    except Exception:  # not, or no longer, what its first bytes say
        return


def _windows(raw: bytes):
    """Unpacked bytes in windows of at most LAYER_BYTES, each with the end of the one before."""
    window, fresh = bytearray(), False
    for piece in _unpacked(raw):
        if fresh and len(window) + len(piece) > LAYER_BYTES:
            yield bytes(window)
            del window[: max(0, len(window) - OVERLAP)]
        window += piece
        fresh = True
    if fresh:
        yield bytes(window)


def _pieces(raw: bytes):
    """(text, first byte, end) of what is text in the bytes, and (bytes, first byte, end) of what they unpack to."""
    try:
        text = raw.decode("utf-8")
        if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.97 * len(text):
            yield text, 0, len(raw)
            return
    except UnicodeDecodeError:
        pass
    for m in _PACKED.finditer(raw):
        for window in _windows(raw[m.start() :]):
            yield window, m.start(), len(raw)
    for pattern, coding in _STRETCHES:
        for m in pattern.finditer(raw):
            yield m[0].decode(coding, "replace"), m.start(), m.end()


def _readable(raw: bytes):
    """(text, first byte, end) of what is text in the bytes, in what they unpack to, and so on to any depth."""
    seen: set[bytes] = set()
    work = [(_pieces(raw), None)]
    while work:
        pieces, outer = work[-1]
        if (piece := next(pieces, None)) is None:
            work.pop()
            continue
        got, a, b = piece
        at = outer or (a, b)
        if isinstance(got, str):
            yield got, *at
        elif (mark := hashlib.sha1(got).digest()) not in seen:  # some unpack to themselves
            seen.add(mark)
            work.append((_pieces(got), at))


def _layers(text: str, inner: bool = False):
    """Layers found in a text: (decoded text, places of its characters, or where the run is that encodes it).

    A run is decoded at each place where its code may begin, as a payload may stand behind other characters of
    the alphabet; what is text in the result is a layer.
    """
    escaped = _ESCAPE.search(text)
    if escaped:
        yield _unescape(text)
    if "+" in text and (inner or escaped):  # forms write a blank as +
        yield _unescape(text.replace("+", " "))
    for pattern, lines, chars, size in ((_BASE64, _BASE64_LINES, 4, 3), (_HEXED, _HEXED_LINES, 2, 1)):
        wrapped = (m for m in lines.finditer(text) if "\n" in m[0]) if "\n" in text else ()
        for m in itertools.chain(pattern.finditer(text), wrapped):
            place, at = Places(), 0
            for line in re.finditer(r"\S+", m[0]):
                place.add(at, m.start() + line.start(), 1, 1)
                at += len(line[0])
            body = "".join(m[0].split()).rstrip("=").translate(_URL_SAFE)
            for k in range(chars):
                part = body[k:]
                try:
                    raw = bytes.fromhex(part[: len(part) // 2 * 2]) if chars == 2 else base64.b64decode(part[: len(part) - (len(part) % 4 == 1)] + "=" * (-len(part) % 4 % 3))
                except (ValueError, binascii.Error):
                    continue
                whole = False
                for got, a, b in _readable(raw):
                    whole = k == 0 and (a, b) == (0, len(raw))
                    last = at - 1 if b == len(raw) else k + -(-b // size) * chars - 1
                    yield got, (place.begin(k + a // size * chars), place.end(last))
                if whole:
                    break


def _place(trail, start: int, end: int) -> tuple[int, int]:
    """Where a span of a layer stands in the text: trail is (places of its characters or of the whole layer, trail of the
    layer around it)."""
    while trail:
        at, trail = trail
        start, end = (at.begin(start), at.end(end - 1)) if isinstance(at, Places) else at
    return start, end


def decoded_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, decoded_<kind>) of secrets inside encoded layers, at the place that encodes them.

    A worklist of layers: each is scanned, then searched for layers of its own. A layer seen before is not
    taken up again, so self-reproducing encodings end. A span inside an unescaped layer maps to the escapes
    of its characters; one inside a packed layer maps to the stretch of the run that encodes the layer. What a
    base pattern of the same kind finds at the same place is left out.
    """
    plain = set(base_spans(text))
    seen, found = set(), set()
    work = [(_layers(text), None)]
    while work:
        layers, outer = work[-1]
        if (layer := next(layers, None)) is None:
            work.pop()
            continue
        inner, at = layer
        trail = (at, outer)
        if not inner or (mark := (hashlib.sha1(inner.encode()).digest(), _place(trail, 0, len(inner)))) in seen:
            continue
        seen.add(mark)
        for s, e, kind in base_spans(inner):
            if (at := _place(trail, s, e)) + (kind,) not in plain:
                found.add((*at, f"decoded_{kind}"))
        work.append((_layers(inner, True), trail))
    return sorted(found)


def _worth_decoding(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each document whether it has an escape character or a run long enough to encode a layer."""
    worth = np.zeros(len(off) - 1, bool)
    doc_of = lambda at: np.searchsorted(off, at, side="right") - 1
    worth[doc_of(np.flatnonzero((raw == 37) | (raw == 92) | (raw == 38)))] = True
    inside = np.concatenate([[False], _RUN[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    long = end - start >= 20
    first, last = doc_of(start[long]), doc_of(end[long] - 1)
    worth[first] = worth[last] = True
    for i, j in zip(first[last > first], last[last > first], strict=True):  # documents whose texts run on
        worth[i : j + 1] = True
    return worth


_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The counts and base_sha256 cover the base patterns in the text itself. spans also lists secrets in nested
    URL, HTML, Unicode, base64, hexadecimal and compressed layers, under kinds decoded_assign, decoded_access
    and decoded_hex, at the stretch of the text that encodes them. Offsets are code points, ends exclusive. A
    null text counts as empty; rows repeated with the same id get a row each; other columns are not read.
    """
    tune(docs.sparkSession)
    order = {k: i for i, k in enumerate([*KINDS, *(f"decoded_{k}" for k in KINDS)])}
    show = lambda spans: ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)

    def scan(batches):
        for b in batches:
            raw, off = text_buffer(b.column(1))
            base = [base_spans(t or "") for t in b.column(1).to_pylist()]
            spans = list(base)
            for i in np.flatnonzero(_worth_decoding(raw, off)):
                if more := decoded_spans(b.column(1)[int(i)].as_py() or ""):
                    spans[i] = sorted(base[i] + more, key=lambda s: (s[0], order[s[2]]))
            counts = [pa.array([sum(s[2] == kind for s in a) for a in base], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([hashlib.sha256(show(a).encode()).hexdigest() for a in base]), pa.array([show(s) for s in spans])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)
