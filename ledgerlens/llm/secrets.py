"""Secret scans with a recursive decoding worklist.

Every text is scanned by the base patterns. What may be encoded is then unwrapped:
percent escapes, \\u, \\x and &#...; escapes in place, base64 runs (also those wrapped
over lines) as layers of their own, compressed data in these as streams. Each new
layer joins the worklist and is scanned and unwrapped in turn until none is new. A
layer is known by its content and the range of the whole text it stands for: each
copy of an encoded run is taken, and a layer that unwraps to itself ends there.

A layer maps a finding to a range of the layer it comes from, and so on up to the
whole text; no map of characters is stored. All that a compressed run unfolds to
stands for that run, so of a stream only the kinds of findings in it matter. It is
read in pieces of PIECE bytes, cut at line ends that no encoded block crosses, as long
as it is, and no further once all kinds were found.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map

KINDS = ("assign", "access", "hex")
#: Bytes that a stream yields at once; a stream of at most this many is held whole.
PIECE = 1 << 20
#: Characters of a stream without a place to cut after which it is cut anyway.
UNBROKEN = 16 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_IS_HEX = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_RUN = b"\1" * 24
_WORDS = (b"passw", b"secret", b"token", b"api")
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_OPENS = frozenset(b"%\\&")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_BREAK = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
_LINE = re.compile(r"[A-Za-z0-9+/_-]++={0,2}(?=[\x20\t]*(?:\r?\n|\Z))")
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff\ufffe\uffff]+")
_URL_SAFE = str.maketrans("-_", "+/")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base findings ``(kind, start, end)`` by start, then kind: per kind leftmost and non-overlapping, failing matches dropped."""
    raw = text.encode("utf-8", "surrogatepass")
    found = []
    low = raw.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in raw.translate(_IS_HEX):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


# -- layers ------------------------------------------------------------------
class _Layer:
    """A text; ``up`` maps a range of it to one of its parent. ``place``: the one range of the whole text that all of it stands for."""

    def __init__(self, text: str, parent: _Layer | None = None, up: Callable[[int, int], tuple[int, int]] | None = None, place: tuple[int, int] | None = None) -> None:
        self.text, self.parent, self.up, self.place = text, parent, up, place

    def span(self, a: int, b: int) -> tuple[int, int]:
        layer = self
        while layer.place is None and layer.parent is not None:
            a, b = layer.up(a, b)
            layer = layer.parent
        return layer.place or (a, b)

    def key(self) -> tuple:
        return (hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), *self.span(0, len(self.text)))

    def below(self) -> Iterator[_Layer | _Stream]:
        if (plain := _unescaped(self)) is not None:
            yield plain
        for pieces in _runs(self.text):
            yield from _decoded(self, pieces)


class _Stream:
    """Bytes that stand for one range of the whole text; more than PIECE of them are unfolded anew by each reader."""

    def __init__(self, pieces: Callable[[], Iterator[bytes]], place: tuple[int, int]) -> None:
        self.pieces, self.place = pieces, place
        digest, held, n = hashlib.sha256(), [], 0
        for p in pieces():
            digest.update(p)
            n += len(p)
            if n <= PIECE:
                held.append(p)
        self.digest = digest.digest()
        if n <= PIECE:
            whole = b"".join(held)
            self.pieces = lambda: iter((whole,) if whole else ())

    def key(self) -> tuple:
        return self.digest, "bytes", *self.place

    def below(self) -> Iterator[_Layer | _Stream]:
        if _packed(next(self.pieces(), b"")):
            inner = _Stream(lambda: _inflate(self.pieces()), self.place)
            if next(inner.pieces(), None) is not None:
                yield inner
                return
        for text in _texts(self.pieces()):
            yield _Layer(text, place=self.place)


def _byte_offsets(text: str) -> np.ndarray | None:
    """Where each character starts in UTF-8, and the end; None if that is the same number. Escaped bytes are one each."""
    if text.isascii():
        return None
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    widths = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    widths[(c >= 0xDC80) & (c < 0xDD00)] = 1
    return np.concatenate([[0], np.cumsum(widths)])


def _unescaped(layer: _Layer) -> _Layer | None:
    """Every escape undone; if that gives the start of a further escape, that one too. Bytes that are no UTF-8 stay apart."""
    text = layer.text
    if "%" not in text and "\\" not in text and "&#" not in text:
        return None
    out: list[str] = []
    new_at, starts, ends = array("q"), array("q"), array("q")  # each undone character, and the range it comes from
    at = pos = n = 0
    raw: list[tuple[int, int, int]] = []

    def emit(char: str, start: int, end: int) -> None:
        nonlocal at, n
        if start > at:
            out.append(text[at:start])
            n += start - at
        out.append(char)
        new_at.append(n)
        starts.append(start)
        ends.append(end)
        at, n = end, n + 1

    def flush() -> None:
        """The bytes of percent escapes without anything between them."""
        if not raw:
            return
        k = 0
        for c in bytes(v for v, _, _ in raw).decode("utf-8", "surrogateescape"):
            width = 1 if "\udc80" <= c < "\udd00" else len(c.encode("utf-8"))
            emit(c, raw[k][1], raw[k + width - 1][2])
            k += width
        raw.clear()

    while (m := _ESCAPE.search(text, pos)) is not None:
        start, end = m.start(), m.end()
        while True:
            code, is_byte = int(m[4]) if m[4] else int(m[1] or m[2] or m[3] or m[5], 16), m[1] is not None
            if code not in _OPENS or (more := _ESCAPE.match(chr(code) + text[end : end + 10])) is None:
                break
            m, end = more, end + more.end() - 1
        pos = end
        if raw and (not is_byte or raw[-1][2] != start):
            flush()
        if is_byte:
            raw.append((code, start, end))
        elif code < 0xD800 or 0xE000 <= code < 0x110000:
            emit(chr(code), start, end)
    flush()
    if not new_at:
        return None
    out.append(text[at:])

    def up(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(new_at, a) - 1, bisect_right(new_at, b - 1) - 1
        first = a if i < 0 else starts[i] if new_at[i] == a else ends[i] + a - new_at[i] - 1
        last = b if j < 0 else ends[j] if new_at[j] == b - 1 else ends[j] + b - new_at[j] - 1
        return first, last

    return _Layer("".join(out), layer, up)


def _runs(text: str) -> Iterator[list[tuple[int, int]]]:
    """Base64 runs as ranges of the text: each alone, and blocks of lines of one length with the shorter line after them."""
    done = 0
    for m in _BASE64.finditer(text):
        yield [m.span()]
        if m.start() < done or m[0].endswith("="):
            continue
        block, width, shorter = [m.span()], 0, False
        while not shorter and (gap := _BREAK.match(text, block[-1][1])) and (line := _LINE.match(text, gap.end())):
            n = len(line[0])
            if not width:
                width = n if m.start() and text[m.start() - 1] not in "\n\t " else len(m[0])
            if n > width:
                break
            shorter = n < width or line[0].endswith("=")
            block.append(line.span())
        if len(block) > 1:
            done = block[-1][1]
            yield block
            if shorter and len(block) > 2:  # the shorter line may be no part of it
                yield block[:-1]


def _decoded(layer: _Layer, pieces: list[tuple[int, int]]) -> Iterator[_Layer | _Stream]:
    run = "".join(layer.text[a:b] for a, b in pieces).rstrip("=")
    if len(run) % 4 == 1:
        return
    raw = base64.b64decode(run.translate(_URL_SAFE) + "=" * (-len(run) % 4))
    if _packed(raw):
        unfolded = _Stream(lambda: _inflate(iter((raw,))), layer.span(pieces[0][0], pieces[-1][1]))
        if next(unfolded.pieces(), None) is not None:
            yield unfolded
            return
    text = raw.decode("utf-8", "surrogateescape")
    if not _readable(text):
        return
    offsets = _byte_offsets(text)
    before = [0]
    for a, b in pieces:
        before.append(before[-1] + b - a)

    def place(k: int) -> int:
        """Where the run's character k stands."""
        p = bisect_right(before, k, 0, len(pieces)) - 1
        return pieces[p][0] + k - before[p]

    def up(a: int, b: int) -> tuple[int, int]:
        # Byte k lies in characters 4k/3 to 4k/3 + 1 of the run.
        i, j = (a, b) if offsets is None else (int(offsets[a]), int(offsets[b]))
        return place(i * 4 // 3), place(min((j - 1) * 4 // 3 + 1, len(run) - 1)) + 1

    yield _Layer(text, layer, up)


def _readable(text: str) -> bool:
    """At most one in ten characters is a control or no UTF-8."""
    return bool(text) and (text.isprintable() or sum(map(len, _ODD.findall(text))) * 10 <= len(text))


# -- compressed data ---------------------------------------------------------
def _packed(raw: bytes) -> bool:
    """Starts like gzip or zlib data."""
    return raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0)


def _inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """All members, one after another; broken data end there."""
    rest = b""
    while True:
        while len(rest) < 3 and (more := next(pieces, b"")):
            rest += more
        if not _packed(rest):
            return
        member = zlib.decompressobj(47)
        while not member.eof:
            try:
                out = member.decompress(rest, PIECE)
            except zlib.error:
                return
            rest = member.unconsumed_tail
            if out:
                yield out
            elif not rest and not member.eof and not (rest := next(pieces, b"")):
                return
        rest = member.unused_data


def _texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """The text of a stream in parts, cut after lines that aren't lines of a base64 block."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held: list[str] = []
    size = 0
    for text in chain(map(decoder.decode, pieces), (decoder.decode(b"", True),)):
        held.append(text)
        size += len(text)
        if "\n" not in text and size < UNBROKEN:
            continue
        whole = "".join(held)
        at = _cut(whole)
        if not at and size >= UNBROKEN:
            at = size // 4 * 4
        if at:
            yield whole[:at]
        held, size = [whole[at:]], size - at
    if size:
        yield "".join(held)


def _cut(text: str) -> int:
    """The last line end with a line before it that is not base64 alone."""
    end = text.rfind("\n")
    while end >= 0:
        start = text.rfind("\n", 0, end)
        line = text[start + 1 : end].strip()
        if not line or not _LINE.fullmatch(line):
            return end + 1
        end = start
    return 0


# -- the worklist ------------------------------------------------------------
def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base findings, and all findings with those of the layers, by start, kind, end."""
    base = scan(text)
    spans = set(base)
    top = _Layer(text)
    seen, work = {top.key()}, [(top.below(), None)]
    while work:
        below, place = work[-1]
        complete = place is not None and all((kind, *place) in spans for kind in KINDS)
        new = None if complete else next(below, None)
        if new is None:
            work.pop()
        elif (key := new.key()) not in seen:
            seen.add(key)
            work.append((new.below(), new.place))
            if isinstance(new, _Layer):
                spans.update((kind, *new.span(a, b)) for kind, a, b in scan(new.text))
    return base, sorted(spans, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row: ``doc_id, n_assign, n_access, n_hex`` (base findings), ``base_sha256, spans`` (base and unwrapped).

    A null text is an empty one; a null doc_id stays null; equal rows give equal rows; an
    empty table gives none. Offsets are code points, end exclusive. Only doc_id and text
    are read, so further columns of any name do no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], []]
            shas, spans = [], []
            for t in b.column(1):
                base, every = find(t.as_py() or "")
                for n, kind in zip(counts, KINDS):
                    n.append(sum(f[0] == kind for f in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str) -> str:
    """The text with each finding, overlapping ones together, replaced by ``[secret]``."""
    out, at = [], 0
    end = -1
    for _, a, b in find(text)[1]:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            at = end
        out += [text[at:a], "[secret]"]
        end = b
    return "".join([*out, text[max(end, 0) :]])
