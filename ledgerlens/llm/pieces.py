"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The model file is read directly (its protocol-buffer fields are few). A text is
normalised as the file says (identity: an optional dummy prefix, spaces become
U+2581), and encoded by the score-ordered agenda of adjacent symbol pairs: of all
pairs whose concatenation is a piece, the one with the highest score, leftmost on
ties, is merged until none is left; what is no piece then falls back to bytes.

No piece has other characters before U+2581 and no multi-character piece holds a
line feed, which is checked on loading; merges therefore never cross such places
and a text is cut there. Rows are taken in slices of about SLICE characters, long
texts over several slices. Distinct cuts of a slice run their agendas
in lockstep in numpy, one pop each a step; very long cuts have a heap. Results of
recent short cuts are kept in a bounded table; dropping it costs time, not results.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Cuts of more symbols than this have a heap of their own.
LOCKSTEP = 48
#: Cuts, and bytes as estimated, of the results kept between slices in each of two generations, and characters of a slice.
KEPT_CUTS, KEPT_BYTES, SLICE = 300_000, 64 << 20, 1 << 19
_NONE = np.int64(1 << 40)
_UNSEEN = 1 << 22


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = buf[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    while i < len(buf):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = buf[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = buf[i : i + n], i + n
        yield tag >> 3, value


class PieceModel:
    """A merge-type vocabulary: ``encode``, ``decode`` and ``encode_cuts``."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.types: list[int] = []
        scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(data):
            if field == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.types.append(d.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type vocabulary")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalisation that keeps white space is supported")
        if USER_DEFINED in self.types or UNUSED in self.types:
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.unk = self.types.index(UNKNOWN)
        self.eos = self.pieces.index(trainer.get(47, b"</s>").decode())
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        own = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in own):
            raise ValueError("pieces cross the places where texts are cut")
        self.ids = own
        #: Symbols are piece ids; single characters that are no piece get ids from here on.
        self.symbols = dict(own)
        for p in own:
            for c in p:
                self.symbols.setdefault(c, len(self.pieces) + len(self.symbols))
        self.surface = {i: p for p, i in self.symbols.items()}
        self._of_code = np.full(0x110000, -1, dtype=np.int64)
        for p, i in self.symbols.items():
            if len(p) == 1:
                self._of_code[ord(p)] = i
        self._digits = [str(i) for i in range(len(self.pieces))]
        self._shown = ["" if t == CONTROL else self.unk_surface if t == UNKNOWN else p.replace(SPACE, " ") for p, t in zip(self.pieces, self.types)]
        self._is_byte = frozenset(self.byte_of)
        # Agenda order: a smaller rank is a higher score; equal scores share a rank.
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in own.values()}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in own.items():
            for k in range(1, len(p)):
                left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = (order[scores[i]], i)
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self._size_bits = max(12, int(len(keys) * 4).bit_length())
        self._fill(keys, np.array([pairs[k][0] << 20 | pairs[k][1] for k in keys.tolist()], dtype=np.int64))
        self._cuts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self._with_ids = False
        self._edge = re.compile(f"(?<!{SPACE}){SPACE}|\n")
        self.forget()

    # -- open-addressing table of pairs, for whole arrays of keys ------------
    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._size_bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        n = 1 << self._size_bits
        table, found = [-1] * (n + 64), [0] * (n + 64)
        self._probes = 1
        for k, v, s in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist()):
            probes = 1
            while table[s] != -1:
                s, probes = s + 1, probes + 1
            table[s], found[s] = k, v
            self._probes = max(self._probes, probes)
        self._table, self._found = np.array(table, dtype=np.int64), np.array(found, dtype=np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each adjacent pair, _NONE where it is no piece."""
        keys = left << 20 | right
        keys[(left >= _UNSEEN) | (right >= _UNSEEN)] = -2
        slot = self._slot(keys)
        out = np.full(keys.shape, _NONE)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for p in range(self._probes):
            at = slot[open_] + p
            there = self._table[at]
            hit = there == keys[open_]
            out[open_[hit]] = self._found[at[hit]]
            open_ = open_[~hit & (there != -1)]
            if not len(open_):
                break
        return out

    # -- encoding ------------------------------------------------------------
    def normalized(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def cuts(self, text: str) -> list[str]:
        return self._cuts.findall(self.normalized(text))

    def segments(self, text: str, least: int) -> Iterator[list[str]]:
        """The cuts of a text in parts of ``least`` characters or more."""
        text, at = self.normalized(text), 0
        while len(text) - at > least and (edge := self._edge.search(text, at + least)):
            yield self._cuts.findall(text, at, edge.start())
            at = edge.start()
        yield self._cuts.findall(text, at)

    def _symbols_of(self, text: str) -> np.ndarray:
        """Symbol ids of single characters; one that is in no piece never merges and is its code point above _UNSEEN."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        return np.where(self._of_code[codes] >= 0, self._of_code[codes], codes + _UNSEEN)

    def agenda(self, cut: str) -> list[str]:
        """The pieces of one cut, by a heap of (rank, left position)."""
        sym = list(cut)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get, ids = self.pairs.get, self.symbols.get
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n:
                a, b = ids(sym[i]), ids(sym[j])
                if a is not None and b is not None and (hit := get(a << 20 | b)):
                    heapq.heappush(heap, (hit[0], i, len(sym[i]), len(sym[j])))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] else n
            if j >= n or len(sym[i]) != a or len(sym[j]) != b:
                continue
            sym[i] += sym[j]
            sym[j] = ""
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        return [s for s in sym if s]

    def _lockstep(self, cuts: list[str]) -> list[list[int]]:
        """Ids of short cuts of one padded width."""
        width = max(map(len, cuts))
        sym = np.full((len(cuts), width), -1, dtype=np.int64)
        lengths = np.array([len(c) for c in cuts])
        sym[np.arange(width)[None, :] < lengths[:, None]] = self._symbols_of("".join(cuts))
        done: list = [None] * len(cuts)
        rows = np.arange(len(cuts))
        rank = self._ranked(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(cuts), width - 1)
        while len(rows):
            best = (rank >> 20).argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            at = np.arange(len(rows))
            top = rank[at, best] if rank.shape[1] else np.full(len(rows), _NONE)
            live = top != _NONE
            if not live.all():
                ended = sym[~live]
                plain = (ended < len(self.pieces)).all(axis=1)
                for r, s, n, ok in zip(rows[~live].tolist(), ended.tolist(), (ended >= 0).sum(axis=1).tolist(), plain.tolist()):
                    done[r] = s[:n] if ok else [i for x in s[:n] for i in ([x] if x < len(self.pieces) else self._ids_of(chr(x - _UNSEEN) if x >= _UNSEEN else self.surface[x]))]
                rows, sym, rank, best, top = rows[live], sym[live], rank[live], best[live], top[live]
                if not len(rows):
                    break
                at = np.arange(len(rows))
            w = sym.shape[1]
            sym[at, best] = top & 0xFFFFF
            keep = np.ones(sym.shape, bool)
            keep[at, best + 1] = False
            sym = sym[keep].reshape(len(rows), w - 1)
            keep = np.ones(rank.shape, bool)
            keep[at, best] = False
            rank = rank[keep].reshape(len(rows), w - 2)
            if w > 2:
                right = np.flatnonzero(best < w - 2)
                rank[right, best[right]] = self._ranked(sym[right, best[right]], sym[right, best[right] + 1])
                left = np.flatnonzero(best > 0)
                rank[left, best[left] - 1] = self._ranked(sym[left, best[left] - 1], sym[left, best[left]])
        return done

    def _ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        if not self.byte_ids:
            return [self.unk]
        return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]

    def encode_cuts(self, cuts: list[str]) -> list[list[int]]:
        """Ids of each of many distinct cuts."""
        out: list = [None] * len(cuts)
        by_width: dict[int, list[int]] = {}
        for k, c in enumerate(cuts):
            if len(c) > LOCKSTEP:
                out[k] = [i for p in self.agenda(c) for i in self._ids_of(p)]
            else:
                by_width.setdefault(min(-(-len(c) // 4) * 4, LOCKSTEP), []).append(k)
        for where in by_width.values():
            for k, ids in zip(where, self._lockstep([cuts[k] for k in where])):
                out[k] = ids
        return out

    def encode(self, text: str) -> list[int]:
        cuts = self.cuts(text)
        ids = dict(zip(known := list(dict.fromkeys(cuts)), self.encode_cuts(known)))
        return [i for c in cuts for i in ids[c]] + [self.eos]

    # -- decoding ------------------------------------------------------------
    def surface_of(self, ids: list[int]) -> str:
        """The text of ids, before the dummy prefix is taken off; bad bytes become U+FFFD one by one, control ids nothing."""
        if self._is_byte.isdisjoint(ids):
            return "".join([self._shown[i] for i in ids])
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            out.append(self._shown[i])
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.surface_of(ids)
        first = next((i for i in ids if self.types[i] != CONTROL), None)
        starts = first is not None and self.types[first] == NORMAL and self.pieces[first].startswith(SPACE)
        return text[1:] if self.dummy_prefix and starts else text

    # -- whole slices of rows ------------------------------------------------
    def forget(self) -> None:
        """Lets go of the kept cuts."""
        self._young: dict[str, tuple] = {}
        self._old: dict[str, tuple] = {}
        self._bytes = 0
        self._passing: list[str] = []

    def known(self, cuts: list[str], with_ids: bool) -> dict[str, tuple]:
        """For each cut: its ids as text, what they decode to, and (if asked for) its ids as little-endian int32.

        Two generations of at most KEPT_CUTS and KEPT_BYTES each: what is used moves to the young one, the old one is dropped when that is full.
        Cuts of more than LOCKSTEP symbols are in the table until the next call only.
        """
        if with_ids != self._with_ids:
            self.forget()
            self._with_ids = with_ids
        for c in self._passing:
            del self._young[c]
        wanted = set(cuts)
        self._passing = [c for c in wanted if len(c) > LOCKSTEP]
        new = list(wanted.difference(self._young))
        if self._bytes > KEPT_BYTES or len(self._young) + len(new) > KEPT_CUTS:
            self._old, self._young, self._bytes = self._young, {}, 0
            new = list(wanted)
        young, old = self._young, self._old
        seen = [c for c in new if c in old]
        young.update((c, old[c]) for c in seen)
        if seen:
            new = [c for c in new if c not in young]
        # Strings and dictionary slots of an entry, and some twelve bytes a symbol.
        self._bytes += sum(300 + 12 * len(c) for c in (*new, *seen) if len(c) <= LOCKSTEP)
        digits, shown, is_byte = self._digits, self._shown, self._is_byte
        for c, ids in zip(new, self.encode_cuts(new)):
            young[c] = (
                " ".join([digits[i] for i in ids]),
                "".join([shown[i] for i in ids]) if is_byte.isdisjoint(ids) else self.surface_of(ids),
                struct.pack(f"<{len(ids)}i", *ids) if with_ids else None,
            )
        return young


def _utf8(raw: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that starts no whole character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, with_ids: bool = True) -> DataFrame:
    """One row per row: ``doc_id, n_tokens, ids`` (if asked for)``, ids_sha256, decoded_sha256``.

    ids are those of the whole text and the end id; decoded_sha256 is of the text
    that they decode to. A null or empty text has the end id alone; a null doc_id stays
    null; equal rows give equal rows; an empty table gives none. Only doc_id and text are
    read, so further columns of any name do no harm. ``model`` is the file's bytes (half
    a MB for 32,000 pieces), sent with the function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        collecting = gc.isenabled()
        gc.disable()  # strings and tuples only, none in cycles; the collector would walk the kept cuts again and again
        try:
            for whole in batches:
                row = _Row(m, with_ids)
                for part in _slices(m, whole.column(1)):
                    table = m.known([c for _, cuts, _ in part for c in cuts], with_ids)
                    done = []
                    for k, cuts, ends in part:
                        row.add([table[c] for c in cuts])
                        if ends:
                            done.append((k, *row.end()))
                            row = _Row(m, with_ids)
                    if done:
                        yield _encoded(whole.column(0), done, with_ids)
        finally:  # the worker goes on to other tasks
            m.forget()
            whole = part = cuts = table = row = done = None  # noqa: F841  (what they hold is freed before memory is given back)
            if collecting:
                gc.enable()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(columns, run, f"doc_id long, n_tokens long, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string")


def _slices(m: PieceModel, texts: pa.Array) -> Iterator[list[tuple[int, list[str], bool]]]:
    """Parts of about SLICE characters: the row, cuts of its text, and whether these are its last."""
    part, size = [], 0
    for k, t in enumerate(texts):
        text = t.as_py() or ""
        segments = m.segments(text, SLICE)
        cuts = next(segments)
        while cuts is not None:
            after = next(segments, None)
            part.append((k, cuts, after is None))
            size += min(len(text), SLICE) + 64
            if size >= SLICE:
                yield part
                part, size = [], 0
            cuts = after
    if part:
        yield part


class _Row:
    """The digests of one text, part by part."""

    def __init__(self, m: PieceModel, with_ids: bool) -> None:
        self.m, self.with_ids, self.n = m, with_ids, 0
        self.ids, self.decoded, self.raw = hashlib.sha256(), hashlib.sha256(), []

    def add(self, found: list[tuple]) -> None:
        if not found:
            return
        joined = " ".join([x[0] for x in found]) + " "
        decoded = "".join([x[1] for x in found])
        if self.n == 0 and self.m.dummy_prefix:
            decoded = decoded[1:]
        self.n += joined.count(" ")
        self.ids.update(joined.encode())
        self.decoded.update(decoded.encode("utf-8", "surrogatepass"))
        if self.with_ids:
            self.raw += [x[2] for x in found]

    def end(self) -> tuple[int, bytes | None, str, str]:
        self.ids.update(str(self.m.eos).encode())
        raw = b"".join([*self.raw, struct.pack("<i", self.m.eos)]) if self.with_ids else None
        return self.n + 1, raw, self.ids.hexdigest(), self.decoded.hexdigest()


def _encoded(doc_ids: pa.Array, rows: list[tuple[int, int, bytes | None, str, str]], with_ids: bool) -> pa.RecordBatch:
    at, counts, raw, ids_sha, text_sha = zip(*rows)
    columns, names = [doc_ids.take(pa.array(at, pa.int64())), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]
    if with_ids:
        offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4"), pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays([*columns, pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [*names, "ids_sha256", "decoded_sha256"])
