"""Fill-in-the-middle transformation by bit-parallelism on big integers.

A text is its UTF-8 bytes. ``bytes.translate`` turns them into one binary digit a
byte for a class of bytes, and ``int(.., 2)`` makes the mask of that class, bit i for
byte i. Shifted boolean operations on class masks mark the bytes where units begin,
``bit_count`` counts them, and the byte where the unit of a given rank begins is found
by recursive halving: the low half's count says which half holds it. Each step works on
half as many bits as the last, so a text costs time and memory in proportion to its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map

SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100: texts from PLAIN_FROM on stay as they are; of the others those below SPM_BELOW have the suffix first.
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, "1"
UNITS = ("char", "word", "line")
#: Bytes of texts that one output batch holds, but for a single longer text.
BATCH_BYTES = 4 << 20


def _digits(members: bytes) -> bytes:
    """Translation table: digit 1 for the bytes of a class, 0 for all others."""
    return bytes(0x31 if b in members else 0x30 for b in range(256))


_LEAD = _digits(bytes(b for b in range(256) if not 0x80 <= b < 0xC0))
_WORD = _digits(bytes(b for b in range(256) if b not in b"\x20\t\n\v\f\r"))
_NEWLINE = _digits(b"\n")


def class_mask(data: bytes, table: bytes) -> int:
    """Bit i is set if byte i is of the table's class."""
    return int(data.translate(table)[::-1], 2) if data else 0


def unit_starts(data: bytes, unit: str) -> int:
    """Bit i is set if a unit begins at byte i.

    ``char``: a code point, at each byte that continues none. ``word``: a run of other than
    white space with the white space after it. ``line``: a line with its line feed.
    """
    if unit == "char":
        return class_mask(data, _LEAD)
    if unit == "word":
        word = class_mask(data, _WORD)
        return word & ~(word << 1)
    if unit != "line":
        raise ValueError(f"unit must be one of {UNITS}")
    return ((class_mask(data, _NEWLINE) << 1) | 1) & ((1 << len(data)) - 1)


def ranked_bit(mask: int, width: int, rank: int) -> int:
    """Position of the set bit that has ``rank`` set bits below it, of a mask of ``width`` bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            mask, width = low, half
        else:
            mask, width, rank, at = mask >> half, width - half, rank - below, at + half
    return at


def cut(data: bytes, unit: str, first: int, second: int) -> tuple[int, int, int]:
    """n, and the bytes where the units of ranks ``first % (n + 1)`` and ``second % (n + 1)`` begin, the smaller one first; rank n is the end.

    Bytes before the first unit belong to it: rank 0 begins at byte 0.
    """
    starts = unit_starts(data, unit)
    n = starts.bit_count()

    def byte_of(rank: int) -> int:
        return 0 if rank == 0 else len(data) if rank == n else ranked_bit(starts, len(data), rank)

    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, byte_of(low), byte_of(high)


def arrange(data: bytes, key: str, unit: str, marks: tuple[bytes, bytes, bytes], plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and of middle, and the output of one text."""
    h = hashlib.sha256(key.encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12))
    n, a, b = cut(data, unit, h1, h2)
    if not data or h3 % 100 >= plain_from or any(m in data for m in marks):
        return n, "plain", None, None, data
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = marks
    spm = h4 % 100 < spm_below
    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    chars = [class_mask(x, _LEAD).bit_count() for x in (prefix, middle)]
    return n, "spm" if spm else "psm", *chars, out


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Restoring takes the first occurrence of a sentinel for the sentinel, so none may begin with an end of one."""
    for i, x in enumerate(sentinels):
        for j, y in enumerate(sentinels):
            if not x or any(x.endswith(y[:k]) for k in range(1, len(y) + (i != j))):
                raise ValueError("sentinels must not be empty, equal or overlap each other")


def fill_in_middle(docs: DataFrame, unit: str = "char", sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    The cuts and the form depend on the doc_id and ``seed`` alone (sha256 of both), so
    reruns agree and rows that share an id are cut at the same ranks modulo their own n.
    A null text is empty; an empty text, and one that holds a sentinel, is ``plain``: its
    output is itself and prefix_chars and middle_chars are null. A row without doc_id is
    cut by the seed alone. Repeated rows give repeated rows, an empty table none. Only
    doc_id and text are read, so further columns of any name do no harm.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    check_sentinels(sentinels)
    marks = tuple(x.encode() for x in sentinels)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: list[tuple] = []
            size = 0
            for i, data in zip(b.column(0).to_pylist(), b.column(1)):
                found = arrange(data.as_py(), f"{seed}:{'' if i is None else i}", unit, marks, plain_from, spm_below)
                done.append((i, *found))
                size += len(found[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return arrow_map(rows, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary").withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of ``form`` was made of: the parts between its first sentinels, put in order."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
