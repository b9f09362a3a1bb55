"""Substring deduplication by content-defined chunks.

A gear rolling hash (h = 2h + gear[byte] mod 2^32, so it forgets a byte after 32)
runs over a text's UTF-8 bytes; a chunk ends before a character where the hash has
MASK_BITS zero bits in its middle, which depend on the last 16 bytes alone, if
it has at least ``least`` bytes, or at ``most``. Boundaries thus depend on nearby
content: an insertion moves those near it and no others, so a passage shared by two
documents has the same chunks in both but for its ends.

Chunks are compared by 128-bit digest. The first occurrence (by doc_id, position) of
a digest stays, later ones are repeats; consecutive repeats form a run, and runs of
at least ``run_chars`` characters are removed. The occurrences of a digest are never
gathered: first position and count are partial aggregates, and chunks meet the
repeated digests in a plain join that AQE splits at hot digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KEY, Scratch, arrow_map, key_of_text, whole_rows

MASK_BITS, LEAST, MOST = 5, 24, 512
RUN_CHARS = 100
SEED = 20240611


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, by doubling: a window of 2w is that of w and, shifted left by w, the one w bytes before."""
    h = gear()[data]
    for w in (1, 2, 4, 8, 16):
        if w >= len(h):
            break
        new = h.copy()
        new[w:] += h[:-w] << np.uint32(w)
        h = new
    return h


def chunk_ends(data: bytes, mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """End offsets of the chunks of UTF-8 data; the last is its length."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return []
    mask = np.uint32(((1 << mask_bits) - 1) << (16 - mask_bits))
    starts = np.ones(len(b) + 1, dtype=bool)
    starts[:-1] = (b & 0xC0) != 0x80  # offsets at which a character starts
    cuts = np.flatnonzero(((rolling(b) & mask) == 0) & starts[1:]) + 1
    ends, at = [], 0
    for cut in [*cuts.tolist(), len(b)]:
        while cut - at > most:
            stop = at + most
            while not starts[stop]:
                stop -= 1
            if stop <= at:
                stop = at + most
            ends.append(stop)
            at = stop
        if cut - at >= least or cut == len(b):
            if cut > at:
                ends.append(cut)
            at = cut
    return ends


def chunks(docs: DataFrame, mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """KEY and ``seq, start, chars, hi, lo``: chunks of all texts, positions in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, seq, start, chars, digests = [], [], [], [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                ends = chunk_ends(data, mask_bits, least, most)
                if not ends:
                    continue
                if len(data) == len(t):
                    points = ends
                else:
                    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[np.array(ends) - 1].tolist()
                at, point = 0, 0
                digest = xxhash.xxh3_128_digest
                for end, p in zip(ends, points):
                    start.append(point)
                    chars.append(p - point)
                    digests.append(digest(data[at:end]))
                    at, point = end, p
                seq += range(len(ends))
                doc += [i] * len(ends)
            halves = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(doc, pa.int64())) for c in (1, 2, 3)), pa.array(seq, pa.int32()), pa.array(start, pa.int32()), pa.array(chars, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                [*KEY, "seq", "start", "chars", "hi", "lo"],
            )

    rows = docs.select(F.col("text").cast("string").alias("text"), *key_of_text()).where("text <> ''")
    return arrow_map(rows, run, "k_none boolean, k_id long, k_text long, seq int, start int, chars int, hi long, lo long")


def repeats(docs: DataFrame, run_chars: int = RUN_CHARS, mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``doc_id, start, end, chunks, first_doc_id`` and KEY: the runs to remove, end exclusive; first_doc_id holds the first copy of the run's first chunk.

    Null and empty texts have no chunks. Rows that share doc_id and text hold the same
    places, so they are not repeats of each other; other texts under one doc_id are
    texts of their own, in the order of their hashes. Rows without a doc_id come last.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    found = scratch.write(chunks(docs, mask_bits, least, most))
    place = F.struct(*KEY, "start")
    repeated = found.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("hi", "lo", "first")
    repeated = scratch.write(repeated)
    first_id = F.when(~F.col("first.k_none"), F.col("first.k_id")).alias("first_doc_id")
    later = found.join(repeated, ["hi", "lo"]).where(place != F.col("first")).select(*KEY, "seq", "start", "chars", first_id)
    # A text's repeats, in order: seq less the rank is the same along a run.
    per_text = later.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("seq", "start", "chars", "first_doc_id"))).alias("c"))
    one = per_text.select(*KEY, F.posexplode("c").alias("k", "c")).select(*KEY, (F.col("c.seq") - F.col("k")).alias("run"), "c.*")
    runs = one.groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("chars")).alias("end"), F.count("*").alias("chunks"), F.min_by("first_doc_id", "seq").alias("first_doc_id"))
    runs = runs.where(F.col("end") - F.col("start") >= run_chars)
    out = scratch.write(runs.select(F.when(~F.col("k_none"), F.col("k_id")).alias("doc_id"), "start", "end", "chunks", "first_doc_id", *KEY))
    scratch.drop(found, repeated)
    return out


def without_spans(text: str | None, spans: list[dict] | None) -> str | None:
    """What lies between the spans, which are in order and apart, and after the last."""
    if text is None or spans is None:
        return text
    parts, at = [], 0
    for s in spans:
        parts.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*parts, text[at:]])


def deduplicate(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of ``docs`` with the repeated runs cut out of the very texts they were found in; further columns may have any name."""
    spans = repeats(docs, **settings).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = whole_rows(docs).join(Scratch(docs.sparkSession, "substring-spans").write(spans), KEY, "left")
    text = F.col("k_row.text")

    @F.arrow_udf("string")
    def kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([without_spans(t.as_py(), s.as_py()) for t, s in zip(texts, spans)], pa.string())

    out = joined.withColumn("k_kept", kept(text.cast("string"), "spans"))
    return out.select(*[F.col("k_kept").alias(c) if c == "text" else F.col("k_row").getField(c).alias(c) for c in docs.columns])
