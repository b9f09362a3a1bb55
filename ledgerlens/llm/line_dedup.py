"""Line deduplication by winnowing over line hashes.

A text's lines are cut at \\n and stripped; blank ones don't count. Over the hashes
of the others, every window of ``window`` consecutive lines selects its minimum (the
rightmost on ties) as a fingerprint, so equal runs of that many lines have a
fingerprint in common, at the same place. Fingerprints that occur once in the corpus
are dropped there: the rest are the positions where repeated runs can be. Each such
position is extended both ways to every run of ``window`` lines around it; runs are
joined by 128-bit digest, and all but the first (by doc_id, text, line) are repeats. The
lines of later repeated runs are deleted; longer runs are unions of these.

So: a line is deleted if and only if it lies in ``window`` consecutive lines that
also occur, line for line, at an earlier place. Nothing gathers the occurrences of
a fingerprint or a run: counts and first places are partial aggregates.

With ``long_words``, as ``deduplicate`` has it, shorter runs count too: one line or two
consecutive ones of more words than that, and the whole of a text that has fewer than
``window`` lines (against other whole texts). These are fingerprints of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import KEY, Scratch, arrow_map, key_of_text, marked, whole_rows

WINDOW = 3
LONG_WORDS = 50


def line_hashes(text: str) -> tuple[list[int], np.ndarray]:
    """Numbers and hashes of the lines that aren't blank."""
    numbers, hashes = [], []
    for n, line in enumerate(text.split("\n")):
        if line := line.strip():
            numbers.append(n)
            hashes.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")))
    return numbers, np.array(hashes, dtype=np.uint64)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the minima of all windows; none if there are fewer lines."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


def short_runs(text: str, numbers: list[int], hashes: np.ndarray, window: int, long_words: int) -> Iterator[tuple[int, int, bytes]]:
    """``(first place, end, content)`` of the runs below ``window`` lines that count: long ones, and a whole text."""
    n = len(numbers)
    if 0 < n < window:
        yield 0, n, b"whole" + hashes.tobytes()
    lines = text.split("\n")
    words = [len(lines[i].split()) for i in numbers]
    for size in range(1, min(window, 3)):
        for s in range(n - size + 1):
            if sum(words[s : s + size]) > long_words:
                yield s, s + size, hashes[s : s + size].tobytes()


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """``doc_id, lines`` and KEY: sorted numbers (from 0) of the lines to delete, for texts that have some.

    Null and empty texts have no window, short ones neither without ``long_words``.
    Rows that share doc_id and text hold the same places, so they are not repeats of
    each other; other texts under one doc_id are texts of their own, in the order of
    their hashes. Rows without a doc_id come last. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col("text").cast("string").alias("text"), *key_of_text()).where("text <> ''")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a fingerprint: its hash, place, and the digests of the windows around it."""
        for b in batches:
            doc, fp, digests = [], [], []
            for i, t in enumerate(b.column(0).to_pylist()):
                numbers, hashes = line_hashes(t)
                for p in winnow(hashes, window).tolist():
                    doc.append(i)
                    fp.append(int(hashes[p].astype(np.int64)))
                    around = range(max(0, p - window + 1), min(p, len(hashes) - window) + 1)
                    digests.append([{"s": s, "d": xxhash.xxh3_128_digest(hashes[s : s + window].tobytes()), "l": numbers[s : s + window]} for s in around])
                for s, e, content in short_runs(t, numbers, hashes, window, long_words) if long_words is not None else ():
                    doc.append(i)
                    fp.append(int(np.uint64(xxhash.xxh3_64_intdigest(content)).astype(np.int64)))
                    digests.append([{"s": s, "d": xxhash.xxh3_128_digest(content), "l": numbers[s:e]}])
            kind = pa.list_(pa.struct([("s", pa.int32()), ("d", pa.binary()), ("l", pa.list_(pa.int32()))]))
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in (1, 2, 3)), pa.array(fp, pa.int64()), pa.array(digests, kind)], [*KEY, "fp", "runs"])

    selected = scratch.write(arrow_map(rows, select, "k_none boolean, k_id long, k_text long, fp long, runs array<struct<s:int,d:binary,l:array<int>>>"))
    repeated = scratch.write(selected.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    runs = selected.join(repeated, "fp").select(*KEY, F.explode("runs").alias("r")).select(*KEY, "r.*").distinct()
    runs = scratch.write(runs.select(*KEY, "s", F.col("l").alias("lines"), F.hex("d").alias("d")))
    scratch.drop(selected, repeated)
    place = F.struct(*KEY, "s")
    first = scratch.write(runs.groupBy("d").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("d", "first"))
    later = runs.join(first, "d").where(place != F.col("first")).select(*KEY, F.explode("lines").alias("line")).distinct()
    lines = later.groupBy(*KEY).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    out = scratch.write(lines.select(F.when(~F.col("k_none"), F.col("k_id")).alias("doc_id"), "lines", *KEY))
    scratch.drop(runs, first)
    return out


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of those numbers (sorted, distinct), in one pass: what lies between each two is a slice."""
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(gone, k - 1) + 1)
    end = lambda k, lines: F.when(k == F.size(gone), F.size(lines)).otherwise(F.get(gone, k))
    between = lambda lines: F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, start(k) + 1, end(k, lines) - start(k)))
    # The array of one element binds the lines, so that they are split once.
    return F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: F.array_join(F.flatten(between(lines)), "\n")), F.lit(0))


def deduplicate(docs: DataFrame, window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """The rows of ``docs`` without the deleted lines; those left without a word are dropped if lines were deleted.

    Lines are deleted from the very text they were found in, whatever else shares its
    doc_id. Null texts stay as they are. Further columns may have any name.
    """
    gone = repeated_lines(docs, window, long_words).select(*KEY, "lines")  # a written table: its size is known
    rows = marked(whole_rows(docs), gone)
    joined = rows.where("k_maybe").join(gone, KEY, "left")
    text = F.col("k_row.text")
    out = joined.withColumn("k_kept", F.when(F.col("lines").isNull(), text).otherwise(without_lines(text, F.col("lines")))).where(F.col("lines").isNull() | F.col("k_kept").rlike(r"\S"))
    changed = out.select(*[F.col("k_kept").alias(c) if c == "text" else F.col("k_row").getField(c).alias(c) for c in docs.columns])
    return rows.where("not k_maybe").select("k_row.*").union(changed)
