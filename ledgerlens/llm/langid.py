"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 1- to 3-grams of the code points of the lower-cased text, with
two NULs before and after it, hashed into ``buckets``. Training counts (language,
bucket) over all labelled training rows: each task adds up dense counts and emits
what is not zero, Spark adds the tasks up. The smoothed log-probability matrix has
buckets x languages float64 cells; at most MATRIX_BYTES of it are sent out at once.
Scoring gathers the matrix rows of a slice's n-grams and adds them up per text. More
languages than fit are scored in blocks of columns, one after another, whose best
scores and sums are then put together: the same result, one pass a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import KEY, Scratch, arrow_map, key_of_text, whole_rows

BUCKETS = 1 << 15
UNDETERMINED = "und"
#: Posterior that a language needs to claim a text.
LEAST = 0.4
#: Bytes of the matrix, or of a block of its columns, at most.
MATRIX_BYTES = 256 << 20
#: Code points that are scored or counted at once.
WINDOW = 1 << 19
_PAD = "\0\0"
_P1, _P2, _P3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def _hashed(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each code point but the last two."""
    shift = np.uint32(32 - bits)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    one = a * _P1
    two = one ^ (b * _P2)
    three = two ^ (c * _P3)
    return [((x ^ (x >> np.uint32(15))) * _P2) >> shift for x in (one, two + np.uint32(1), three + np.uint32(2))]


def _windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of code points (two more at the end), with the rows that have some in it and where these start."""
    lengths = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    joined = _PAD + _PAD.join(texts) + _PAD  # n-grams never reach from one text into another
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    starts = np.concatenate([[0], np.cumsum(lengths)])
    total = int(starts[-1])
    for at in range(0, total, WINDOW):
        end = min(at + WINDOW, total)
        first = int(np.searchsorted(starts, at, side="right")) - 1
        last = int(np.searchsorted(starts, end, side="left"))
        yield codes[at : end + 2], np.arange(first, last), np.maximum(starts[first:last], at) - at


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _counted(labelled: DataFrame, buckets: int, scratch: Scratch) -> tuple[list[str], DataFrame]:
    """The languages in order, and the written table ``lang, bucket, n`` of ``labelled(text, lang)``; rows with a null are left out."""
    bits = buckets.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}

        def dense(lang: str) -> pa.RecordBatch:
            total = seen.pop(lang)
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

        for b in batches:
            by_lang: dict[str, list[str]] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(t.lower())
            for lang, texts in by_lang.items():
                if lang not in seen and len(seen) >= MATRIX_BYTES // (8 * buckets):
                    yield dense(next(iter(seen)))
                total = seen.setdefault(lang, np.zeros(buckets, np.int64))
                for codes, _, _ in _windows(texts):
                    for h in _hashed(codes, bits):
                        total += np.bincount(h, minlength=buckets)
        for lang in list(seen):
            yield dense(lang)

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = scratch.write(arrow_map(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    return sorted(r.lang for r in counts.select("lang").distinct().collect()), counts


def _matrix(counts: DataFrame, languages: list[str], buckets: int, smoothing: float) -> np.ndarray:
    """Log-probabilities (buckets x languages) of a block of languages: one row per language, at most ``buckets`` entries."""
    matrix = np.zeros((buckets, len(languages)))
    place = {lang: k for k, lang in enumerate(languages)}
    for r in counts.where(F.col("lang").between(languages[0], languages[-1])).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("n")).collect() if languages else ():
        cells = dict(r.n)
        matrix[np.fromiter(cells.keys(), np.int64, len(cells)), place[r.lang]] = np.fromiter(cells.values(), np.float64, len(cells))
    matrix += smoothing
    return np.log(matrix / matrix.sum(axis=0)) if languages else matrix


def train(labelled: DataFrame, buckets: int = BUCKETS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probability matrix (buckets x languages) of ``labelled(text, lang)``; rows with a null are left out.

    Priors are uniform: a text's n-grams alone decide. Without any row: no languages.
    The whole matrix comes to the driver; ``identify`` goes by blocks of MATRIX_BYTES.
    """
    scratch = Scratch(labelled.sparkSession, "langid")
    languages, counts = _counted(labelled, buckets, scratch)
    if len(languages) * buckets * 8 > MATRIX_BYTES:
        raise ValueError(f"{len(languages)} languages x {buckets} buckets are over {MATRIX_BYTES} bytes; use identify, which goes by blocks")
    matrix = _matrix(counts, languages, buckets, smoothing)
    scratch.drop(counts)
    return languages, matrix


def _block_scores(docs: DataFrame, matrix: np.ndarray) -> DataFrame:
    """For rows of ``text, ...``: ``best`` column, its score ``top`` and ``rest``, the sum of exp(score - top); null best without a column."""
    bits = len(matrix).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(matrix.astype(np.float64))
    n = matrix.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        columns = [np.ascontiguousarray(table[:, k]) for k in range(n)]
        for b in batches:
            texts = [(t or "").lower() for t in b.column(0).to_pylist()]
            total = np.zeros((len(texts), max(1, n)))
            for codes, rows, starts in _windows(texts) if texts and n else ():
                for h in _hashed(codes, bits):
                    for k, column in enumerate(columns):
                        total[rows, k] += np.add.reduceat(column[h], starts)
            best = total.argmax(axis=1)
            top = total[np.arange(len(texts)), best]
            rest = np.exp(total - top[:, None]).sum(axis=1)
            letter = pa.array([bool(n) and has_letter(t) for t in texts])
            yield pa.RecordBatch.from_arrays([letter, pa.array(best.astype(np.int32)), pa.array(top), pa.array(rest), *b.columns[1:]], ["letter", "best", "top", "rest", *b.schema.names[1:]])

    fields = docs.schema.fields[1:]
    return arrow_map(docs, score, ", ".join(["letter boolean, best int, top double, rest double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)]))


def _shown(scored: DataFrame, languages: Column) -> list[Column]:
    known = F.col("letter")
    return [F.when(known, languages).otherwise(UNDETERMINED).alias("lang_pred"), F.when(known, 1 / F.col("rest")).otherwise(0.0).alias("score")]


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, carry: list[Column] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` and ``carry`` for every row: the most probable language of the whole text and its posterior.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. Ties go to the language that sorts first.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *(carry or []))
    scored = _block_scores(rows, matrix)
    names = F.element_at(F.array(*map(F.lit, languages or [UNDETERMINED])), F.col("best") + 1)
    return scored.select("doc_id", *_shown(scored, names), *rows.columns[2:])


def _predict_by_blocks(docs: DataFrame, languages: list[str], counts: DataFrame, buckets: int, smoothing: float, scratch: Scratch, carry: list[Column]) -> DataFrame:
    """As ``predict``, a block of languages after another over numbered rows; the first best block wins ties."""
    size = max(1, MATRIX_BYTES // (8 * buckets))
    rows = scratch.write(docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *carry).withColumn("row", F.monotonically_increasing_id()))
    parts = None
    for at in range(0, len(languages), size):
        block = languages[at : at + size]
        scored = _block_scores(rows.select("text", "row"), _matrix(counts, block, buckets, smoothing))
        names = F.element_at(F.array(*map(F.lit, block)), F.col("best") + 1)
        one = scratch.write(scored.select("row", "letter", names.alias("lang"), "top", "rest", F.lit(-at).alias("first")))
        parts = one if parts is None else parts.unionByName(one)
    highest = scratch.write(parts.groupBy("row").agg(F.max(F.struct("top", "first", "lang", "letter")).alias("b")))
    rest = parts.join(highest, "row").groupBy("row").agg(F.sum(F.col("rest") * F.exp(F.col("top") - F.col("b.top"))).alias("rest"), F.first("b").alias("b"))
    scored = rows.drop("text").join(rest.select("row", "rest", "b.lang", "b.letter"), "row")
    return scored.select("doc_id", *_shown(scored, F.col("lang")), *[c for c in rows.columns if c not in ("text", "doc_id", "row")])


def fold() -> Column:
    """crc32 of the doc_id as text, mod 3; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(0))


def _identified(docs: DataFrame, buckets: int, carry: list[Column], smoothing: float = 0.5) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "langid")
    languages, counts = _counted(docs.where(fold() != 1).select("text", "lang"), buckets, scratch)
    if len(languages) * buckets * 8 > MATRIX_BYTES:
        return _predict_by_blocks(docs, languages, counts, buckets, smoothing, scratch, carry)
    matrix = _matrix(counts, languages, buckets, smoothing)
    scratch.drop(counts)
    return predict(docs, languages, matrix, carry)


def identify(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Learns from the rows of ``docs`` outside fold 1 and predicts all: ``doc_id, held_out, lang_pred, score``.

    Only doc_id (for the fold), text and lang are read. Equal rows give equal rows, an
    empty table none. Null, empty and letterless texts are ``und`` with score 0.
    """
    return _identified(docs, buckets, []).select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, buckets: int = BUCKETS, wanted: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` in a language: those of another than the ``wanted`` ones (all, if None) go, and those that no language claims.

    A language claims a text if its posterior is ``least`` or more; letterless, null and empty texts are
    ``und`` with 0. Each row is judged by its own text: what else shares its doc_id
    doesn't matter, and neither do further columns of any name.
    """
    unclaimed = (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least)
    if wanted is not None:
        unclaimed |= ~F.col("lang_pred").isin(wanted)
    rejected = _identified(docs, buckets, key_of_text()).where(unclaimed).select(*KEY).distinct()
    # Written first: its size is then known, and where it is small the texts need no exchange to meet it.
    gone = Scratch(docs.sparkSession, "langid-gone").write(rejected)
    return whole_rows(docs).join(gone, KEY, "left_anti").select("k_row.*")
