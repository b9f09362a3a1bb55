"""Vector code compression: product codes by Lloyd's iteration with Hamerly's bounds.

Vectors become integers and are cut into parts; each part position has a codebook. A row
of the state holds, for each part, its entry, an upper bound of the distance to it and a
lower bound of the distance to the second-nearest entry (Hamerly 2010). After the entries
have moved both bounds move along. While the upper one is strictly below the lower one, or
below half the entry's distance to its nearest neighbour, no other entry can be as near and
the part stays where it is. If that fails the upper bound is made exact and tried again, and
only if it fails too all entries are compared, in integers, the lower index first. Bounds
are floats rounded outwards, so they never decide a tie or what rounding could turn.

State rows are written once a round, without a shuffle. What the driver sees is bounded by
the codebooks' size: sums of the parts that changed entries are added up inside each task,
then by Spark, to one row for each entry and position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, arrow_map

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components beyond this are set to it: squared distances of 4,096 of them fit a long.
MOST = 1 << 24
_EXACT = float(1 << 51)


def quantized(flat: np.ndarray, dim: int, padded: int, scale: int) -> np.ndarray:
    """rows x padded integers: floor(scale * x), at most MOST either way, zeros behind the last component."""
    out = np.zeros((len(flat) // dim if dim else 0, padded), np.int64)
    if dim:
        out[:, :dim] = np.clip(np.floor(flat.reshape(-1, dim) * scale), -MOST, MOST).astype(np.int64)
    return out


def _root_up(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(np.nextafter(squared.astype(np.float64), np.inf)), np.inf)


def _root_down(squared: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(np.maximum(np.nextafter(squared.astype(np.float64), -np.inf), 0.0)), -np.inf), 0.0)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """rows x entries, exact integers."""
    reach = max(1, np.abs(x).max(initial=0)) * max(1, np.abs(c).max(initial=0)) * max(1, x.shape[1])
    dot = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if reach < _EXACT else x @ c.T
    return (x * x).sum(axis=1)[:, None] - 2 * dot + (c * c).sum(axis=1)[None, :]


class Book:
    """The entries of one part position, with how far each moved in the last round and half the distance to its nearest neighbour."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None) -> None:
        self.c = entries
        k = len(entries)
        apart = squared_distances(entries, entries)
        apart[np.arange(k), np.arange(k)] = np.iinfo(np.int64).max
        self.half = _root_down(apart.min(axis=1)) / 2 if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.where((entries == before).all(axis=1), 0.0, _root_up(((entries - before) ** 2).sum(axis=1)))
        self.moved = moved
        # An entry's rivals move by the largest movement of the others.
        order = np.argsort(moved)
        self.rivals = np.full(k, moved[order[-1]])
        self.rivals[order[-1]] = moved[order[-2]] if k > 1 else 0.0

    def assign(self, x: np.ndarray, at: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entry, upper and lower bound of each row of ``x``; without a state all entries are compared."""
        if at is None:
            at, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
            open_ = np.arange(len(x))
        else:
            upper = np.where(self.moved[at] > 0, np.nextafter(upper + self.moved[at], np.inf), upper)
            lower = np.where(self.rivals[at] > 0, np.nextafter(lower - self.rivals[at], -np.inf), lower)
            bar = np.maximum(lower, self.half[at])
            open_ = np.flatnonzero(upper >= bar)
            upper[open_] = _root_up(self.error(x[open_], at[open_]))
            open_ = open_[upper[open_] >= bar[open_]]
        if len(open_):
            d = squared_distances(x[open_], self.c)
            best = d.argmin(axis=1)  # the first of equal ones
            rows = np.arange(len(open_))
            near = d[rows, best]
            d[rows, best] = np.iinfo(np.int64).max
            at[open_], upper[open_] = best, _root_up(near)
            lower[open_] = _root_down(d.min(axis=1)) if len(self.c) > 1 else np.inf
        return at, upper, lower

    def error(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((x - self.c[at]) ** 2).sum(axis=1)


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of a binary column whose values have ``width`` items each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _binary(rows: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows, kind)], pa.binary())


def _assign(state: DataFrame, books: list[Book], padded: int, label: str) -> DataFrame:
    """The next state: ``vec_id, label, x, code, was, bounds``; ``was`` is the code before, null at first."""
    width = padded // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), "<i4", padded).astype(np.int64)
            first = b.column(3).null_count > 0
            code = None if first else _matrix(b.column(3), "<i4", len(books)).astype(np.int64)
            bounds = None if first else _matrix(b.column(4), "<f8", 2 * len(books))
            codes, both = np.zeros((len(x), len(books)), np.int64), np.zeros((len(x), 2 * len(books)))
            for p, book in enumerate(books):
                own = (None, None, None) if first else (code[:, p].copy(), bounds[:, 2 * p].copy(), bounds[:, 2 * p + 1].copy())
                codes[:, p], both[:, 2 * p], both[:, 2 * p + 1] = book.assign(x[:, p * width : (p + 1) * width], *own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _binary(codes, "<i4"), b.column(3), _binary(both, "<f8")], ["vec_id", "label", "x", "code", "was", "bounds"])

    return arrow_map(state.select("vec_id", "label", "x", "code", "bounds"), run, f"vec_id long, label {label}, x binary, code binary, was binary, bounds binary")


def _changes(state: DataFrame, parts: int, entries: int, padded: int) -> DataFrame:
    """``at, pos, v``: what the parts that changed entries add to each entry's count (pos -1) and sums, net, one row a task at most."""
    width = padded // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for b in batches:
            x = _matrix(b.column(0), "<i4", padded).astype(np.int64)
            code = _matrix(b.column(1), "<i4", parts)
            old = [i for i, w in enumerate(b.column(2)) if w.is_valid]
            was = _matrix(b.column(2).take(pa.array(old, pa.int64())), "<i4", parts)
            for p in range(parts):
                own = np.concatenate([np.ones((len(x), 1), np.int64), x[:, p * width : (p + 1) * width]], axis=1)
                np.add.at(total, p * entries + code[:, p], own)
                np.subtract.at(total, p * entries + was[:, p], own[old])
        at, pos = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array((pos - 1).astype(np.int32)), pa.array(total[at, pos])], ["at", "pos", "v"])

    changed = state.where("was is null or code <> was").select("x", "code", "was")
    return arrow_map(changed, run, "at int, pos int, v long").groupBy("at", "pos").agg(F.sum("v").alias("v"))


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code array<int>, error`` of each kept row of ``table(vec_id, embedding, label)``, and the codebooks by part.

    Rows go whose vector is null or holds null or non-finite components, and those of
    another dimension than the row of smallest vec_id (null ids last, ties by the vector).
    Dimensions that ``parts`` doesn't divide get zeros at their end; components beyond
    MOST / scale count as that. Codebooks start as the first ``entries`` rows (fewer
    rows: fewer entries). Repeated rows each count. Without a kept row there is
    no codebook and no row. Other columns are not read.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "codes")
    label = table.schema["label"].dataType.simpleString()
    v = F.col("embedding")
    finite = v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.cast("array<double>").alias("embedding")).where(finite)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    head = rows.orderBy(*order).limit(entries).select("embedding").collect()
    if not head:
        return spark.createDataFrame([], f"vec_id long, label {label}, code array<int>, error long"), []
    dim = len(head[0][0])
    rows = rows.where(F.size("embedding") == dim)
    if any(len(r[0]) != dim for r in head):
        head = rows.orderBy(*order).limit(entries).select("embedding").collect()
    padded = -(-max(dim, 1) // parts) * parts
    width = padded // parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
            x = quantized(flat, dim, padded, scale) if dim else np.zeros((b.num_rows, padded), np.int64)
            none = pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(x, "<i4"), none, none], ["vec_id", "label", "x", "code", "bounds"])

    start = quantized(np.array([r[0] for r in head], np.float64).ravel(), dim, padded, scale) if dim else np.zeros((len(head), padded), np.int64)
    books = [Book(start[:, p * width : (p + 1) * width].copy()) for p in range(parts)]
    n = len(start)
    state = arrow_map(rows.select("vec_id", "label", "embedding"), pack, f"vec_id long, label {label}, x binary, code binary, bounds binary")
    total = np.zeros((parts * n, width + 1), dtype=object)  # whole integers of any size
    for r in range(rounds):
        after = scratch.write(_assign(state, books, padded, label))
        if r:
            scratch.drop(state)
        state = after
        for c in _changes(state, parts, n, padded).collect():  # an entry's count and sums: parts x entries x (width + 1) rows at most
            total[c.at, c.pos + 1] += c.v
        new = []
        for p, book in enumerate(books):
            own, entry = total[p * n : (p + 1) * n], book.c.copy()
            for k in np.flatnonzero(own[:, 0] > 0):
                entry[k] = [int(s) // int(own[k, 0]) for s in own[k, 1:]]
            new.append(Book(entry, book.c))
        books = new

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), "<i4", padded).astype(np.int64)
            codes = _matrix(b.column(3), "<i4", parts)
            error = sum(book.error(x[:, p * width : (p + 1) * width], codes[:, p]) for p, book in enumerate(books))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    last = _assign(state, books, padded, label)
    done = scratch.write(arrow_map(last, finish, f"vec_id long, label {label}, code array<int>, error long"))
    if rounds:
        scratch.drop(state)
    return done, [b.c for b in books]


def books_sha256(books: list[np.ndarray]) -> str:
    """Of all decimal components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def code_reports(table: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each kept row; see ``compress``.

    ``code`` is the entries as two hex digits each. ``label_error`` adds up the errors of
    equal labels, nulls together; it is null where the sum doesn't fit a long. Sums of labels are written first: Spark broadcasts
    them only if that table is small, and splits a hot label's rows otherwise.
    """
    codes, books = compress(table)
    sums = codes.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(19,0))) as bigint)").alias("label_error"))
    sums = Scratch(table.sparkSession, "labels").write(sums.withColumnRenamed("label", "l"))
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
