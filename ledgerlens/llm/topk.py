"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks (one narrow pass, no shuffle); the stated queries
meet every block, block by block. Each round scores everything and adds up one
histogram of scores a query, finer than the last: the bin that holds the k-th
highest score is the next round's range, until bins are single scores. The last
round keeps what is above the k-th score and, of those equal to it, the smallest
ids. A block need not send bins below its own k-th highest score, which the whole
table's k-th can't be below, so it sends at most k bins a query, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import Scratch, arrow_map

SCALE = 256
#: Vectors of a block, queries of a block, and how many times finer a round is than the last.
BLOCK, QUERY_BLOCK, FINER = 4096, 1024, 4096
#: Sums of products below this are exact in float64.
_EXACT = float(1 << 53)


def most(dim: int) -> int:
    """Integer components beyond this are set to it: all scores of that many dimensions are at most 2^61 then."""
    return isqrt((1 << 61) // max(dim, 1))


def quantized(vectors: Iterator, scale: int = SCALE) -> list[np.ndarray | None]:
    """floor(scale * x) of each component as double, at most ``most(dim)`` either way; None for vectors that are null or hold null or non-finite components."""
    out = []
    for v in vectors:
        if v is None or any(x is None for x in v):
            out.append(None)
            continue
        x = np.array(v, dtype=np.float64)
        with np.errstate(over="ignore"):
            out.append(np.clip(np.floor(scale * x), -most(len(x)), most(len(x))) if np.isfinite(x).all() else None)
    return out


def _pack(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """``(n, dim, ids, mat)`` blocks of rows of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, mat = open_.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(mat, "<f8").tobytes()], pa.binary())], ["n", "dim", "ids", "mat"])

        for b in batches:
            for i, q in zip(b.column(0).to_pylist(), quantized(b.column(1).to_pylist(), scale)):
                if q is None or i is None:
                    continue
                ids, mat = open_.setdefault(len(q), ([], []))
                ids.append(i)
                mat.append(q)
                if len(ids) == size:
                    yield block(len(q))
        for dim in list(open_):
            yield block(dim)

    return arrow_map(rows, run, "n int, dim int, ids binary, mat binary")


def _scores(ids: np.ndarray, mat: bytes, qids: np.ndarray, qmat: bytes, dim: int) -> np.ndarray:
    """queries x vectors, exact integers; 0 where there are no components."""
    if dim == 0:
        return np.zeros((len(qids), len(ids)), np.int64)
    x, q = np.frombuffer(mat, "<f8").reshape(-1, dim), np.frombuffer(qmat, "<f8").reshape(-1, dim)
    if dim * max(1.0, np.abs(x).max()) * max(1.0, np.abs(q).max()) < _EXACT:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k highest-scoring other rows, ties to the smaller vec_id.

    ``table(vec_id, embedding)``. Vectors that are null, or hold null or non-finite
    components, and rows without an id take no part; a query meets only vectors of its
    own dimension, an empty one those that are empty too (score 0); of rows that repeat a
    query's id the one with the smallest embedding is the query. Components beyond most(dim) / scale (741,455 for 64
    dimensions) count as that. Rows other than the query's own are those with another vec_id;
    repeated rows are candidates each. No query or no candidate: no rows.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "topk")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("q"))
    data = scratch.write(_pack(rows.select("vec_id", "embedding"), block, scale))
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    queries = scratch.write(_pack(rows.where(F.col("q") & whole).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), QUERY_BLOCK, scale))
    edge = data.agg(F.max("n")).first()[0]
    if not edge or not queries.limit(1).count():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = arrow_map(data.select("mat"), _largest, "top double").unionByName(arrow_map(queries.select("mat"), _largest, "top double")).agg(F.max("top")).first()[0]
    dims = data.agg(F.max("dim")).first()[0]
    reach = min(int(bound) ** 2 * max(1, dims) + 1, 1 << 62)
    # Range of each query's k-th score: low inclusive, width of it and of a bin, and how many scores lie above the range.
    width = 1
    while width * FINER < 2 * reach:
        width *= FINER
    at = arrow_map(queries.select("ids"), _each_id, "query_id long").select("query_id", F.lit(-reach).cast("long").alias("low"), F.lit(0).cast("long").alias("above"))
    span = width * FINER
    while True:
        at = scratch.write(at)
        ranges = _with_ranges(data, at, queries, scratch)
        counts = arrow_map(ranges, _histogram(k, width, span), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("bin")))
        total = F.sum("n").over(W.partitionBy("query_id"))
        ranked = counts.withColumn("down", down).withColumn("total", total).join(at, "query_id")
        # The first bin, from above, by which k scores are reached; the lowest there is if fewer exist.
        hit = ranked.where((F.col("down") + F.col("above") >= k) | (F.col("down") == F.col("total")))
        at = hit.groupBy("query_id").agg(F.max_by(F.struct((F.col("low") + F.col("bin") * width).alias("low"), (F.col("above") + F.col("down") - F.col("n")).alias("above")), "bin").alias("s")).select("query_id", "s.*")
        if width == 1:
            break
        span, width = width, max(1, width // FINER)
    at = scratch.write(at)
    found = arrow_map(_with_ranges(data, at, queries, scratch), _winners(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tops = [float(np.abs(np.frombuffer(m.as_py(), "<f8")).max(initial=0.0)) for m in b.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(tops, pa.float64())], ["top"])


def _each_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_py(), "<i8"))], ["query_id"])


def _with_ranges(data: DataFrame, at: DataFrame, queries: DataFrame, scratch: Scratch) -> DataFrame:
    """Every pair of a block of vectors and a block of queries with the queries' ranges: the stated query set against all rows, in blocks."""
    ids = queries.select("dim", "mat", "ids", F.xxhash64("ids").alias("qb"))
    each = arrow_map(ids.select("qb", "ids"), _ids_of_block, "qb long, query_id long, pos int")
    ranges = each.join(at, "query_id").groupBy("qb").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "above"))).alias("r"))  # at most QUERY_BLOCK
    blocks = scratch.write(ids.join(ranges, "qb").select(F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("mat").alias("qmat"), F.col("r.pos").alias("pos"), F.col("r.low").alias("low"), F.col("r.above").alias("above")))
    return data.select("dim", "ids", "mat").crossJoin(blocks)


def _ids_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for qb, ids in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(ids.as_py(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([qb] * len(x), pa.int64()), pa.array(x), pa.array(np.arange(len(x), dtype=np.int32))], ["qb", "query_id", "pos"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for r in range(b.num_rows):
            dim, ids, mat, qdim, qids, qmat, pos, low, above = (c[r].as_py() for c in b.columns)
            if dim != qdim:
                continue
            ids, qids = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
            yield ids, qids, _scores(ids, mat, qids, qmat, dim), np.array(pos), np.array(low, dtype=np.int64), np.array(above)


def _histogram(k: int, width: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, qids, scores, pos, low, above in _blocks(batches):
            out_q, out_b, out_n = [], [], []
            for p, lo, ab in zip(pos.tolist(), low.tolist(), above.tolist()):
                s = scores[p][ids != qids[p]]
                s = s[(s >= lo) & (s <= min(lo + span - 1, (1 << 63) - 1))]
                if len(s) > k - ab:  # bins below this block's own k-th can't hold the table's
                    s = s[s >= (np.partition(s, len(s) - (k - ab))[len(s) - (k - ab)] - lo) // width * width + lo]
                bins, n = np.unique((s - lo) // width, return_counts=True)
                out_q += [int(qids[p])] * len(bins)
                out_b += bins.tolist()
                out_n += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], ["query_id", "bin", "n"])

    return run


def _winners(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, qids, scores, pos, low, _ in _blocks(batches):
            out: list[tuple[int, int, int]] = []
            for p, lo in zip(pos.tolist(), low.tolist()):
                s, other = scores[p], ids != qids[p]
                over = np.flatnonzero((s > lo) & other)
                even = np.flatnonzero((s == lo) & other)
                even = even[np.argsort(ids[even], kind="stable")[:k]]
                out += [(int(qids[p]), int(ids[i]), int(s[i])) for i in (*over, *even)]
            q, v, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return run
