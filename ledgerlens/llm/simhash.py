"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: a text's ASCII letters are lower-cased, its words are runs of
anything but space and \\t-\\r, each k-word shingle (repeats included; the whole
sequence if there are fewer words) is hashed by XXH64 with seed 42, and a bit is
set if it is set in over half the hashes. No word: fingerprint zero.

Covering masks (Pagh 2016): each bit position i has a non-zero vector m(i) of
r + 1 bits; table v, for each non-zero v, keeps the bits with <m(i), v> = 1. The
at most r positions where two fingerprints differ leave some v orthogonal to all
their m(i), so in table v both have the same key: no pair within r is missed.

Exact copies of a fingerprint are one class before any table is built. Buckets of
up to ``bucket_limit`` classes are compared in one task and give a spanning forest,
not pairs. Larger ones go another exact, linear way: two fingerprints are within
2s bits if and only if some point is within s bits of both, so each member emits
the points within s bits, and all that meet at a point are linked to its smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import near_groups
from .shared import KEY, Scratch, arrow_map, components, marked, whole_rows

SEED = 42
BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OFFSETS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, words: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - words] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())], dtype="<u8")
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BYTE_BITS).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 signed masks, of nearly equal weight: bit i has the vector i mod (2^(radius+1) - 1) + 1."""
    n = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]
    return [_signed(m) for m in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(classes: DataFrame, radius: int, scratch: Scratch, bucket_limit: int = 1024) -> DataFrame:
    """Edges ``(a, b)`` between the distinct fingerprints ``fp`` of classes, whose components are those of all pairs within radius."""
    masks = covering_masks(radius)
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    buckets = scratch.write(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    small = keyed.join(buckets.where(F.col("n") <= bucket_limit).select("t", "key"), ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = [], []
            for fps in b.column(0):
                x, y = _forest(np.array(fps.as_py(), dtype=np.int64), radius)
                a += x
                z += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    edges = arrow_map(small, forest, "a long, b long")
    if buckets.where(F.col("n") > bucket_limit).limit(1).count():
        hot = scratch.write(keyed.join(buckets.where(F.col("n") > bucket_limit).select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct())
        edges = edges.unionByName(_meeting(hot, radius))
    return edges


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links each fingerprint of a bucket to the smallest that it reaches there."""
    fps = np.unique(fps)
    bits = fps.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at].tolist(), fps[label[at]].tolist()


def _meeting(hot: DataFrame, radius: int) -> DataFrame:
    """Exact edges for the members of large buckets by common points within radius / 2 (both halves, if radius is odd)."""
    far, near = (radius + 1) // 2, radius // 2

    def around(s: int) -> DataFrame:
        flips = [_signed(sum(1 << i for i in c)) for k in range(s + 1) for c in combinations(range(BITS), k)]
        return hot.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))

    # An odd radius: a point within `near` of one and within `far` of the other. All of `near` at z are linked; `far` ones to each of them.
    inner = around(near)
    low = inner.groupBy("z").agg(F.min("fp").alias("m"))
    outer = around(far) if far != near else inner
    return outer.join(low, "z").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("m"))) <= radius).where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, bucket_limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id reachable).

    Null and blank texts have fingerprint zero and are linked like any other; a
    repeated doc_id gives a row each time; a null doc_id takes part but never names
    a component that has another id; an empty table gives no rows. Only ``doc_id``
    and ``text`` are read, so further columns of any name do no harm.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, words))
    classes = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = scratch.write(components(near_links(classes, radius, scratch, bucket_limit), scratch))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = scratch.write(linked.groupBy("root").agg(F.min("low").alias("component_id")))
    named = roots.join(lowest, "root").select(F.col("node").alias("fp"), "component_id")
    of_class = scratch.write(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")))
    return fps.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each near-duplicate group (``near``) of ``docs``: that of its smallest doc_id, then of its smallest text hash.

    Of rows that share doc_id and text one stays, the first by a hash of all its columns.
    Rows without a doc_id take part and come last. Further columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "near-kept")
    texts = scratch.write(near_groups(docs, words, similarity))
    first = F.struct(*KEY) == F.col("first")
    odd = scratch.write(texts.where(~first | (F.col("rows") > 1)).select(*KEY, first.alias("k_first")))
    rows = marked(whole_rows(docs), odd)
    met = rows.where("k_maybe").join(odd, KEY, "left")
    hashed = F.xxhash64(*[F.col("k_row").getField(f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    once = met.where("k_first").groupBy(*KEY).agg(F.min_by("k_row", hashed).alias("k_row"))
    return rows.where("not k_maybe").select("k_row.*").union(met.where("k_first is null").select("k_row.*")).union(once.select("k_row.*"))
