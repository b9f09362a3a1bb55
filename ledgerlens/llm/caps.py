"""Near-duplicate embeddings by spherical-cap filters.

Filters are the words of a random product code (Becker, Ducas, Gama, Laarhoven
2016): the space, randomly rotated, is cut into ``parts`` blocks, each with its own
code of ``words`` unit vectors; a filter is one word of each block, scaled to a unit
vector. A vector is in the filter's cap if their inner product exceeds alpha. List
decoding finds all such filters of a vector: words of a block in order of inner
product, prefixes kept while the best the later blocks could add still reaches alpha.
No filter is left out, and none capped. alpha follows from the wanted number of caps
a vector is in; recall against brute force is measured in the tests.

Vectors with the same label that are equal, up to a power of two, are one class with a
count before any cap is dealt, so copies cost nothing. Classes of a label meet in the
caps they share, and pairs are verified by cosine in double precision, components
scaled by powers of two (exact), so neither large nor small ones overflow. A pair is
counted in the first cap that it shares, so each link counts once; a cap emits its
members' link counts and a spanning forest, not pairs. A cap with more members than
``block`` is dealt out as pairs of blocks: every task holds at most two blocks, however
hot the cap. A vector that few filters cover takes its LEAST best ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, arrow_map, components

SEED = 20240607
#: Caps that a vector is in, on average; the code's blocks; members of a cap at which the number of words aims, and its least.
CAPS, PARTS, MEMBERS, WORDS = 32, 2, 64, 64
BLOCK = 1024
#: Caps that every vector is in at least.
LEAST = 8


@lru_cache(maxsize=4)
def code(dim: int, parts: int, words: int, seed: int = SEED) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation and, for each block, its words (unit vectors over sqrt(parts))."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    books = []
    for width in (len(x) for x in np.array_split(np.arange(dim), parts)):
        book = rng.standard_normal((words, max(1, width)))
        books.append(book[:, :width] / np.linalg.norm(book, axis=1, keepdims=True) / math.sqrt(parts))
    return rotation, books


def alpha(dim: int, parts: int, words: int, caps: float) -> float:
    """Such that a random unit vector is in about ``caps`` of the words**parts caps."""
    share = min(0.5, caps / words**parts)
    if dim == 1 or share == 0.5:
        return 0.0
    x = (np.arange(1 << 18) + 0.5) / (1 << 18)  # inner products from 0 to 1; their density is (1 - x^2)^((dim - 3) / 2)
    above = np.cumsum(((1 - x * x) ** ((dim - 3) / 2))[::-1])
    return float(x[::-1][np.searchsorted(above, 2 * share * above[-1])])


def parts_of(dim: int, parts: int) -> int:
    """Blocks of fewer than 8 components would leave too few directions."""
    return max(1, min(parts, dim // 8))


def decode(unit: np.ndarray, parts: int, words: int, threshold: float, least: int = 0) -> list[np.ndarray]:
    """For each row of unit vectors the numbers of all filters above the threshold, ascending; its ``least`` best ones if these are fewer."""
    rotation, books = code(unit.shape[1], parts, words)
    turned = unit @ rotation.T
    at, products = 0, []
    for book in books:
        products.append(turned[:, at : at + book.shape[1]] @ book.T)
        at += book.shape[1]
    order = [np.argsort(-p, axis=1) for p in products]
    falling = [-np.take_along_axis(p, o, axis=1) for p, o in zip(products, order)]
    out = []
    for r in range(len(unit)):
        sums, number = np.zeros(1), np.zeros(1, dtype=np.int64)
        for k in range(len(products)):
            rest = -sum(f[r, 0] for f in falling[k + 1 :])  # what the later blocks can add at most
            n = np.searchsorted(falling[k][r], sums + rest - threshold)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sums = np.repeat(sums, n) - falling[k][r, at]
            number = np.repeat(number, n) * words + order[k][r, at]
        out.append(np.sort(number if len(number) >= least else _best([f[r, :least] for f in falling], [o[r, :least] for o in order], words, least)))
    return out


def _best(falling: list[np.ndarray], order: list[np.ndarray], words: int, least: int) -> np.ndarray:
    """The filters with the highest sums: only the best of the blocks so far can be among them."""
    sums, number = np.zeros(1), np.zeros(1, dtype=np.int64)
    for f, o in zip(falling, order):
        sums, number = (sums[:, None] - f).ravel(), (number[:, None] * words + o).ravel()
        best = np.argsort(-sums, kind="stable")[:least]
        sums, number = sums[best], number[best]
    return number


def _linked(rows: list[tuple], others: list[tuple] | None, cap: int, cosine: float):
    """Link counts (in vectors) and forest edges of pairs of classes within rows, or between rows and others, whose first common cap this is."""
    x = np.array([r[1] for r in rows])
    y = x if others is None else np.array([r[1] for r in others])
    near = (x @ y.T) / np.outer(np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))) >= cosine
    if others is None:
        np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    if not len(i):
        return
    # Rows that have a link here, and the caps before this one that two of them are in.
    ri, rj = np.unique(i), np.unique(j)
    before: dict[int, int] = {}
    many: list[tuple[int, int, int]] = []
    for side, idx, src in ((0, ri, rows), (1, rj, others or rows)):
        for k, a in enumerate(idx.tolist()):
            for c in np.frombuffer(src[a][2], "<i4").tolist():
                if c >= cap:
                    break
                many.append((side, k, before.setdefault(c, len(before))))
    fresh = near[np.ix_(ri, rj)]
    if before:
        a, b = np.zeros((len(ri), len(before)), np.float32), np.zeros((len(rj), len(before)), np.float32)
        for side, k, c in many:
            (b if side else a)[k, c] = 1
        fresh = fresh & (a @ b.T == 0)
    ids_i, ids_j = [rows[a][0] for a in ri.tolist()], [(others or rows)[b][0] for b in rj.tolist()]
    counts_i, counts_j = np.array([rows[a][4] for a in ri.tolist()], dtype=np.int64), np.array([(others or rows)[b][4] for b in rj.tolist()], dtype=np.int64)
    yield from zip(ids_i, (fresh @ counts_j).tolist())
    if others is not None:
        yield from zip(ids_j, (counts_i @ fresh).tolist())
    # Each row to one partner of its component: star edges to the smallest id reached within the block.
    label_i, label_j = np.array(ids_i, dtype=np.int64), np.array(ids_j, dtype=np.int64)
    near = near[np.ix_(ri, rj)]
    top = np.iinfo(np.int64).max
    while True:
        new_j = np.minimum(label_j, np.where(near, label_i[:, None], top).min(axis=0))
        new_i = np.minimum(label_i, np.where(near, new_j[None, :], top).min(axis=1))
        if (new_i == label_i).all() and (new_j == label_j).all():
            break
        label_i, label_j = new_i, new_j
    for own, low in ((ids_i, label_i), (ids_j, label_j)):
        for a, b in zip(own, low.tolist()):
            if a != b:
                yield a, -1, b


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of at least two rows that agree in the first columns, of a sorted stream."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        codes = [t.column(c).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(t.column(c).type) else t.column(c).to_numpy() for c in range(keys)]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1
        cuts = [0, *starts.tolist()]
        for a, z in zip(cuts, cuts[1:]):
            if z - a > 1:
                yield t.slice(a, z - a)
        held = t.slice(cuts[-1])
    if held is not None and held.num_rows > 1:
        yield held


def _prepared(rows: DataFrame) -> DataFrame:
    """``vec_id, label, raw, unit, v``: digests of the components as they are and scaled, and these; no unit for what links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            lists = b.column(1)
            lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], dtype=np.int64)
            flat = lists.flatten()
            gaps = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # one zero
            ends = np.cumsum(np.maximum(lengths, 0))
            raw: list[bytes] = [b""] * len(lengths)
            unit: list[bytes | None] = [None] * len(lengths)
            scaled: list[bytes | None] = [None] * len(lengths)
            for dim in np.unique(lengths).tolist():
                idx = np.flatnonzero(lengths == dim)
                if dim < 0:
                    continue
                cells = (ends[idx] - dim)[:, None] + np.arange(dim)
                mat, gap = values[cells], gaps[cells]
                top = np.abs(mat).max(axis=1, initial=0.0)
                fine = np.isfinite(mat).all(axis=1) & ~gap.any(axis=1) & (top > 0)
                small = np.ldexp(mat, -np.frexp(np.where(fine, top, 1.0))[1][:, None])
                for k, row, holes, ok, s in zip(idx.tolist(), mat, gap, fine.tolist(), small):
                    raw[k] = digest(row.tobytes() + (holes.tobytes() if holes.any() else b"")) + dim.to_bytes(4, "little")
                    if ok:
                        scaled[k] = s.astype("<f8").tobytes()
                        unit[k] = digest(scaled[k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(raw, pa.binary()), pa.array(unit, pa.binary()), pa.array(scaled, pa.binary())], ["vec_id", "label", "raw", "unit", "v"])

    return arrow_map(rows, run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, raw binary, unit binary, v binary")


def near_duplicates(table: DataFrame, cosine: float = 0.98, caps: int = CAPS, parts: int = PARTS, words: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per vector of ``table(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    A vector is a distinct row of these three columns: rows that repeat all of them are
    one, rows that share a vec_id but differ otherwise are vectors each. Vectors that are
    null, empty, zero, or hold null or non-finite components, and those with a null
    label, link with nothing; so do vectors of unequal dimension. A null vec_id takes
    part, but never names a component that has another id; without one it is null, and
    such a vector is kept. An empty table gives no rows. Only the three columns are
    read, so further ones of any name do no harm. ``words``: by the number of classes,
    so that a cap has some MEMBERS members.
    """
    scratch = Scratch(table.sparkSession, "caps")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").alias("label"))
    prepared = scratch.write(_prepared(rows))
    vectors = scratch.write(prepared.select("vec_id", "label", "raw", F.when(F.col("label").isNotNull(), F.col("unit")).alias("unit")).distinct())
    counted = vectors.where("unit is not null").groupBy("label", "unit").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    contents = prepared.where("unit is not null and label is not null").groupBy("label", "unit").agg(F.any_value("v").alias("v"))
    # The number of a class is fixed by being written.
    classes = scratch.write(contents.join(counted, ["label", "unit"]).withColumn("c", F.monotonically_increasing_id()))
    scratch.drop(prepared)

    if words is None:
        words = max(WORDS, 1 << math.ceil(math.log2(max(1, classes.count() * caps / MEMBERS)) / parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_dim: dict[int, list[int]] = {}
            vs = b.column(1).to_pylist()
            for k, v in enumerate(vs):
                by_dim.setdefault(len(v) // 8, []).append(k)
            where, cap, dim_of, all_caps = [], [], [], []
            for dim, idx in by_dim.items():
                unit = np.frombuffer(b"".join([vs[k] for k in idx]), "<f8").reshape(-1, dim)
                unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                n = parts_of(dim, parts)
                for k, found in zip(idx, decode(unit, n, words, alpha(dim, n, words, caps), LEAST)):
                    listed = found.tolist()
                    where += [k] * len(listed)
                    cap += listed
                    dim_of += [dim] * len(listed)
                    all_caps += [found.astype("<i4").tobytes()] * len(listed)
            take = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(dim_of, pa.int32()), pa.array(cap, pa.int64()), pa.array(all_caps, pa.binary()), b.column(1).take(take)], ["c", "label", "n", "dim", "cap", "caps", "v"])

    label_type = classes.schema["label"].dataType.simpleString()
    dealt = arrow_map(classes.select("c", "v", "label", "n"), deal, f"c long, label {label_type}, n long, dim int, cap long, caps binary, v binary")
    key = ["label", "dim", "cap"]
    sizes = scratch.write(dealt.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1").select(*key, F.ceil(F.col("m") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    # Block i of a cap meets blocks j >= i: its rows go to the cells (min, max) of all of them. One cell if the cap is not large.
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    placed = dealt.join(sizes, key).withColumn("own", own).withColumn("cell", F.explode(cells)).select(*key, "cell.i", "cell.j", "own", "c", "caps", "v", "n")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches, 5):
            cap, i, j = (t.column(c)[0].as_py() for c in (2, 3, 4))
            vectors = np.frombuffer(b"".join(t.column(7).to_pylist()), "<f8").reshape(t.num_rows, -1)
            rows = sorted(zip(t.column(6).to_pylist(), vectors, t.column(8).to_pylist(), t.column(5).to_pylist(), t.column(9).to_pylist()), key=lambda r: r[0])
            left = [r for r in rows if r[3] == i]
            right = None if i == j else [r for r in rows if r[3] == j]
            found = list(_linked(left, right, cap, cosine)) if left and (i == j or right) else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] if len(f) == 2 else 0 for f in found], pa.int64()), pa.array([f[2] if len(f) == 3 else None for f in found], pa.int64())], ["c", "links", "other"])

    cell = [*key, "i", "j"]
    met = placed.select(*cell, "own", "c", "v", "caps", "n").repartition(*cell).sortWithinPartitions(*cell)
    found = scratch.write(arrow_map(met, verify, "c long, links long, other long"))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("c").alias("a"), F.col("other").alias("b")), scratch)
    roots = scratch.write(roots.join(classes.select(F.col("c").alias("node"), "low"), "node"))
    named = roots.join(roots.groupBy("root").agg(F.min("low").alias("component_id")), "root").select(F.col("node").alias("c"), "component_id")
    of_class = scratch.write(
        classes.join(links, "c", "left").join(named, "c", "left").select("label", "unit", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    )
    scratch.drop(found, roots, sizes)
    known = vectors.where("unit is not null").join(of_class, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("component_id").isNull() | F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
