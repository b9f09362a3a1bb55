"""Product codes against plain Lloyd's rounds that compare everything."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import product_codes

NAN, INF = float("nan"), float("inf")


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [int(np.floor(scale * x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), lab))
    total = defaultdict(int)
    for r in out:
        total[r[3]] += r[2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(i, code, e, total[lab], sha) for i, code, e, lab in out], key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, v, lab, "e") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, error string")
    return sorted((tuple(r) for r in product_codes.code_reports(df).collect()), key=str)


def vectors(rng, n, dim=8, spread=1.0, grid=None):
    pick = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, spread))
    return [(k, [pick() for _ in range(dim)], rng.choice([None, 1, 2, 3])) for k in range(n)]


def test_random_vectors(spark):
    rows = vectors(random.Random(1), 700)
    rows += [(5, None, 1), (6, [None] * 8, 1), (7, [NAN] * 8, None), (8, [INF] * 8, 2), (None, rows[3][1], 1), rows[4]]
    assert got(spark, rows) == plain(rows)


def test_ties_and_equal_vectors(spark):
    rows = vectors(random.Random(2), 500, 4, grid=[-0.002, -0.001, 0.0, 0.001, 0.002])
    assert got(spark, rows) == plain(rows)
    same = [(k, [0.5] * 4, k % 2) for k in range(600)]
    out = got(spark, same)
    assert out == plain(same) and {r[1] for r in out} == {"00000000"}


def test_fewer_rows_than_entries_and_none(spark):
    rows = vectors(random.Random(3), 5)
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:1]) == plain(rows[:1])
    assert got(spark, []) == got(spark, [(1, None, 1)]) == []


def test_clusters_keep_bounds_and_results(spark):
    rng = random.Random(4)
    centers = [[rng.gauss(0, 3) for _ in range(8)] for _ in range(20)]
    rows = [(k, [x + rng.gauss(0, 0.05) for x in rng.choice(centers)], k % 3) for k in range(900)]
    assert got(spark, rows) == plain(rows)


def test_other_dimensions_padding_and_large_components(spark):
    rows = vectors(random.Random(6), 300, 6)
    odd = [*rows, (900, [1.0], 1), (901, [], 1), (902, [0.1] * 7, None)]
    padded = [(i, [*v[:6], 0.0, 0.0], lab) for i, v, lab in rows]
    assert got(spark, odd) == plain(padded)
    assert [r[1:3] for r in got(spark, [(1, [], 1), (2, [], 1)])] == [("00000000", 0)] * 2
    huge = [(1, [0.0] * 4, 1), (2, [1e300, -1e300, 0.0, 0.0], 1), (3, [16384.0, -16384.0, 0.0, 0.0], 1)]
    assert [r[2] for r in got(spark, huge)] == [0, 0, 0]


def test_bounds_never_change_an_assignment():
    rng = np.random.default_rng(8)
    for spread, k in ((3, 40), (30, 7), (1, 2), (100, 1)):
        x, c = rng.integers(-spread, spread + 1, (400, 3)), rng.integers(-spread, spread + 1, (k, 3))
        at = upper = lower = None
        before, scanned = None, []
        for _ in range(6):
            book = product_codes.Book(c, before)
            at, upper, lower = book.assign(x, at, upper, lower)
            d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
            assert (at == d.argmin(axis=1)).all()
            ordered = np.sqrt(np.sort(d, axis=1))
            assert (upper >= ordered[:, 0]).all() and (k == 1 or (lower <= ordered[:, 1]).all())
            scanned.append(at.copy())
            before, at = c, at.copy()
            c = np.where(rng.random((k, 1)) < 0.5, c, c + rng.integers(-1, 2, c.shape))


@pytest.mark.parametrize("reach", [10, 1 << 24])
def test_distances_are_exact(reach):
    rng = np.random.default_rng(9)
    x, c = rng.integers(-reach, reach + 1, (30, 40)), rng.integers(-reach, reach + 1, (20, 40))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
    assert product_codes.squared_distances(x, c).tolist() == want
