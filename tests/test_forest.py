"""The isolation forest as a table: its nodes, the walk by joins, and what it depends on."""

import random

import pytest

from ledgerlens.operators import iforest

DDL = "account long, " + ", ".join(f"{f} double" for f in iforest.FEATURES)


def accounts(n, seed=1, odd=()):
    rng = random.Random(seed)
    return [(k, *[(rng.gauss(0, 1) if k not in odd else 40.0 + k) for _ in iforest.FEATURES]) for k in range(n)]


def walked(nodes, x, tree):
    by = {(r.tree, r.node): r for r in nodes}
    r = by[tree, 1]
    while r.feature >= 0:
        r = by[tree, r.left if x[r.feature] <= r.cut else r.right]
    return r.length


def test_nodes_hold_all_rows_of_the_sample_and_both_sides_have_some(spark):
    nodes = iforest.forest(spark.createDataFrame(accounts(400), DDL), trees=7, sample=64).collect()
    by = {(r.tree, r.node): r for r in nodes}
    assert {t for t, _ in by} == set(range(7)) and all(by[t, 1].members == 64 for t in range(7))
    for r in nodes:
        if r.feature >= 0:
            assert r.left == 2 * r.node and r.length is None
            assert by[r.tree, r.left].members > 0 and by[r.tree, r.right].members > 0
            assert by[r.tree, r.left].members + by[r.tree, r.right].members == r.members
        else:
            depth = r.node.bit_length() - 1
            assert depth <= 6 and r.length == iforest.UNIT * depth + iforest.average_path(r.members)
    assert len({tuple((r.node, r.feature) for r in nodes if r.tree == t) for t in range(7)}) > 1


def test_walk_by_joins_is_the_plain_walk(spark):
    rows = accounts(300, seed=2)
    df = spark.createDataFrame(rows, DDL)
    nodes = iforest.forest(df, trees=9, sample=50).cache()
    got = {r.account: r.path for r in iforest.path_lengths(df, nodes, trees=9, sample=50).collect()}
    table = nodes.collect()
    assert got == {r[0]: sum(walked(table, [round(v, 6) for v in r[1:]], t) for t in range(9)) for r in rows}


def test_same_rows_same_forest_however_they_lie(spark):
    df = spark.createDataFrame(accounts(500, seed=3), DDL)
    one = sorted(map(str, iforest.forest(df, trees=4).collect()))
    assert one == sorted(map(str, iforest.forest(df.repartition(9), trees=4).collect()))
    assert one != sorted(map(str, iforest.forest(df, trees=4, seed=7).collect()))


def test_outliers_rank_highest(spark):
    df = spark.createDataFrame(accounts(600, seed=4, odd=(17, 399)), DDL)
    rank = {r.account: r.anomaly for r in iforest.percentile_rank(iforest.anomaly(df)).collect()}
    assert sorted(rank, key=rank.get)[-2:] in ([17, 399], [399, 17]) and len(rank) == 600


@pytest.mark.parametrize("rows", [[], accounts(1), accounts(2), [(k, *[1.0] * 7) for k in range(30)], [(1, *[None] * 7), (2, *[5.0] * 7)]])
def test_none_few_equal_and_null_rows(spark, rows):
    out = iforest.anomaly(spark.createDataFrame(rows, DDL)).collect()
    assert sorted(r.account for r in out) == [r[0] for r in rows]
    assert all(0 <= r.raw <= 1 for r in out)
    if len(rows) == 30:
        assert len({r.raw for r in out}) == 1
