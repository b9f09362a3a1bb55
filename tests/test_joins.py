"""Joins that must not meet in the square of a busy key: hold times and similar sets, against plain versions."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import hits, velocity


def _payments(seed):
    rng = random.Random(seed)
    us = lambda: rng.choice([rng.randrange(-10**9, 10**9), rng.randrange(10**13), 60_000_000 * rng.randrange(50)])
    rows = [(k, us(), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([0, 0, 1, 2, 4]), rng.choice([0.0, 100.0, 75.0, 125.0, rng.uniform(1, 500)])) for k in range(400)]
    return [(*r, "transfer", "BankA", "BankB") for r in rows]


@pytest.mark.parametrize("direct_pairs", [0, 500, 1 << 22])
@pytest.mark.parametrize("seed", [1, 2])
def test_hold_times_match_a_plain_search(spark, direct_pairs, seed):
    rows = _payments(seed)
    e = spark.createDataFrame(rows, "txn_id long, us long, src long, dst long, amount double, channel string, bank_src string, bank_dst string")
    held = {}
    for _, t, _, account, a, *_ in rows:
        later = [u - t for _, u, src, _, b, *_ in rows if src == account and u > t and a * 0.75 <= b <= a * 1.25]
        if later:
            held.setdefault(account, []).append(min(later) / 60_000_000)
    found = {r.account: r.median_hold_min for r in velocity.median_hold(e, direct_pairs=direct_pairs).collect()}
    assert found == pytest.approx({k: median(v) for k, v in held.items()})


def test_hold_times_of_no_payments(spark):
    e = spark.createDataFrame([], "txn_id long, us long, src long, dst long, amount double, channel string, bank_src string, bank_dst string")
    assert velocity.median_hold(e, direct_pairs=0).count() == 0


@pytest.mark.parametrize("least", [0.25, 0.5, 0.8, 1.0])
def test_similar_sets_match_all_pairs(spark, least):
    rng = random.Random(3)
    sets = {k: {0} | {rng.randrange(12) for _ in range(rng.randrange(6))} for k in range(60)}  # all share an item, many are equal
    rows = [(k, x) for k, s in sets.items() for x in s] * 2
    classes = {}
    for k, s in sets.items():
        classes.setdefault(frozenset(s), []).append(k)
    named = [(min(m), len(m), s) for s, m in classes.items()]
    j = lambda s, t: len(s & t) / len(s | t)
    expected = {(a, b, n, m, round(j(s, t), 6)) for a, n, s in named for b, m, t in named if a < b and j(s, t) >= least}
    found = hits.similar_sets(spark.createDataFrame(rows, "account long, item long"), least)
    assert {tuple(r) for r in found.collect()} == expected
    assert found.count() == len(expected)
    assert hits.similar_sets(found.select(F.col("a").alias("account"), F.col("b").alias("item")).limit(0), least).count() == 0


def test_unrelated_sets_that_meet_are_not_moved(spark, monkeypatch):
    rng = random.Random(5)
    sets = {k: {rng.randrange(3000) for _ in range(60)} for k in range(300)}
    for k in range(0, 300, 10):  # similar to the next one, some just about
        sets[k + 1] = set(sorted(sets[k])[: rng.choice([24, 30, 45])]) | {rng.randrange(3000) for _ in range(30)}
    df = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "account long, item long")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.25 * len(sets[a] | sets[b])}
    moved = []
    plain = type(df).distinct
    monkeypatch.setattr(type(df), "distinct", lambda self: moved.append(self) or plain(self))
    assert {(r.a, r.b) for r in hits.similar_sets(df, 0.25).collect()} == want and len(want) >= 20
    assert moved[-1].columns == ["a", "b"] and plain(moved[-1]).count() <= 3 * len(want)
