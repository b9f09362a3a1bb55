import random
from dataclasses import replace

import pytest
from ledger import at, edges

from ledgerlens.config import DEFAULTS
from ledgerlens.operators.chains import detect_chains
from ledgerlens.operators.cycles import detect_cycles
from ledgerlens.operators.hits import all_hits, dedup_hits
from ledgerlens.operators.smurfing import detect_smurfing, windows

WHEEL = [("M", "N", "w1", 700, at(days=1)), ("N", "O", "w2", 690.2, at(days=1, hours=5)), ("O", "P", "w3", 660, at(days=2)), ("P", "M", "w4", 644, at(days=3, hours=6))]
RELAY = [("K1", "K2", "r1", 5000, at(hours=1)), ("K2", "K3", "r2", 4400, at(hours=1, minutes=7)), ("K3", "K4", "r3", 4000, at(hours=1, minutes=126)), ("K4", "K5", "r4", 3999, at(hours=1, minutes=128))]


def payers(n, amount, gap_hours):
    return [(f"Q{k}", "HUB", f"q{k:02d}", amount(k), at(hours=gap_hours * k)) for k in range(n)]


def test_a_wheel_of_four(spark):
    (h,) = detect_cycles(edges(spark, WHEEL)).collect()
    assert h.accounts == list("MNOP") and h.origin == "M" and h.retention == 0.92 and h.length == 3 and h.txn_ids == ["w1", "w2", "w3", "w4"] and h.window_hours == 54.0


@pytest.mark.parametrize("change", [{3: (644, at(days=4, minutes=1))}, {3: (594.9, at(days=3))}, {2: (705, at(days=2)), 3: (700, at(days=3))}, {1: (690.2, at(hours=23))}])
def test_wheels_that_do_not_count(spark, change):
    """Closed after 72 hours, with less than 85 %, with a hop that grows over 2 %, or with a hop back in time."""
    rows = [(s, d, k, *change.get(n, (a, t))) for n, (s, d, k, a, t) in enumerate(WHEEL)]
    assert detect_cycles(edges(spark, rows)).count() == 0


def test_only_the_first_hop_bounds_the_closing_one(spark):
    early = [*WHEEL[:3], ("P", "M", "w4", 644, at(days=1, hours=4))]
    assert [h.accounts for h in detect_cycles(edges(spark, early)).collect()] == [list("MNOP")]


def test_a_relay_of_five(spark):
    h, *parts = sorted(detect_chains(edges(spark, RELAY)).collect(), key=lambda h: -h.length)
    assert sorted(p.accounts for p in parts) == [["K1", "K2", "K3", "K4"], ["K2", "K3", "K4", "K5"]]
    assert h.accounts == ["K1", "K2", "K3", "K4", "K5"] and h.length == 4 and h.retention == 0.7998 and h.total_delay_min == 128.0 and h.hop_delays_min == [7.0, 119.0, 2.0] and h.terminal == "K5"


@pytest.mark.parametrize("change", [{1: (4249, at(hours=1, minutes=7)), 3: (100, at(hours=4))}, {2: (4000, at(hours=3, minutes=8)), 3: (10, at(hours=9))}])
def test_relays_that_break(spark, change):
    """A hop that forwards under 85 %, and one that waits over two hours, with too few hops left."""
    rows = [(s, d, k, *change.get(n, (a, t))) for n, (s, d, k, a, t) in enumerate(RELAY)]
    assert detect_chains(edges(spark, rows)).count() == 0


def test_chain_frontier_limit(spark):
    assert detect_chains(edges(spark, RELAY), max_frontier=0).count() == 0


def test_a_hub_of_fifteen(spark):
    rows = [*payers(15, lambda k: 8200 + 120 * k, 7), ("HUB", "SINK", "all", 60_000, at(days=5))]
    (h,) = detect_smurfing(edges(spark, rows)).collect()
    assert h.collector == "HUB" and h.n_contributors == h.n_deposits == 15 and h.structuring_score == round(15 / 15, 3) and h.total_amount == 15 * 8200 + 120 * 105 and h.consolidation_txn == "all" and "SINK" in h.accounts and h.window_days == 4.08


@pytest.mark.parametrize("rows", [payers(14, lambda k: 10_000, 2), payers(9, lambda k: 9000, 2), payers(20, lambda k: 9000, 24), [(f"Q{k % 9}", "HUB", f"q{k:02d}", 9000, at(hours=k)) for k in range(30)]])
def test_hubs_that_do_not_count(spark, rows):
    """At the threshold, too few, too slow, and too few payers."""
    assert detect_smurfing(edges(spark, rows)).count() == 0


def test_consolidation_follows_first_payment_order(spark):
    rows = [("HUB", "KNOWN", "z", 7, at(days=-2)), *payers(12, lambda k: 9100, 4), ("HUB", "FRESH", "n", 70_000, at(days=2)), ("HUB", "KNOWN", "o", 70_000, at(days=4))]
    assert detect_smurfing(edges(spark, rows)).first().consolidation_txn == "o"


@pytest.mark.parametrize("seed", [3, 4])
def test_windows_match_a_plain_count(spark, seed):
    r = random.Random(seed)
    th = replace(DEFAULTS, smurf_min_deposits=3, smurf_window_days=1)
    rows = [(r.choice("abcdef"), r.choice("XY"), f"t{k:03d}", r.choice([4000, 5000, 8000, 9000, 9960, 10_000]), at(hours=r.randint(0, 90))) for k in range(120)]
    ok = [x for x in rows if 5000 <= x[3] < 10_000]
    want = {}
    for _, d, k, _, t in ok:
        inside = [x for x in ok if x[1] == d and 0 <= (t - x[4]).total_seconds() <= 86400]
        if len(inside) >= 3 and len({x[0] for x in inside}) >= 3:
            want[k] = (len(inside), len({x[0] for x in inside}), float(sum(x[3] for x in inside)), round(sum(8000 <= x[3] <= 9950 for x in inside) / len(inside), 9))
    got = {w.txn_id: (w.n, w.contributors, float(w.total), round(w.score, 9)) for w in windows(edges(spark, rows), None, th).collect()}
    assert got == want and want


def plain_cycles(rows, th=DEFAULTS):
    best = {}
    w = th.cycle_window_hours * 3600

    def walk(path, ids, times, amounts):
        for s, d, k, a, t in rows:
            if s != path[-1] or a > amounts[-1] * 1.02 or (t - times[0]).total_seconds() > w:
                continue
            if d == path[0] and (t - times[0]).total_seconds() >= 0 and a / amounts[0] >= th.cycle_min_retention:
                cand = (-a / amounts[0], times[0], ids + [k])
                key = frozenset(path)
                best[key] = min(best.get(key, cand), cand)
            elif d not in path and t >= times[-1] and len(path) < th.cycle_max_len:
                walk(path + [d], ids + [k], times + [t], amounts + [a])

    for s, d, k, a, t in rows:
        if s != d:
            walk([s, d], [k], [t], [a])
    return {k: v[2] for k, v in best.items()}


def plain_chains(rows, th=DEFAULTS):
    best = {}

    def walk(path, ids, times, amounts):
        if len(ids) >= 3:
            cand = (-len(path), times[0], ids)
            key = frozenset(path)
            best[key] = min(best.get(key, cand), cand)
        for s, d, k, a, t in rows:
            if s == path[-1] and d not in path and 0 <= (t - times[-1]).total_seconds() <= th.chain_max_delay_min * 60 and a >= amounts[-1] * th.chain_min_forward:
                walk(path + [d], ids + [k], times + [t], amounts + [a])

    for s, d, k, a, t in rows:
        walk([s, d], [k], [t], [a])
    return {k: v[2] for k, v in best.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_match_a_plain_search(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ABCDEFG"), r.choice("ABCDEFG"), f"t{k:02d}", r.choice([90, 95, 98, 100]), at(minutes=30 * r.randint(0, 30))) for k in range(45)]
    got = {frozenset(h.accounts): h.txn_ids for h in detect_cycles(edges(spark, rows)).collect()}
    assert got == plain_cycles(rows)
    got = {frozenset(h.accounts): h.txn_ids for h in detect_chains(edges(spark, rows)).collect()}
    assert got == plain_chains(rows)


def test_dedup_containment(spark):
    e = edges(spark, RELAY + [("X", "Y", "u1", 50, at()), ("Y", "Z", "u2", 50, at(minutes=1)), ("Z", "W", "u3", 50, at(minutes=2))])
    kept = dedup_hits(all_hits(e)).collect()
    assert sorted(sorted(h.accounts) for h in kept) == [["K1", "K2", "K3", "K4", "K5"], list("WXYZ")]
    assert {h.dedup_rank for h in kept} == {1, 2}


@pytest.mark.parametrize("pool", [9, 40])
def test_dedup_matches_a_greedy_pass(spark, pool):
    r = random.Random(pool)
    rows = [(r.choice(["cycle", "smurfing"]), f"h{k:03d}", r.sample(range(pool), r.randint(2, 8)), r.randint(0, 4), r.choice([None, 10, 11])) for k in range(150)]
    df = spark.createDataFrame(rows, "type string, hit_id string, accounts array<long>, start_us long, n_deposits int")
    want = {}
    for kind in ("cycle", "smurfing"):
        kept = []
        for _, h, acc, _, _ in sorted((x for x in rows if x[0] == kind), key=lambda x: (-10 * len(x[2]) - (x[4] or 0), sorted(map(str, x[2])), x[3], x[1])):
            if not any(len(set(acc) & k) >= 0.8 * len(acc) for k in kept):
                kept.append(set(acc))
                want[h] = len(kept)
    assert {x.hit_id: x.dedup_rank for x in dedup_hits(df).collect()} == want


def test_thresholds_are_arguments(spark):
    assert detect_chains(edges(spark, RELAY), th=replace(DEFAULTS, chain_min_forward=0.99)).count() == 0
