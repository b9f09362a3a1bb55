"""Running totals of hot groups: dealt out over ranges, equal to windows and to plain searches."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledger import at, edges
from ledgerlens.operators import federation, hits, scan, smurfing, taint, velocity


@pytest.fixture
def dealt(spark, monkeypatch):
    """Every scan by ranges, over 16 partitions that stay as small as they are."""
    monkeypatch.setattr(scan, "PLAIN_ROWS", 0)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("key", [[], ["k"], ["k", "j"]])
def test_running_totals_are_those_of_windows(spark, dealt, key):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 9 + ["a", None]), rng.randrange(2), rng.randrange(300), rng.choice([None, *range(-5, 9)])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, k string, j int, t int, v int")
    totals = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("sum", F.lit(1))}
    for flags, order, w in (
        ({"peers": True}, ["t"], W.partitionBy(*key).orderBy("t").rangeBetween(W.unboundedPreceding, 0)),
        ({}, ["t", "id"], W.partitionBy(*key).orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)),
        ({"before": True}, ["t", "id"], W.partitionBy(*key).orderBy("t", "id").rowsBetween(W.unboundedPreceding, -1)),
    ):
        want = df.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w), "n": F.sum(F.lit(1)).over(w)})
        got = scan.running(df, key, order, totals, **flags)
        assert got.schema == want.schema or [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
        assert sorted(scan.running(df, key, order, totals, plain=True, **flags).collect(), key=str) == sorted(want.collect(), key=str)
    assert scan.running(df.limit(0), key, ["t"], totals, peers=True).count() == 0


def test_one_group_lies_in_many_ranges(spark, dealt, monkeypatch):
    written = []
    keep = scan.Staging.write

    def write(self, df):
        written.append(keep(self, df))
        return written[-1]

    monkeypatch.setattr(scan.Staging, "write", write)
    df = spark.range(8000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    out = scan.running(df, ["k"], ["t"], {"n": ("sum", F.lit(1))})
    assert out.where("n = t + 1").count() == 8000
    sizes = [r["count"] for r in written[0].groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1200


def hot_ledger(spark, seed, n=400):
    """One account has a side in every payment; equal times are common."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        other = f"p{rng.randrange(30)}"
        into = rng.random() < 0.7
        rows.append((other if into else "hot", "hot" if into else other, f"t{k:04d}", rng.choice([9500, 9900, 8200, 5000, 7000, 12000]), at(minutes=15 * rng.randrange(400))))
    return edges(spark, rows)


def test_detectors_and_taint_over_one_account_with_all_payments(spark, dealt, monkeypatch):
    e = hot_ledger(spark, 3)

    def results():
        bundles = e.where("dst = 'hot'").select(F.col("txn_id").alias("bundle"), F.col("dst").alias("holder"), F.col("us").alias("at"), F.col("amount").alias("own"))
        traced = taint.trace(e, txn_id=e.where("dst = 'hot'").orderBy("us", "txn_id").first().txn_id, max_depth=4)
        frames = [smurfing.windows(e), smurfing.detect_smurfing(e), velocity.peak_burst_rate(e), taint.clean_pool(e, bundles, scan.is_small(e)), traced.nodes, traced.terminals]
        return [sorted((tuple(r) for r in f.collect()), key=str) for f in frames]

    by_ranges = results()
    monkeypatch.setattr(scan, "PLAIN_ROWS", 1 << 20)
    assert by_ranges == results() and all(by_ranges)
    times = {}
    for r in e.collect():
        for a in (r.src, r.dst):
            times.setdefault(a, []).append(r.us)
    peak = {a: max(sum(t - 3_600_000_000 <= u <= t for u in ts) for t in ts) for a, ts in times.items()}
    assert dict(by_ranges[2]) == peak


def test_islands_of_one_hot_type(spark, dealt):
    rng = random.Random(4)
    rows = [(f"s{k}", rng.choice(["cycle"] * 9 + ["smurfing"]), a := rng.randrange(0, 40_000, 5), a + rng.choice([0, 3, 5, 20, 400])) for k in range(900)]
    df = spark.createDataFrame(rows, "signal_id string, pattern_type string, start_us long, end_us long")
    want, island, reach, last = {}, 0, None, None
    for s, kind, a, b in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind != last:
            island, reach = 1, b
        elif a > reach:
            island, reach = island + 1, b
        reach, last = max(reach, b), kind
        want[s] = island
    got = federation.islands(df)
    assert {r.signal_id: r.island for r in got.collect()} == want
    assert "pattern_type" not in [w.strip() for line in got._jdf.queryExecution().toString().splitlines() if "Window" in line for w in line.split("[")[-1].split(",")]


def test_greedy_matching_in_rounds_is_the_sorted_pass(spark):
    rng = random.Random(5)
    member = lambda: sorted(rng.sample(range(12), rng.randrange(2, 7)))
    for _ in range(3):
        det = [(rng.choice(["cycle", "chain"]), f"d{k:02d}", [str(x) for x in member()]) for k in range(40)]
        tru = [(rng.choice(["cycle", "chain"]), f"t{k:02d}", [str(x) for x in member()]) for k in range(40)]
        detected = spark.createDataFrame(det, "type string, ring_id string, accounts array<string>")
        truth = spark.createDataFrame(tru, "type string, ring_id string, truth_accounts array<string>")
        pairs = sorted((r.type, r.weight, r.t, r.d) for r in hits.candidate_matches(detected, truth).collect())
        taken, used = set(), set()
        for kind, w, t, d in reversed(pairs):
            if not {(kind, t), (kind, d)} & used:
                used |= {(kind, t), (kind, d)}
                taken.add((kind, w, t, d))
        assert {(r.type, r.weight, r.t, r.d) for r in hits.match_rings(detected, truth).collect()} == taken
