import hashlib
import hmac
import json
import random

import numpy as np
import pytest
from ledger import at, edges
from pyspark.sql import functions as F

from ledgerlens.config import Settings
from ledgerlens.functions.scalars import hashed_account, number_text
from ledgerlens.operators import adversary, evidence, federation, fingerprint, hits, iforest, taint, velocity
from ledgerlens.plans import benchmark, datagen, pipeline, views
from ledgerlens.sources import ledger
from ledgerlens.streaming import alerts

# -- fingerprints and velocity -----------------------------------------------
def test_verdicts_cover_each_branch(spark):
    rows = [(1, 9, 0.5, 0.1, 0.1, 4), (2, 9, 0.5, 0.1, 0.1, 5), (5, 9, 2.0, 0.5, 0.95, 5), (5, 9, 2.0, 0.9, 0.95, 5), (5, 9, 2.0, 0.1, None, 5), (5, 9, 0.8, 0.1, None, 5)]
    df = spark.createDataFrame([(k, n, d, r, p, c) for k, (c, _, d, r, p, n) in enumerate(rows)], "account int, n_txns int, daily_volume_cv double, repeat_counterparty_ratio double, pass_through_ratio double, counterparty_diversity int")
    got = {r.account: r.rule for r in fingerprint.verdicts(df).collect()}
    assert got == {0: "thin", 1: "narrow", 2: "mule-like", 3: "steady", 4: "erratic", 5: "steady"}


def test_velocity_of_few_payments(spark):
    rows = [("A", "B", "1", 100, at()), ("B", "C", "2", 75, at(minutes=30)), ("B", "C", "3", 125, at(minutes=90)), ("X", "X", "4", 10, at())]
    v = {r.account: r for r in velocity.velocity_features(edges(spark, rows)).collect()}
    assert v["B"].median_hold_min == 30.0 and v["B"].peak_burst_rate == 2 and v["A"].txns_per_hour == 1.0 and v["X"].txn_count == 2
    assert v["A"].median_hold_min == -1.0 and v["A"].pass_through_ratio == 0.0
    assert velocity.burst_timeline(edges(spark, rows), "1 hour", "B").count() == 2


def test_isolation_forest_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(0)
    rows = [(k, *map(float, rng.normal(0, 1, 7))) for k in range(200)] + [(999, *[30.0] * 7)]
    df = spark.createDataFrame(rows, "account long, " + ", ".join(f"{f} double" for f in iforest.FEATURES))
    raw = iforest.anomaly(df)
    rank = {r.account: r.anomaly for r in iforest.percentile_rank(raw).collect()}
    assert rank[999] == 100.0 and len(rank) == 201 and min(rank.values()) == 0.0
    assert sorted(raw.collect()) == sorted(iforest.anomaly(df.repartition(5)).collect())


# -- taint -------------------------------------------------------------------
def plain_trace(rows, seed, depth, least):
    """Proportional tracing, one bundle after another: ``{path of payments: (taint, fraction)}``, rests by account, and what was dropped."""
    nodes, rests, dropped = {}, {}, 0.0
    by_id = {r[2]: r for r in rows}
    work = [((seed,), by_id[seed][3], 1.0)]
    while work:
        path, d, share = work.pop()
        nodes[path] = (round(d, 2), round(share, 4))
        _, holder, key, own, t = by_id[path[-1]]
        if d < least:
            dropped += d
            continue
        if len(path) > depth:
            rests[holder] = rests.get(holder, 0) + d
            continue
        clean = max(0.0, sum(a for s, x, k, a, u in rows if x == holder and u <= t and k != key) - sum(a for s, x, k, a, u in rows if s == holder and u < t))
        f, left, spent = d / (clean + d), d, 0.0
        for _, _, k, a, _ in sorted((r for r in rows if r[0] == holder and r[4] >= t), key=lambda r: (r[4], r[2])):
            if a <= 0:
                break
            part = max(0.0, min(a * f, d - f * spent))
            spent += a
            if part > 1e-9:
                work.append(((*path, k), part, part / a))
                left -= part
        if left > 1e-9:
            rests[holder] = rests.get(holder, 0) + left
    return nodes, {k: round(v, 2) for k, v in rests.items()}, round(dropped, 2)


@pytest.mark.parametrize("seed,depth,least", [(1, 3, 1.0), (2, 4, 25.0), (3, 1, 0.5), (4, 2, 10_000)])
def test_taint_matches_a_plain_trace(spark, seed, depth, least):
    r = random.Random(seed)
    rows = [(r.choice("abcde"), r.choice("abcde"), f"p{k:02d}", r.choice([0] + [10.25, 80, 300.5, 1200, 4000.75] * 4), at(hours=r.randint(0, 40))) for k in range(40)]
    first = max(rows[:15], key=lambda x: x[3])[2]
    t = taint.trace(edges(spark, rows), txn_id=first, max_depth=depth, min_taint=least)
    nodes, rests, dropped = plain_trace(rows, first, depth, least)
    assert {tuple(n.bundle): (n.taint, n.fraction) for n in t.nodes.collect()} == nodes
    assert {n.holder: n.amount for n in t.terminals.collect()} == pytest.approx(rests, abs=0.011)
    assert t.dropped.first().dropped == pytest.approx(dropped, abs=0.011)
    assert taint.totals(t).first().n_nodes == len(nodes) and taint.flow_links(t).count() <= len(nodes)


def test_taint_from_an_account(spark):
    rows = [("u", "v", "in", 640, at(hours=2)), ("v", "w", "on", 600, at(hours=3)), ("x", "v", "late", 5, at(hours=9))]
    e = edges(spark, rows)
    since = e.agg(F.min("us")).first()[0]
    assert {r.txn_id: r.taint for r in taint.trace(e, account="v", since_us=since).nodes.collect()} == {"in": 640.0, "on": 600.0}
    assert taint.trace(e, account="v", since_us=since + 10**12).nodes.count() == 0 and taint.trace(e, txn_id="unknown").nodes.count() == 0
    with pytest.raises(ValueError):
        taint.trace(e, account="v")


# -- evidence ----------------------------------------------------------------
@pytest.mark.parametrize("seed", [5, 6])
def test_evidence_chain_and_breaks(spark, seed):
    r = random.Random(seed)
    n = r.randint(5, 9)
    records = [(k, json.dumps({"amount": r.randrange(1, 10**6) / 4, "kind": "txn" if k else "case", "ref": f"X-{seed}-{k}"}, sort_keys=True, separators=(",", ":"))) for k in range(n)]
    links = evidence.chain(spark.createDataFrame([("R", *x) for x in records], "ring_id string, seq int, record string"))
    prev = "0" * 64
    for x in sorted(links.collect(), key=lambda x: x.seq):
        body = json.dumps({"record": json.loads(x.record), "prev": prev}, sort_keys=True, separators=(",", ":"))
        assert x.prev_hash == prev and x.hash == hashlib.sha256(body.encode()).hexdigest()
        prev = x.hash
    assert tuple(evidence.verify(links).first())[1:] == (True, None, prev)
    at_ = r.randrange(1, n - 1)
    tampered = links.withColumn("record", F.when(F.col("seq") == at_, F.lit("{}")).otherwise(F.col("record")))
    assert evidence.verify(tampered).first().broken_at == at_
    removed = links.where(F.col("seq") != at_).withColumn("seq", F.when(F.col("seq") > at_, F.col("seq") - 1).otherwise(F.col("seq")))
    assert evidence.verify(removed).first().broken_at == at_


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(1000.0,), (12345678.5,), (0.25,)], "x double").select(number_text(F.col("x")).alias("t"))
    assert [r.t for r in df.collect()] == [json.dumps(x) for x in (1000.0, 12345678.5, 0.25)]


# -- federation --------------------------------------------------------------
def test_pseudonyms_are_hmac(spark):
    for salt in ("s", "x" * 100):
        got = spark.createDataFrame([("BankA_0001",)], "a string").select(hashed_account(F.col("a"), salt)).first()[0]
        assert got == hmac.new(salt.encode(), b"BankA_0001", hashlib.sha256).hexdigest()[:16]


def test_stitching(spark):
    rows = [("A", "cycle", 0, 10, "h1"), ("B", "cycle", 10, 20, "h2"), ("C", "smurfing", 100, 110, "h2"), ("A", "mule_chain", 0, 5, "h9"), ("B", "smurfing", 500, 510, "h7"), ("B", "smurfing", 510, 520, "h8")]
    df = spark.createDataFrame([(*r, "<1k" if k else "10k-100k", f"s{k}", 0.0) for k, r in enumerate(rows)], "bank string, pattern_type string, start_us long, end_us long, hashed_id string, amount_bucket string, signal_id string, pattern_score double")
    found = federation.stitch(df)
    (case,) = found.cases.collect()
    assert sorted(r.hashed_id for r in federation.case_pseudonyms(found).collect()) == ["h1", "h2"] and case.n_accounts == 2
    assert case.banks == ["A", "B", "C"] and case.n_signals == 3 and case.amount_bucket == "10k-100k" and case.case_id == "FED-01"
    assert federation.stitch(df, min_banks=1).cases.count() == 3
    with pytest.raises(PermissionError):
        federation.reveal(df, "h1", " x ")


# -- evaluation and adversary ------------------------------------------------
def test_greedy_matching(spark):
    det = spark.createDataFrame([("cycle", "d1", ["a", "b", "c"]), ("cycle", "d2", ["a", "b"]), ("cycle", "d3", ["q", "r"])], "type string, ring_id string, accounts array<string>")
    truth = spark.createDataFrame([("cycle", "t1", ["a", "b", "c", "d"]), ("smurfing", "t2", ["z"])], "type string, ring_id string, truth_accounts array<string>")
    assert [(r.t, r.d, r.weight) for r in hits.match_rings(det, truth).collect()] == [("t1", "d1", 0.75)]
    got = {r.type: (r.tp, r.fp, r.fn, r.f1) for r in hits.prf(det, truth).collect()}
    assert got == {"cycle": (1, 2, 0, 0.5), "smurfing": (0, 0, 1, 0.0)}


def test_friction_and_grid():
    grid = adversary.default_grid()
    assert len(grid) == 32 and len(adversary.cap_grid(grid, 8)) == 8 and adversary.cap_grid(grid, None) == grid
    s = lambda d, n, c: adversary.Scheme(hop_delay_hours=d, n_splits=n, n_decoys=c)
    assert [round(adversary.friction(s(*x)), 2) for x in ((0, 1, 0), (0, 1, 20), (0, 4, 0), (6, 1, 0), (24, 1, 0), (48, 4, 20))] == [1.0, 1.17, 1.99, 2.98, 8.93, 18.02]
    assert len(adversary.lever_grid(24, 2, 5, 2)) == 4


def test_adversary_search(spark, tmp_path):
    e = edges(spark, [("BankA_0001", "BankA_0002", "x", 10, at(), "BankA", "BankA"), ("BankC_0001", "BankC_0002", "y", 10, at(), "BankC", "BankC")])
    suspects = spark.createDataFrame([("BankA_0001",), ("BankC_0001",)], "account string")
    r = adversary.run(e, suspects, "BankA_0001", "BankC_0001", grid=[adversary.Scheme(), adversary.Scheme(hop_delay_hours=6), adversary.Scheme(hop_delay_hours=24)])
    assert r.baseline_detected and r.friction_before == 2.98 and r.friction_after == 8.93 and r.hardened == {"chain_max_delay_min": 480, "chain_min_forward": 0.9}
    adversary.save_report(r, str(tmp_path / "report"))
    back = adversary.load_report(spark, str(tmp_path / "report"))
    assert [x.asDict() for x in back.frontier.collect()] == [x.asDict() for x in r.frontier.select(*back.frontier.columns).collect()] and adversary.report_rows(back)[-1] == adversary.report_rows(r)[-1]
    assert [x.detected for x in r.frontier.collect()] == [True, False, False] and views.cheapest_evaders(r.frontier).first().friction == 2.98


# -- sources, generator, whole run -------------------------------------------
def test_csv_round_trip(spark, tmp_path):
    e = edges(spark, [("A", "B", "t1", 10, at(), "BankA", "BankB"), ("B", "C", "t2", 9, at(minutes=1), "BankB", "BankB")])
    ledger.write_bank_files(e, str(tmp_path / "banks"))
    back = ledger.read_csv(spark, str(tmp_path / "banks/*"))
    assert sorted(map(tuple, back.select("txn_id", "us", "src", "dst", "amount").collect())) == sorted(map(tuple, e.select("txn_id", "us", "src", "dst", "amount").collect()))


@pytest.fixture(scope="module")
def run(spark):
    e, truth = datagen.generate(spark, 3, 0.2, 60, 2)
    return pipeline.detect(e), truth


def test_generated_rings_are_found(spark, run, tmp_path):
    d, truth = run
    (tmp_path / "truth.json").write_text(datagen.truth_json(truth))
    rings, decoys = ledger.read_ground_truth(spark, str(tmp_path / "truth.json"))
    assert rings.count() == 6 and decoys.count() == 7
    out = pipeline.evaluate(d, rings, decoys)
    recall = {(r.phase, r.type): r.recall for r in out["metrics"].collect()}
    assert recall["filtered", "smurfing"] == 1.0 and recall["unfiltered", "mule_chain"] >= 0.5
    assert benchmark.truth_frame(spark, truth).count() == 6
    assert out["decoys"].count() == 7 and out["counts"].first().truth == 6


def test_views(run):
    d, _ = run
    assert views.summary(d).first().rings == d.rings.count() > 0
    ring = d.rings.first()
    assert 0 <= ring.score <= 100 and ring.ring_id.split("-")[0] in ("CYCLE", "CHAIN", "SMURF")
    assert views.verify_ring(d, ring.ring_id).first().valid and views.ring_edges(d, ring.ring_id).count() >= len(ring.txn_ids)
    assert views.ring_nodes(d, ring.ring_id).count() >= len(ring.accounts)
    assert ring.ring_id in views.dossier_markdown(d, ring.ring_id)
    assert views.account_detail(d, ring.accounts[0]).count() == 1
    assert views.sparkline(views.ring_list(d)).count() == d.rings.count()


def test_lists_funnel_and_checked_traces(run):
    d, _ = run
    assert views.health(d).first().status == "ok"
    steps = [x.n for x in views.funnel(d).orderBy("step").collect()]
    assert steps == [d.edges.count(), d.accounts.count(), d.features.count(), d.scores.count(), d.rings.count()]
    rows = views.ring_list(d, order=["type", "score"], ascending=[True, False]).collect()
    assert [(x.type, -x.score, x.ring_id) for x in rows] == sorted((x.type, -x.score, x.ring_id) for x in rows) and len(rows) == d.rings.count()
    one = rows[0]
    assert one.ring_id in {x.ring_id for x in views.ring_list(d, bank=one.banks[0], text=one.ring_id[:4]).collect()}
    assert [x.ring_id for x in views.top_rings(d, 2).collect()] == [x.ring_id for x in sorted(rows, key=lambda x: (-x.score, x.ring_id))[:2]]
    payment = d.rings.first().txn_ids[0]
    assert views.trace_payment(d, payment, 2).nodes.count() >= 1
    for bad, error in (((payment, 0), ValueError), ((payment, 11), ValueError), (("none such", 3), KeyError)):
        with pytest.raises(error):
            views.trace_payment(d, *bad)


def test_bootstrap_makes_files_once(spark, tmp_path):
    path = str(tmp_path / "data")
    files = datagen.bootstrap(spark, path, 5, 0.1, 50)
    n = ledger.read_csv(spark, files).count()
    before = sorted(p.stat().st_mtime_ns for p in (tmp_path / "data").rglob("part-*"))
    assert datagen.bootstrap(spark, path, 6, 0.1, 50) == files and ledger.read_csv(spark, files).count() == n > 0
    assert before == sorted(p.stat().st_mtime_ns for p in (tmp_path / "data").rglob("part-*"))


def test_case_members(spark):
    rows = [("A", "cycle", 0, 10, "h1"), ("B", "cycle", 5, 20, "h2"), ("C", "smurfing", 90, 95, "h9")]
    df = spark.createDataFrame([(*x, "<1k", f"s{k}", 0.0) for k, x in enumerate(rows)], "bank string, pattern_type string, start_us long, end_us long, hashed_id string, amount_bucket string, signal_id string, pattern_score double")
    assert sorted((x.case_id, x.signal_id) for x in federation.stitch(df).members.collect()) == [("FED-01", "s0"), ("FED-01", "s1")]


def test_benchmark_aggregation(spark):
    runs = spark.createDataFrame([(1, 0.5, "cycle", 1.0, 0.5, 0.6), (2, 0.5, "cycle", 0.5, 0.5, 0.5), (1, 1.0, "cycle", 0.0, 0.0, 0.0)], "seed int, noise double, type string, precision double, recall double, f1 double")
    got = {(r.noise, r.type): r for r in benchmark.aggregate(runs).collect()}
    assert got[0.5, "cycle"].precision_mean == 0.75 and got[1.0, "cycle"].precision_std == 0.0 and got[None, "cycle"].runs == 3
    assert "cycle" in benchmark.render_markdown(benchmark.aggregate(runs))


def test_streams(spark, tmp_path):
    rows = [("A", "B", f"t{k}", 100, at(minutes=5 * k)) for k in range(6)] + [("B", "C", "h", 95, at(minutes=40)), ("Z", "Z", "late", 1, at(days=3))]
    e = edges(spark, rows)
    e.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for n, (f, least) in enumerate(((alerts.burst_alerts, 1), (alerts.sessions, 1), (alerts.chain_hops, 6))):
        q = f(stream()).writeStream.format("memory").queryName(f"out{n}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{n}")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.sql(f"select * from out{n}").count() >= least


def test_settings_read_the_environment(monkeypatch):
    monkeypatch.setenv("FEDERATION_SALT", "other")
    assert Settings().salt == "other"
