"""Many ledgers judged in one job are judged as each is alone; traces of many roots and case tables of all rings likewise."""

from pyspark.sql import functions as F

from ledger import at, edges
from ledgerlens.operators import iforest, taint
from ledgerlens.plans import benchmark, datagen


def test_runs_in_one_job_are_the_runs_alone(spark):
    made = {f"r{seed}": datagen.generate(spark, seed, 0.1, 40, 1) for seed in (3, 4)}
    ledgers = [e.select(F.lit(run).alias("run"), "*") for run, (e, _) in made.items()]
    truths = [benchmark.truth_frame(spark, t).select(F.lit(run).alias("run"), "*") for run, (_, t) in made.items()]
    decoys = [spark.createDataFrame([(x["account"], x["label"]) for x in t["decoys"]], "account string, label string").select(F.lit(run).alias("run"), "*") for run, (_, t) in made.items()]
    both = benchmark.judge_runs(ledgers[0].unionByName(ledgers[1]), truths[0].unionByName(truths[1]), decoys[0].unionByName(decoys[1]))
    alone = benchmark.judge_runs(ledgers[0], truths[0], decoys[0])
    got = sorted(map(tuple, both.quality.where("run = 'r3'").collect()))
    assert got == sorted(map(tuple, alone.quality.collect())) and {r[1] for r in got} == {"filtered", "unfiltered", "scored", "without_forest"}
    counts = both.counts.collect()
    assert [tuple(r) for r in counts if r.run == "r3"] == [tuple(r) for r in alone.counts.collect()] and {r.run for r in counts} == {"r3", "r4"}


def test_forests_of_parts_are_those_of_each_part(spark):
    rows = [(f"{p}|{k}", p, *[float((k * 7 + j * 3 + ord(p)) % 23) for j in range(7)]) for p in "ab" for k in range(90)]
    df = spark.createDataFrame(rows, "account string, run string, " + ", ".join(f"{c} double" for c in iforest.FEATURES))
    rank = lambda d, **x: {r.account: r.anomaly for r in iforest.percentile_rank(iforest.anomaly(d, trees=20, sample=32, **x), **x).collect()}
    whole = rank(df, part=("run",))
    assert whole == rank(df.where("run = 'a'")) | rank(df.where("run = 'b'")) and len(whole) == 180


def test_traces_of_many_roots_are_the_traces_of_each(spark):
    rows = [("z", "a", "c1", 300, at(minutes=-50)), ("s", "a", "t1", 1000, at()), ("a", "b", "t2", 600, at(minutes=10)), ("a", "c", "t3", 500, at(minutes=20)), ("b", "c", "t4", 450, at(minutes=30)), ("c", "d", "t5", 900, at(minutes=40)), ("s", "c", "t6", 200, at(minutes=35))]
    e = edges(spark, rows)
    roots = ["t1", "t6", "t1", "none such"]
    many = taint.trace_roots(e, spark.createDataFrame([(r,) for r in roots], "txn_id string"), 5, 20.0)
    for r in {"t1", "t6"}:
        one = taint.trace(e, txn_id=r, max_depth=5, min_taint=20.0)
        assert sorted(map(str, many.nodes.where(F.col("root") == r).drop("root").collect())) == sorted(map(str, one.nodes.collect()))
        assert {(x.holder, x.amount) for x in many.terminals.where(F.col("root") == r).collect()} == {(x.holder, x.amount) for x in one.terminals.collect()}
    assert {x.root for x in many.nodes.collect()} == {"t1", "t6"}
    inflows = {r.dst: r.txn_id for r in taint.first_inflows(e, e.where("txn_id = 't3'").first().us).collect()}
    assert inflows == {"c": "t3", "d": "t5"}
