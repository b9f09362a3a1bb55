"""The semi-naive search against whole searches, and reports kept by content."""

import random

import pytest
from pyspark.sql import functions as F

from ledger import at, edges
from ledgerlens.config import DEFAULTS
from ledgerlens.operators import adversary, delta, hits


def sets(found, part="scheme_id"):
    return {(r[part], r.type, tuple(sorted(set(r.accounts)))): tuple(r.txn_ids) for r in found.collect()}


def ledger_and_seeds(spark, seed, n=160, accounts=9):
    rng = random.Random(seed)
    name = lambda: f"a{rng.randrange(accounts)}"
    rows = [(name(), name(), f"t{k:04d}", rng.choice([8200, 9000, 9000, 8800, 9900, 9300, 0]), at(minutes=rng.randrange(0, 60 * 30, 5))) for k in range(n)]
    given = [(s, name() if rng.random() < 0.7 else f"ADV_{s}", name() if rng.random() < 0.7 else f"ADV_{s}", f"z{s}_{k}", rng.choice([9000, 9100, 8700]), at(minutes=rng.randrange(0, 60 * 30, 5))) for s in range(3) for k in range(5)]
    seeds = edges(spark, [g[1:] for g in given]).withColumn("scheme_id", F.regexp_extract("txn_id", r"z(\d)", 1).cast("int"))
    return edges(spark, rows), seeds


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hits_with_seeds_are_those_of_whole_searches(spark, tmp_path, seed):
    e, seeds = ledger_and_seeds(spark, seed)
    allowed = spark.createDataFrame([(f"a{k}",) for k in range(8)], "account string")
    ids = spark.createDataFrame([(k,) for k in range(3)], "scheme_id int")
    more = ids.select("scheme_id", F.concat(F.lit("ADV_"), F.col("scheme_id").cast("string")).alias("account"))
    every = allowed.crossJoin(ids).select("scheme_id", "account").unionByName(more)
    whole = e.crossJoin(ids).select("scheme_id", *e.columns).unionByName(seeds.select("scheme_id", *e.columns))
    whole.write.parquet(f"{tmp_path}/whole")
    every.write.parquet(f"{tmp_path}/every")
    plain = sets(hits.all_hits(spark.read.parquet(f"{tmp_path}/whole"), spark.read.parquet(f"{tmp_path}/every"), DEFAULTS, ("scheme_id",)))
    before = set(sets(hits.all_hits(e, allowed, DEFAULTS).withColumn("scheme_id", F.lit(0))))
    got = sets(delta.hits_with(e, seeds, allowed, more))
    new = {k: v for k, v in plain.items() if (0, *k[1:]) not in before}
    assert new and {k: v for k, v in got.items() if k in new} == new
    # What else it gives is a hit of the ledger too, through other payments or of a collector that was touched.
    assert set(got) <= set(plain)
    assert {k[1] for k in new} >= {"cycle", "mule_chain"}


def test_fan_ins_that_a_seed_completes_or_drains(spark):
    rows = [(f"p{k}", c, f"{c}{k}", 9500.0, at(hours=3 * k)) for c in ("full", "short", "far") for k in range(12 if c != "short" else 9)] + [("full", "exit", "out", 10.0, at(days=3))]
    e = edges(spark, rows)
    seeds = edges(spark, [("q", "short", "s1", 9000.0, at(hours=30)), ("full", "ADV_1", "s2", 90_000.0, at(days=3)), ("q", "nobody", "s3", 9000.0, at())]).withColumn("scheme_id", F.lit(7))
    allowed = spark.createDataFrame([("full",), ("short",), ("far",)], "account string")
    found = {r.collector: r for r in delta.hits_with(e, seeds, allowed, allowed.where("false").select(F.lit(7).alias("scheme_id"), "account")).collect()}
    assert set(found) == {"full", "short"}
    assert found["short"].n_deposits == 10 and found["full"].consolidation_to == "ADV_1" and "ADV_1" in found["full"].accounts


def test_no_seeds_and_no_ledger(spark):
    e, seeds = ledger_and_seeds(spark, 5, n=20)
    allowed = spark.createDataFrame([(f"a{k}",) for k in range(9)], "account string")
    none = allowed.where("false").select(F.lit(0).alias("scheme_id"), "account")
    assert delta.hits_with(e, seeds.limit(0), allowed, none).count() == 0
    lone = delta.hits_with(e.limit(0), seeds, allowed, none)
    assert set(sets(lone)) == set(sets(hits.all_hits(seeds, allowed.crossJoin(seeds.select("scheme_id").distinct()), DEFAULTS, ("scheme_id",))))


def report(spark, n):
    table = adversary.friction_table(adversary.scheme_grid_table(spark, adversary.default_grid()[:n])).withColumn("evidence", F.lit("x")).withColumn("detected", F.lit(True))
    return adversary.Report(True, table, 2.0, 3.0, {}, n)


def test_reports_are_kept_by_content(spark, tmp_path):
    e, _ = ledger_and_seeds(spark, 6, n=30)
    e.repartition(3).write.parquet(f"{tmp_path}/one")
    read = lambda: spark.read.parquet(f"{tmp_path}/one")
    first = adversary.manifest({"amount": 1}, ledger=read())
    assert first == adversary.manifest({"amount": 1}, ledger=e.orderBy("amount")) != adversary.manifest({"amount": 2}, ledger=e)
    made = []

    def kept(about, n):
        return adversary.kept_report(spark, f"{tmp_path}/kept", about, lambda: made.append(n) or report(spark, n))

    assert kept(first, 4).frontier.count() == kept(first, 9).frontier.count() == 4 and made == [4]
    e.union(e.limit(1)).write.mode("overwrite").parquet(f"{tmp_path}/one")
    second = adversary.manifest({"amount": 1}, ledger=read())
    assert second != first and kept(second, 5).frontier.count() == 5 and kept(first, 9).frontier.count() == 4 and made == [4, 5]
    changed = e.withColumn("amount", F.when(F.col("txn_id") == "t0003", 1.0).otherwise(F.col("amount")))
    assert adversary.manifest({"amount": 1}, ledger=changed) != first


def test_one_search_at_a_time(spark, tmp_path):
    folder = f"{tmp_path}/kept"

    def nested():
        with pytest.raises(adversary.SearchRunning):
            adversary.kept_report(spark, folder, "other", lambda: report(spark, 1))
        return report(spark, 2)

    assert adversary.kept_report(spark, folder, "this", nested).frontier.count() == 2

    def fails():
        raise KeyError("broken")

    with pytest.raises(KeyError):
        adversary.kept_report(spark, folder, "third", fails)
    assert adversary.kept_report(spark, folder, "third", lambda: report(spark, 3)).frontier.count() == 3
