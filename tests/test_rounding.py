"""Numbers and their texts are rounded as SQL rounds them; ring scores don't depend on an order."""

from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import percent, rounded
from ledgerlens.operators import scoring

EDGES = [1.005, 2.675, 0.285, 57.349999999999994, 97.44999999999999, 82.14999999999999, 0.00125, 0.8645, 0.865, 1.405, 45.145, 337.625, 0.005, -1.005, -2.5, 0.0, 0.49999999999999994, 12345678.905]


def test_percents_are_those_of_sql(spark):
    df = spark.createDataFrame([(x,) for x in EDGES], "x double")
    want = [duckdb.execute("SELECT printf('%.0f%%', ?::DOUBLE * 100)", [x]).fetchone()[0] for x in EDGES]
    assert [r[0] for r in df.select(percent(F.col("x"))).collect()] == want and want[EDGES.index(0.865)] == "86%"


def test_doubles_are_rounded_as_in_sql(spark):
    df = spark.createDataFrame([(x,) for x in EDGES], "x double")
    for places in (1, 2, 3, 4, 6):
        want = [duckdb.execute(f"SELECT round(?::DOUBLE, {places})", [x]).fetchone()[0] for x in EDGES]
        assert [r[0] for r in df.select(rounded("x", places)).collect()] == want


def _chains(spark, accounts):
    return spark.createDataFrame([("h", "mule_chain", accounts, 1.0, None)], "hit_id string, type string, accounts array<string>, retention double, structuring_score double")


def test_ring_scores_round_alike_in_any_order(spark):
    # The mean is 32.0 and the score 45.35; added as doubles, some orders give a sum just below.
    of = {"a": 93.2, "b": 21.9, "c": 8.1, "d": 4.8}
    table = spark.createDataFrame([(k, 11.5, x) for k, x in of.items()], "account string, score double, anomaly_score double")
    rows = [(f"h{n}", "mule_chain", list(p), 1.0, None) for n, p in enumerate(permutations(of))]
    hits = spark.createDataFrame(rows, "hit_id string, type string, accounts array<string>, retention double, structuring_score double")
    assert {r.score for r in scoring.ring_scores(hits, table).collect()} == {45.4}


def test_an_account_that_is_in_a_hit_twice(spark):
    table = spark.createDataFrame([("a", 10.0, 0.0), ("b", 10.0, 60.0)], "account string, score double, anomaly_score double")
    hit = _chains(spark, ["a", "a", "b"])
    assert scoring.ring_scores(hit, table).first().score == 44.0  # 5 + 0.3 x 30 + 20 + 10
    assert scoring.ring_scores(hit, table, repeats=True).first().score == 41.0  # 5 + 0.3 x 20 + 20 + 10
