"""Ordinary traffic: the rates of each role, and that draws depend on nothing but their keys."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import datagen


@pytest.fixture(scope="module")
def traffic(spark):
    return datagen.ordinary_traffic(spark, 42).withColumn("kind", F.substring("txn_id", 4, 1)).cache()


def test_rates_by_role(spark, traffic):
    n = {r.kind: r["count"] for r in traffic.groupBy("kind").count().collect()}
    roles = datagen.account_roles(spark)
    shops = roles.where("role = 'shop'").count()
    assert shops == 75 and abs(n["S"] / (shops * datagen.DAYS) - 6.5 * 0.95) < 1.5  # 2 to 11 a day, popularity 0.4 to 1.5
    assert n["E"] == 24 * 30 and n["X"] == 80 * 9 and abs(n["P"] - 3 * 40 * 90 * 0.25) < 250
    assert abs(n["U"] / (9 * 90) - 9.5) < 0.6 and 4 * 18 * 3 <= n["L"] <= 11 * 18 * 3
    assert 24 * 30 * 3 <= n["W"] <= 24 * 69 * 3 and n["H"] == 24 * 3
    assert traffic.count() == traffic.select("txn_id").distinct().count()


def test_amounts_channels_and_hours(traffic):
    shop = traffic.where("kind = 'S'")
    share = {r.channel: r["count"] / shop.count() for r in shop.groupBy("channel").count().collect()}
    assert {k: round(v, 1) for k, v in share.items()} == {"card": 0.5, "transfer": 0.3, "cash": 0.2, "wire": 0.1} or abs(share["cash"] - 0.15) < 0.01 and abs(share["wire"] - 0.05) < 0.01
    log = shop.agg(F.avg(F.log("amount")), F.stddev(F.log("amount")), F.max("amount")).first()
    assert abs(log[0] - 3.2) < 0.03 and abs(log[1] - 0.9) < 0.03 and log[2] <= 4000
    hours = shop.agg(F.min(F.substring("timestamp", 12, 5)), F.max(F.substring("timestamp", 12, 5))).first()
    assert "08:00" <= hours[0] and hours[1] < "22:00"
    popular = [r["count"] for r in shop.groupBy("dst_account").count().collect()]
    assert max(popular) > 5 * min(popular)


def test_wages_revenue_rent_and_pairs(traffic):
    wages = traffic.where("kind = 'W'").groupBy(F.col("src_account").alias("e"), F.substring("timestamp", 1, 7)).agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("s")).groupBy("e").agg(F.sum("s").alias("s"))
    paid_in = traffic.where("kind = 'H'").groupBy(F.col("dst_account").alias("e")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).alias("h"))
    assert wages.join(paid_in, "e").where("s <> h").count() == 0 and wages.count() == 24
    rent = traffic.where("kind = 'L'").groupBy(F.substring_index("txn_id", "-", 4).alias("t")).agg(F.countDistinct("amount").alias("a"), F.countDistinct("src_account").alias("p"), F.count("*").alias("n"))
    assert rent.where("a <> 1 or p <> 1 or n <> 3").count() == 0
    pairs = traffic.where("kind = 'P'").select("src_account", "dst_account").distinct()
    assert pairs.count() <= 120 and pairs.where("src_account = dst_account").count() == 0
    assert traffic.where("kind = 'X' and bank_src = bank_dst").count() == 0 and traffic.where("kind <> 'X' and bank_src <> bank_dst").count() == 0


def test_draws_depend_on_their_keys_alone(spark, traffic):
    again = datagen.ordinary_traffic(spark, 42).repartition(7)
    assert again.exceptAll(traffic.drop("kind")).count() == 0
    assert datagen.ordinary_traffic(spark, 43).join(traffic.select("txn_id", "amount"), ["txn_id", "amount"], "left_semi").count() < 500
    less = datagen.ordinary_traffic(spark, 42, 0.5, 60)
    assert less.where("dst_account > 'BankC_0060'").count() == 0 and 0.3 < less.where("txn_id like 'TXNS%'").count() / traffic.where("kind = 'S'").count() < 0.7
