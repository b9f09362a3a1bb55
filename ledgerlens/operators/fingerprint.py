"""Business-rhythm fingerprints and the benign filter, in two aggregations a key and no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import DEFAULTS, Thresholds
from ..functions.scalars import DAY, money, percent, rounded
from .graph import endpoints

DAYS = 90


def fingerprints(e: DataFrame) -> DataFrame:
    """One row per account with its 12 fields; ratios are rounded to 3 decimals, volume CV is over 24-hour days since the first activity, zero-filled to 90."""
    act = endpoints(e)
    pairs = act.groupBy("account", "cp").agg(F.count("*").alias("c"), F.sum(F.when(F.col("direction") == "in", money(F.col("amount")))).alias("i"), F.sum(F.when(F.col("direction") == "out", money(F.col("amount")))).alias("o"))
    zero = F.lit(0).cast("decimal(18,2)")
    base = pairs.groupBy("account").agg(
        F.sum("c").alias("n_txns"),
        F.count("*").alias("counterparty_diversity"),
        rounded(F.sum(F.when(F.col("c") >= 2, F.col("c")).otherwise(0)) / F.sum("c"), 3).alias("repeat_counterparty_ratio"),
        rounded(F.sum(F.when(F.col("c") >= 3, F.col("c")).otherwise(0)) / F.sum("c"), 3).alias("periodic_fraction"),
        F.coalesce(F.sum("i"), zero).cast("double").alias("in_sum"),
        F.coalesce(F.sum("o"), zero).cast("double").alias("out_sum"),
    )
    gap = F.col("us") - F.lag("us").over(W.partitionBy("account").orderBy("us", "txn_id"))
    into = act.where("direction = 'in'").select("account", (gap / 1e6).alias("gap")).groupBy("account").agg(F.count("*").alias("n"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
    cv_in = into.select("account", rounded(F.when((F.col("n") < 3) | (F.col("m") == 0), 1.0).otherwise(F.col("s") / F.col("m")), 3).alias("cv_inter_arrival"))
    first = act.groupBy("account").agg(F.min("us").alias("t0"))
    per_day = act.join(first, "account").groupBy("account", F.expr(f"(us - t0) div {DAY}").alias("day")).agg(F.count("*").alias("c"))
    length = F.greatest(F.lit(DAYS), F.max("day") + 1)
    daily = per_day.groupBy("account").agg(rounded(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("c") * F.col("c")) / length - F.pow(F.sum("c") / length, 2))) / (F.sum("c") / length), 3).alias("daily_volume_cv"))
    ptr = F.when(F.col("in_sum") > 0, rounded(F.col("out_sum") / F.col("in_sum"), 3))
    ior = F.when((F.col("in_sum") > 0) & (F.col("out_sum") > 0), rounded(F.col("in_sum") / F.col("out_sum"), 3))
    return (
        base.join(cv_in, "account", "left")
        .join(daily, "account")
        .select(
            "account", "n_txns", "counterparty_diversity", F.coalesce("cv_inter_arrival", F.lit(1.0)).alias("cv_inter_arrival"), "daily_volume_cv", "repeat_counterparty_ratio", "periodic_fraction", ptr.alias("pass_through_ratio"), ior.alias("in_out_ratio"), rounded("in_sum", 2).alias("in_sum"), rounded("out_sum", 2).alias("out_sum")
        )
    )


def verdicts(fp: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Fingerprints with ``benign`` and ``reason``: an ordered decision list on the rounded values."""
    mule = (F.col("pass_through_ratio") > 0.9) & (F.col("repeat_counterparty_ratio") < 0.8)
    steady = (F.col("daily_volume_cv") <= 0.8) | (F.col("repeat_counterparty_ratio") >= 0.3)
    rule = (
        F.when(F.col("n_txns") < th.benign_min_txns, "thin")
        .when(F.col("counterparty_diversity") < 5, "narrow")
        .when(F.coalesce(mule, F.lit(False)), "mule-like")
        .when(~steady, "erratic")
        .otherwise("steady")
    )
    reason = (
        F.when(F.col("rule") == "thin", F.concat(F.lit("too little history: "), F.col("n_txns").cast("string"), F.lit(" payments")))
        .when(F.col("rule") == "narrow", F.concat(F.lit("few counterparties: "), F.col("counterparty_diversity").cast("string")))
        .when(F.col("rule") == "mule-like", F.concat(F.lit("passes on "), percent(F.col("pass_through_ratio")), F.lit(" through one-off relations")))
        .when(F.col("rule") == "erratic", F.concat(F.lit("uneven activity: daily variation "), F.col("daily_volume_cv").cast("string")))
        .otherwise(F.concat(F.lit("steady business with "), F.col("counterparty_diversity").cast("string"), F.lit(" counterparties")))
    )
    return fp.withColumn("rule", rule).withColumn("benign", F.col("rule") == "steady").withColumn("reason", reason)


def suspects(v: DataFrame) -> DataFrame:
    return v.where(~F.col("benign")).select("account")


def filter_counts(v: DataFrame) -> DataFrame:
    benign = F.count_if(F.col("benign"))
    return v.agg(F.count("*").alias("total"), benign.alias("benign"), (F.count("*") - benign).alias("suspect"))


def decoy_check(decoys: DataFrame, v: DataFrame) -> DataFrame:
    """Each known look-alike with whether the filter clears it; false if it has no payment."""
    return decoys.join(v.select("account", "benign"), "account", "left").withColumn("benign", F.coalesce("benign", F.lit(False)))
