"""Velocity features: bursts, hold times, pass-through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import HOUR, MINUTE, money
from ..session import Staging
from .graph import endpoints
from .scan import is_small, running

#: Pairs of an inflow and an outflow of one account that are compared without a search by time.
DIRECT_PAIRS = 1 << 22


def txns_per_hour(e: DataFrame) -> DataFrame:
    span = (F.max("us") - F.min("us")) / HOUR
    rate = F.when(F.count("*") < 2, F.count("*").cast("double")).otherwise((F.count("*") - 1) / F.greatest(span, F.lit(1.0)))
    return endpoints(e).groupBy("account").agg(F.count("*").alias("txn_count"), rate.alias("txns_per_hour"))


def peak_burst_rate(e: DataFrame, window_min: int = 60) -> DataFrame:
    """Most payments of an account in any closed trailing window.

    Each payment adds one from its time on and takes it off once windows begin after it,
    so the most is that of running sums, linear in the payments and without a frame per row.
    """
    span = int(window_min * MINUTE)
    events = endpoints(e).select("account", F.inline(F.array(F.struct(F.col("us").alias("at"), F.lit(1).alias("n")), F.struct((F.col("us") + span + 1).alias("at"), F.lit(-1).alias("n")))))
    there = running(events, ["account"], ["at"], {"c": ("sum", F.col("n"))}, peers=True, plain=is_small(e))
    return there.groupBy("account").agg(F.max("c").alias("peak_burst_rate"))


def median_hold(e: DataFrame, band: float = 0.25, direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """``account, median_hold_min``: for each inflow the first strictly later outflow within the band of its amount; accounts with none are absent.

    An account's inflows meet all its outflows while these are at most ``direct_pairs``
    pairs. Those of busier accounts are searched nearest first (``_nearest_first``).
    """
    into = e.select(F.col("dst").alias("account"), "txn_id", F.col("us").alias("t"), F.col("amount").alias("a"))
    out = e.select(F.col("src").alias("account"), F.col("us").alias("u"), F.col("amount").alias("b"))
    met = F.count_if(F.col("direction") == "in") * F.count_if(F.col("direction") == "out")
    staging = Staging(e.sparkSession, "hold")
    busy = staging.write(endpoints(e).groupBy("account").agg(met.alias("pairs")).where(F.col("pairs") > direct_pairs).select("account"))
    if busy.limit(1).count():
        searched = _nearest_first(into.join(busy, "account", "left_semi"), out.join(busy, "account", "left_semi"), band, staging)
        held = _first_match(into.join(busy, "account", "left_anti").join(out, "account"), band).unionByName(searched)
    else:
        held = _first_match(into.join(out, "account"), band)
    return held.groupBy("account").agg(F.median(F.col("h") / MINUTE).alias("median_hold_min"))


def _first_match(pairs: DataFrame, band: float) -> DataFrame:
    near = (F.col("b") >= F.col("a") * (1 - band)) & (F.col("b") <= F.col("a") * (1 + band))
    return pairs.where((F.col("u") > F.col("t")) & near).groupBy("account", "txn_id").agg((F.min("u") - F.first("t")).alias("h"))


def _nearest_first(into: DataFrame, out: DataFrame, band: float, staging: Staging) -> DataFrame:
    """First matches ``account, txn_id, h``, looked for within a minute and then in horizons 16 times as long.

    A match within a horizon is the first of all, so only inflows without one go on:
    a busy account's inflows meet the few outflows around them, not all. Joins are on
    (account, slot of the horizon's length), which also deals one account out.
    """
    left, right = staging.write(into), staging.write(out)
    ends = left.agg(F.min("t")).first()[0], right.agg(F.max("u")).first()[0]
    found, horizon = left.select("account", "txn_id", F.col("t").alias("h")).limit(0), MINUTE
    while ends[0] is not None and ends[1] is not None:
        slot = lambda c, n=horizon: F.expr(f"{c} div {n}")
        probes = left.withColumn("slot", F.explode(F.array(slot("t"), slot("t") + 1)))
        pairs = probes.join(right.withColumn("slot", slot("u")), ["account", "slot"]).where(F.col("u") - F.col("t") <= horizon)
        hit = staging.write(_first_match(pairs, band))
        found = found.unionByName(hit)
        left = staging.write(left.join(hit, ["account", "txn_id"], "left_anti"))
        if horizon > ends[1] - ends[0] or not left.limit(1).count():
            break
        horizon *= 16
    return found


def flows(e: DataFrame) -> DataFrame:
    """Inflow mean and maximum, and the ratio of what goes out to what comes in."""
    act = endpoints(e).withColumn("m", money(F.col("amount")))
    into, out = F.sum(F.when(F.col("direction") == "in", F.col("m"))).cast("double"), F.sum(F.when(F.col("direction") == "out", F.col("m"))).cast("double")
    return act.groupBy("account").agg(
        F.when(into > 0, F.coalesce(out, F.lit(0.0)) / into).alias("pass_through_ratio"),
        (into / F.count_if(F.col("direction") == "in")).alias("amount_mean"),
        F.max(F.when(F.col("direction") == "in", F.col("amount"))).alias("amount_max"),
    )


def velocity_features(e: DataFrame) -> DataFrame:
    """The seven features; a null pass-through ratio is 0, a null hold time -1, missing inflows 0."""
    return (
        txns_per_hour(e)
        .join(peak_burst_rate(e), "account")
        .join(flows(e), "account")
        .join(median_hold(e), "account", "left")
        .select("account", F.col("txn_count").cast("double").alias("txn_count"), "txns_per_hour", F.col("peak_burst_rate").cast("double").alias("peak_burst_rate"), F.coalesce("pass_through_ratio", F.lit(0.0)).alias("pass_through_ratio"), F.coalesce("median_hold_min", F.lit(-1.0)).alias("median_hold_min"), F.coalesce("amount_mean", F.lit(0.0)).alias("amount_mean"), F.coalesce("amount_max", F.lit(0.0)).alias("amount_max"))
    )


def chain_velocity(e: DataFrame, chains: DataFrame) -> DataFrame:
    """For each ``chains(chain_id, accounts)``: median and total minutes between its accounts' first inflow and first outflow after it."""
    member = chains.select("chain_id", F.explode("accounts").alias("account"))
    first_in = e.groupBy(F.col("dst").alias("account")).agg(F.min("us").alias("t"))
    first_out = e.groupBy(F.col("src").alias("account")).agg(F.min("us").alias("u"))
    delay = member.join(first_in, "account").join(first_out, "account").where("u >= t").select("chain_id", ((F.col("u") - F.col("t")) / MINUTE).alias("d"))
    return delay.groupBy("chain_id").agg(F.median("d").alias("median_delay_min"), F.sum("d").alias("total_delay_min"), F.count("*").alias("n"))


def burst_timeline(e: DataFrame, bucket: str = "6 hours", account=None) -> DataFrame:
    """Payments of each account (or one) in tumbling buckets anchored at midnight; empty buckets are left out."""
    act = e.select(F.col("src").alias("account"), "ts").unionByName(e.select(F.col("dst").alias("account"), "ts"))
    if account is not None:
        act = act.where(F.col("account") == F.lit(account))
    return act.groupBy("account", F.window("ts", bucket)["start"].alias("bucket")).agg(F.count("*").alias("n"))
