"""Account and ring scores with reasons, from pattern evidence and anomaly percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent, rounded

#: Points of membership.
CYCLE, CHAIN_MIDDLE, CHAIN_END, COLLECTOR, DEPOSITOR = 40.0, 30.0, 20.0, 55.0, 25.0


def evidence(hits: DataFrame) -> DataFrame:
    """``account, points, reason, hit_id``: one row per hit and role. The consolidating receiver of a fan-in gets none."""
    member = hits.select("*", F.posexplode("accounts").alias("pos", "account"))
    middle = (F.col("pos") > 0) & (F.col("pos") < F.size("accounts") - 1)
    depositor = F.array_contains("depositors", F.col("account"))
    points = (
        F.when(F.col("type") == "cycle", CYCLE)
        .when((F.col("type") == "mule_chain") & middle, CHAIN_MIDDLE)
        .when(F.col("type") == "mule_chain", CHAIN_END)
        .when(F.col("account") == F.col("collector"), F.when(depositor, COLLECTOR + DEPOSITOR).otherwise(COLLECTOR))
        .when(depositor, DEPOSITOR)
    )
    reason = (
        F.when(F.col("type") == "cycle", F.concat(F.lit("in a loop of "), F.col("length").cast("string"), F.lit(" hops that brings back "), percent(F.col("retention"))))
        .when((F.col("type") == "mule_chain") & middle, F.concat(F.lit("passes funds on in a chain of "), F.col("length").cast("string"), F.lit(" hops, "), percent(F.col("retention")), F.lit(" kept")))
        .when(F.col("type") == "mule_chain", F.concat(F.lit("end of a pass-through chain of "), F.col("length").cast("string"), F.lit(" hops")))
        .when(F.col("account") == F.col("collector"), F.concat(F.lit("collects "), F.col("n_deposits").cast("string"), F.lit(" deposits below the threshold, "), percent(F.col("structuring_score")), F.lit(" just below")))
        .otherwise(F.lit("deposits just below the threshold with a collector"))
    )
    return member.select("account", points.alias("points"), reason.alias("reason"), "hit_id", "type").where("points is not null")


def pattern_scores(hits: DataFrame) -> DataFrame:
    """``account, pattern_score`` (capped at 100) ``, reasons`` in order of type and hit."""
    order = F.array_sort(F.collect_list(F.struct("type", "hit_id", "reason")))
    return evidence(hits).groupBy("account").agg(F.least(F.lit(100.0), F.sum("points")).alias("pattern_score"), F.transform(order, lambda s: s["reason"]).alias("reasons"))


def account_scores(scored: DataFrame, patterns: DataFrame, anomaly: DataFrame, features: DataFrame) -> DataFrame:
    """Each account of ``scored``: ``0.6 pattern + 0.4 anomaly``, capped at 100 and rounded to 1, with reasons and velocity."""
    ps, ano, ptr = F.coalesce("pattern_score", F.lit(0.0)), F.col("anomaly"), F.col("pass_through_ratio")
    none = F.array().cast("array<string>")
    more = F.array_compact(F.array(F.when(ano >= 90, F.format_string("unusual velocity (anomaly %.0f of 100): %.0f payments, %.0f in an hour", F.rint(ano), F.col("txn_count"), F.col("peak_burst_rate"))), F.when(ptr > 0.9, F.concat(F.lit("passes on "), percent(ptr)))))
    reasons = F.concat(F.coalesce("reasons", none), more)
    return (
        scored.select("account").join(features, "account").join(anomaly, "account").join(patterns, "account", "left")
        .select(
            "account", rounded(F.least(F.lit(100.0), 0.6 * ps + 0.4 * ano), 1).alias("score"), rounded(ps, 1).alias("pattern_score"), rounded(ano, 1).alias("anomaly_score"),
            F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("velocity outlier without a pattern"))).alias("reasons"), F.struct(*[c for c in features.columns if c != "account"]).alias("velocity"),
        )
    )


def ring_scores(hits: DataFrame, scores: DataFrame, repeats: bool = False) -> DataFrame:
    """Hits with ``score``: half the highest member score, 0.3 of the mean member anomaly, 20, and a bonus by type; unscored members don't count.

    ``repeats``: an account that is in a hit twice (a payment to itself) counts twice in the mean.
    """
    names = F.col("accounts") if repeats else F.array_distinct("accounts")
    member = hits.select("hit_id", F.explode(names).alias("account")).join(scores.select("account", F.col("score").alias("s"), F.col("anomaly_score").alias("a")), "account")
    # Added as decimals: a mean of doubles depends on their order, and a score at the edge of two roundings with it.
    agg = member.groupBy("hit_id").agg(F.max("s").alias("top"), (F.sum(F.col("a").cast("decimal(20,9)")).cast("double") / F.count("a")).alias("mean"))
    bonus = F.when(F.col("type") == "smurfing", 10 * F.col("structuring_score")).when(F.col("type") == "cycle", 100 * (1 - F.col("retention"))).otherwise(10 * F.least(F.col("retention"), F.lit(1.0)))
    raw = 0.5 * F.coalesce("top", F.lit(0.0)) + 0.3 * F.coalesce("mean", F.lit(0.0)) + 20 + bonus
    return hits.join(agg, "hit_id", "left").withColumn("score", rounded(F.least(F.lit(100.0), raw), 1)).drop("top", "mean")


def rings(scored_hits: DataFrame, accounts: DataFrame) -> DataFrame:
    """``ring_id`` by type in order of dedup rank, sorted distinct banks, amount; by score, highest first."""
    prefix = F.when(F.col("type") == "cycle", "CYCLE").when(F.col("type") == "mule_chain", "CHAIN").otherwise("SMURF")
    banks = scored_hits.select("hit_id", F.explode(F.array_distinct("accounts")).alias("account")).join(accounts, "account").groupBy("hit_id").agg(F.array_sort(F.collect_set("bank")).alias("banks"))
    amount = F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in ("total_amount", "amount_in", "amount_start")], F.lit(0.0))
    # dedup_rank counts the kept hits of a type from 1 on, so it is a ring's number.
    return scored_hits.withColumn("ring_id", F.format_string("%s-%02d", prefix, F.col("dedup_rank"))).withColumn("amount", amount).join(banks, "hit_id", "left").orderBy(F.desc("score"), "ring_id")
