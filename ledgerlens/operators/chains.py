"""Rapid pass-through chains: path growth level by level until none grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import DEFAULTS, Thresholds
from ..functions.scalars import MINUTE, rounded
from ..session import Staging
from .graph import induced


def detect_chains(e: DataFrame, allowed: DataFrame | None = None, th: Thresholds = DEFAULTS, part: tuple[str, ...] = (), max_frontier: int | None = None) -> DataFrame:
    """One row per set of accounts (a self-loop adds none) of a chain of at least ``chain_min_length`` hops (ties: earliest start, then transaction ids).

    Every payment is a seed (a self-loop too); each next hop leaves the last account
    within the delay, to an account not yet on the path, with at least the forwarded
    share. A path meets only payments in the two time slots, as long as the delay, that
    can hold its next hop, so a busy account is dealt out over time. ``max_frontier``: stop, without that level, once a level is larger.
    """
    staging = Staging(e.sparkSession, "chains")
    return staging.keep(chain_hits(chain_paths(e, allowed, th, part, max_frontier, staging), list(part)))


def chain_paths(e: DataFrame, allowed: DataFrame | None = None, th: Thresholds = DEFAULTS, part: tuple[str, ...] = (), max_frontier: int | None = None, staging: Staging | None = None) -> DataFrame:
    """All chains that ``detect_chains`` picks from, ``path, tail, times, amounts, txns``; several of a set of accounts."""
    part_ = list(part)
    staging = staging or Staging(e.sparkSession, "chains")
    delay = int(th.chain_max_delay_min * MINUTE)
    narrow = staging.write(induced(e, allowed, part_).select(*part_, "src", "dst", "us", "amount", "txn_id"))
    step = narrow.select(*part_, F.col("src").alias("tail"), F.col("dst").alias("e_dst"), F.col("us").alias("e_us"), F.col("amount").alias("e_amount"), F.col("txn_id").alias("e_txn"), F.expr(f"us div {delay + 1}").alias("slot"))
    paths = narrow.select(*part_, F.array("src", "dst").alias("path"), F.col("dst").alias("tail"), F.array("us").alias("times"), F.array("amount").alias("amounts"), F.array("txn_id").alias("txns"))
    found: DataFrame | None = None
    hops = 1
    while True:
        last_t, last_a = F.element_at("times", -1), F.element_at("amounts", -1)
        first = F.expr(f"element_at(times, -1) div {delay + 1}")
        met = paths.withColumn("slot", F.explode(F.array(first, first + 1))).join(step, [*part_, "tail", "slot"]).where((F.col("e_us") - last_t).between(0, delay) & (F.col("e_amount") >= last_a * th.chain_min_forward) & ~F.array_contains("path", F.col("e_dst")))
        grown = met.select(*part_, F.concat("path", F.array("e_dst")).alias("path"), F.col("e_dst").alias("tail"), F.concat("times", F.array("e_us")).alias("times"), F.concat("amounts", F.array("e_amount")).alias("amounts"), F.concat("txns", F.array("e_txn")).alias("txns"))
        paths = staging.write(grown)
        hops += 1
        n = paths.count() if max_frontier is not None else paths.limit(1).count()
        if not n or max_frontier is not None and n > max_frontier:
            break
        if hops >= th.chain_min_length:
            found = paths if found is None else found.unionByName(paths)
    return found if found is not None else paths.where("false")


def chain_hits(paths: DataFrame, part: list[str]) -> DataFrame:
    """The best chain of each account set, from ``path, times, amounts, txns``."""
    best = F.row_number().over(W.partitionBy(*part, "members").orderBy(F.desc(F.size("path")), F.col("times")[0], "txns"))
    ranked = paths.withColumn("members", F.array_sort(F.array_distinct("path"))).withColumn("best", best).where("best = 1")
    t0, t1, a0, a1 = F.col("times")[0], F.element_at("times", -1), F.col("amounts")[0], F.element_at("amounts", -1)
    gaps = F.transform(F.sequence(F.lit(1), F.size("times") - 1), lambda i: rounded((F.col("times")[i] - F.col("times")[i - 1]) / MINUTE, 1))
    return ranked.select(
        *part, F.lit("mule_chain").alias("type"), F.col("path").alias("accounts"), F.col("path")[0].alias("origin"), F.element_at("path", -1).alias("terminal"),
        F.col("txns").alias("txn_ids"), t0.alias("start_us"), t1.alias("end_us"), F.size("times").alias("length"), rounded((t1 - t0) / MINUTE, 1).alias("total_delay_min"),
        rounded(a0, 2).alias("amount_in"), rounded(a1, 2).alias("amount_out"), F.when(a0 != 0, rounded(a1 / a0, 4)).otherwise(0.0).alias("retention"), gaps.alias("hop_delays_min"),
    )
