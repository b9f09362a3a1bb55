"""Semi-naive search: the hits that hold at least one of some given payments, without a search of the ledger.

Given payments (``seeds``) are keyed by ``part``, so that many variants of a ledger are
searched at once; the ledger itself has no key, is shared by all of them and is never
copied. A path that holds a seed has a first one. It is grown from there: ahead over
payments of the ledger and of its own part, then backwards over the ledger alone. So each
path is made once, and work grows with what seeds touch, not with ledger x variants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.scalars import HOUR, MINUTE
from ..session import Staging, at_once
from .chains import chain_hits
from .cycles import cycle_hits
from .graph import induced
from .hits import as_hits
from .smurfing import detect_smurfing

NARROW = ["src", "dst", "us", "amount", "txn_id"]


def _next(payments: DataFrame, key: list[str], width: int) -> DataFrame:
    """Payments as hops that leave ``tail``, in their time slot."""
    return payments.select(*key, F.col("src").alias("tail"), F.col("dst").alias("e_dst"), F.col("us").alias("e_us"), F.col("amount").alias("e_amount"), F.col("txn_id").alias("e_txn"), F.expr(f"us div {width}").alias("slot"))


def _last(payments: DataFrame, width: int) -> DataFrame:
    """Payments as hops that reach ``head``, in their time slot."""
    return payments.select(F.col("dst").alias("head"), F.col("src").alias("e_src"), F.col("us").alias("e_us"), F.col("amount").alias("e_amount"), F.col("txn_id").alias("e_txn"), F.expr(f"us div {width}").alias("slot"))


def _slots(paths: DataFrame, at: Column, width: int, step: int) -> DataFrame:
    first = F.call_function("div", at, F.lit(width))
    return paths.withColumn("slot", F.explode(F.array(first, first + step)))


def _levels(staging: Staging, start: DataFrame, grow: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """``start`` and all that grows from it, level by level, each a written table."""
    level = every = start
    while most is None or most > 0:
        level = staging.write(grow(level))
        if level.isEmpty():
            break
        every, most = every.unionByName(level), None if most is None else most - 1
    return every


def chains_with(ledger: DataFrame, seeds: DataFrame, th: Thresholds, part: list[str]) -> DataFrame:
    """Pass-through chains (see ``detect_chains``) that hold a seed; both tables hold payments between allowed accounts only."""
    staging = Staging(ledger.sparkSession, "delta-chains")
    delay = int(th.chain_max_delay_min * MINUTE)
    width = delay + 1
    shared, own, before = _next(ledger, [], width), _next(seeds, part, width), _last(ledger, width)
    columns = ["path", "times", "amounts", "txns"]
    fits_on = (F.col("e_us") - F.element_at("times", -1)).between(0, delay) & (F.col("e_amount") >= F.element_at("amounts", -1) * th.chain_min_forward) & ~F.array_contains("path", F.col("e_dst"))
    # A self-loop can only be a chain's first hop.
    fits_before = (F.col("times")[0] - F.col("e_us")).between(0, delay) & (F.col("amounts")[0] >= F.col("e_amount") * th.chain_min_forward) & (F.col("path")[0] != F.col("path")[1]) & ~F.array_contains(F.slice("path", F.lit(2), F.size("path")), F.col("e_src"))

    def ahead(paths: DataFrame) -> DataFrame:
        tails = _slots(paths.withColumn("tail", F.element_at("path", -1)), F.element_at("times", -1), width, 1)
        new = [F.concat("path", F.array("e_dst")), F.concat("times", F.array("e_us")), F.concat("amounts", F.array("e_amount")), F.concat("txns", F.array("e_txn"))]
        take = lambda met: met.where(fits_on).select(*part, *[c.alias(n) for c, n in zip(new, columns)])
        return take(tails.join(shared, ["tail", "slot"])).unionByName(take(tails.join(own, [*part, "tail", "slot"])))

    def behind(paths: DataFrame) -> DataFrame:
        heads = _slots(paths.withColumn("head", F.col("path")[0]), F.col("times")[0], width, -1)
        new = [F.concat(F.array("e_src"), "path"), F.concat(F.array("e_us"), "times"), F.concat(F.array("e_amount"), "amounts"), F.concat(F.array("e_txn"), "txns")]
        return heads.join(before, ["head", "slot"]).where(fits_before).select(*part, *[c.alias(n) for c, n in zip(new, columns)])

    start = seeds.select(*part, F.array("src", "dst").alias("path"), F.array("us").alias("times"), F.array("amount").alias("amounts"), F.array("txn_id").alias("txns"))
    every = _levels(staging, _levels(staging, start, ahead), behind)
    return staging.keep(chain_hits(every.where(F.size("txns") >= th.chain_min_length), part))


def cycles_with(ledger: DataFrame, seeds: DataFrame, th: Thresholds, part: list[str]) -> DataFrame:
    """Money cycles (see ``detect_cycles``) that hold a seed, on the way or as the closing payment."""
    staging = Staging(ledger.sparkSession, "delta-cycles")
    window, growth, most = int(th.cycle_window_hours * HOUR), th.cycle_growth, th.cycle_max_len
    width = window + 1
    ledger, seeds = ledger.where("src <> dst"), seeds.where("src <> dst")
    shared, own, before = _next(ledger, [], width), _next(seeds, part, width), _last(ledger, width)
    slack = max(1.0, growth) ** (most - 1) * (1 + 1e-9)  # by how much an amount may grow over a whole loop, and a shade for rounding
    columns = ["path", "t0", "t", "a0", "a", "txns"]

    def ahead(paths: DataFrame) -> DataFrame:
        tails = _slots(paths.withColumn("tail", F.element_at("path", -1)), F.col("t0"), width, 1)
        fits = (F.col("e_us") >= F.col("t")) & (F.col("e_us") - F.col("t0") <= window) & (F.col("e_amount") <= F.col("a") * growth) & ~F.array_contains("path", F.col("e_dst"))
        fits &= F.col("e_amount") * slack >= F.col("a0") * th.cycle_min_retention
        new = [F.concat("path", F.array("e_dst")), F.col("t0"), F.col("e_us"), F.col("a0"), F.col("e_amount"), F.concat("txns", F.array("e_txn"))]
        take = lambda met: met.where(fits).select(*part, *[c.alias(n) for c, n in zip(new, columns)])
        return take(tails.join(shared, ["tail", "slot"])).unionByName(take(tails.join(own, [*part, "tail", "slot"])))

    def behind(paths: DataFrame) -> DataFrame:
        heads = _slots(paths.where(F.size("path") < most).withColumn("head", F.col("path")[0]), F.col("t0"), width, -1)
        fits = (F.col("e_us") <= F.col("t0")) & (F.col("t") - F.col("e_us") <= window) & (F.col("a0") <= F.col("e_amount") * growth) & ~F.array_contains("path", F.col("e_src"))
        # All hops ahead are there: what comes back is at most a little more than the last of them.
        fits &= F.col("a") * growth * (1 + 1e-9) >= F.col("e_amount") * th.cycle_min_retention
        new = [F.concat(F.array("e_src"), "path"), F.col("e_us"), F.col("t"), F.col("e_amount"), F.col("a"), F.concat(F.array("e_txn"), "txns")]
        return heads.join(before, ["head", "slot"]).where(fits).select(*part, *[c.alias(n) for c, n in zip(new, columns)])

    start = seeds.select(*part, F.array("src", "dst").alias("path"), F.col("us").alias("t0"), F.col("us").alias("t"), F.col("amount").alias("a0"), F.col("amount").alias("a"), F.array("txn_id").alias("txns"))
    every = _levels(staging, _levels(staging, start, ahead, most - 2), behind, most - 2).where("a0 <> 0")
    ends = every.withColumn("tail", F.element_at("path", -1)).withColumn("origin", F.col("path")[0])
    back = (F.col("e_us") >= F.col("t0")) & (F.col("e_us") - F.col("t0") <= window) & (F.col("e_amount") <= F.col("a") * growth) & (F.col("e_amount") / F.col("a0") >= th.cycle_min_retention)
    found = ["path", "txns", "t0", "a0", "e_us", "e_amount", "e_txn"]
    closed = [ends.join(s.withColumnRenamed("e_dst", "origin"), [*key, "tail", "origin"]).where(back).select(*part, *found) for s, key in ((shared, []), (own, part))]

    # Loops whose only seed is the closing payment: from where it leads, over the ledger, to where it comes from.
    seed = seeds.join(ledger.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select(*part, F.col("src").alias("goal"), F.col("dst").alias("tail"), F.col("us").alias("c_us"), F.col("amount").alias("c_amount"), F.col("txn_id").alias("c_txn"))
    keep = ["goal", "c_us", "c_amount", "c_txn"]
    first = _slots(seed, F.col("c_us"), width, -1).join(shared, ["tail", "slot"])
    enough = F.col("e_amount") * slack >= F.col("c_amount")
    first = first.where((F.col("c_us") - F.col("e_us")).between(0, window) & (F.col("e_amount") != 0) & enough & (F.col("c_amount") / F.col("e_amount") >= th.cycle_min_retention))
    first = first.select(*part, *keep, F.array("tail", "e_dst").alias("path"), F.col("e_us").alias("t0"), F.col("e_us").alias("t"), F.col("e_amount").alias("a0"), F.col("e_amount").alias("a"), F.array("e_txn").alias("txns"))

    def onward(paths: DataFrame) -> DataFrame:
        tails = _slots(paths.withColumn("tail", F.element_at("path", -1)).where(F.col("tail") != F.col("goal")), F.col("t0"), width, 1)
        fits = (F.col("e_us") >= F.col("t")) & (F.col("e_us") - F.col("t0") <= window) & (F.col("e_amount") <= F.col("a") * growth) & ~F.array_contains("path", F.col("e_dst")) & enough
        new = [F.concat("path", F.array("e_dst")), F.col("t0"), F.col("e_us"), F.col("a0"), F.col("e_amount"), F.concat("txns", F.array("e_txn"))]
        return tails.join(shared, ["tail", "slot"]).where(fits).select(*part, *keep, *[c.alias(n) for c, n in zip(new, columns)])

    reached = _levels(staging, staging.write(first), onward, most - 2).where((F.element_at("path", -1) == F.col("goal")) & (F.col("c_amount") <= F.col("a") * growth))
    closed.append(reached.select(*part, "path", "txns", "t0", "a0", F.col("c_us").alias("e_us"), F.col("c_amount").alias("e_amount"), F.col("c_txn").alias("e_txn")))
    return staging.keep(cycle_hits(closed[0].unionByName(closed[1]).unionByName(closed[2]), part))


def smurfing_with(e: DataFrame, seeds: DataFrame, allowed: DataFrame, th: Thresholds, part: list[str]) -> DataFrame:
    """Fan-ins (see ``detect_smurfing``) of collectors that a seed is a deposit to or a payment of, each part with its own seeds.

    Only the histories of such collectors that can have enough deposits are read, once a
    part that touches them. ``allowed(part, account)`` are the collectors to look at.
    """
    staging = Staging(e.sparkSession, "delta-smurfing")
    small = (F.col("amount") >= th.reporting * 0.5) & (F.col("amount") < th.reporting)
    touched = seeds.select(*part, F.col("src").alias("account"), F.lit(0).alias("n")).unionByName(seeds.select(*part, F.col("dst").alias("account"), F.when(small, 1).otherwise(0).alias("n")).where("n = 1"))
    touched = touched.groupBy(*part, "account").agg(F.sum("n").alias("n")).join(allowed, [*part, "account"], "left_semi")
    there = e.where(small).join(touched.select(F.col("account").alias("dst")).distinct(), "dst", "left_semi").groupBy(F.col("dst").alias("account")).agg(F.count("*").alias("m"))
    likely = staging.write(touched.join(there, "account", "left").where(F.col("n") + F.coalesce("m", F.lit(0)) >= th.smurf_min_deposits).select(*part, "account"))
    narrow = e.select(*NARROW)
    into = narrow.where(small).join(likely.withColumnRenamed("account", "dst"), "dst")
    out = narrow.join(likely.withColumnRenamed("account", "src"), "src")
    both = into.select(*part, *NARROW).unionByName(out.select(*part, *NARROW)).dropDuplicates([*part, "txn_id"]).unionByName(seeds.select(*part, *NARROW))
    return staging.write(detect_smurfing(both, likely, th, tuple(part)))


def hits_with(e: DataFrame, seeds: DataFrame, allowed: DataFrame, more: DataFrame, th: Thresholds = DEFAULTS, part: tuple[str, ...] = ("scheme_id",)) -> DataFrame:
    """All hits that hold a seed, keyed by ``part``, as ``all_hits`` gives them for the ledger with each part's seeds added.

    ``allowed(account)``: accounts that hits may run through in every part; ``more(part,
    account)``: further ones. Fan-ins are those of collectors that a seed touches. Seeds
    must not be among the rows of ``e``.
    """
    staging, part_ = Staging(e.sparkSession, "delta"), list(part)
    ledger = staging.write(induced(e, allowed).select(*NARROW))
    seeds = staging.write(seeds.select(*part_, *NARROW))
    ends = ends_of(seeds, part_)
    every = staging.write(ends.join(allowed, "account", "left_semi").unionByName(ends.join(more, [*part_, "account"], "left_semi")).distinct())
    inside = staging.write(induced(seeds, every, part_))
    found = at_once(lambda: cycles_with(ledger, inside, th, part_), lambda: chains_with(ledger, inside, th, part_), lambda: smurfing_with(e, seeds, every, th, part_))
    return staging.write(as_hits(found, part_))


def ends_of(payments: DataFrame, key: list[str]) -> DataFrame:
    return payments.select(*key, F.explode(F.array("src", "dst")).alias("account")).distinct()
