"""Sub-threshold fan-in (structuring): best trailing window of deposits per collector, by running sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.scalars import DAY, money, rounded
from .scan import is_small, running


def deposits(e: DataFrame, allowed: DataFrame | None, th: Thresholds, part: list[str]) -> DataFrame:
    """Candidate deposits of collectors that have enough of them at all; depositors need not be allowed."""
    out = e.where((F.col("amount") >= th.reporting * 0.5) & (F.col("amount") < th.reporting))
    if allowed is not None:
        out = out.join(allowed.select(*part, F.col("account").alias("dst")).distinct(), [*part, "dst"], "left_semi")
    enough = out.groupBy(*part, "dst").agg(F.count("*").alias("n")).where(F.col("n") >= th.smurf_min_deposits)
    return out.join(enough.select(*part, "dst"), [*part, "dst"], "left_semi")


def windows(e: DataFrame, allowed: DataFrame | None = None, th: Thresholds = DEFAULTS, part: tuple[str, ...] = ()) -> DataFrame:
    """Every closed trailing window that ends at a deposit and has enough deposits from enough contributors.

    Linear in the deposits: each adds to all windows that end from its time on and is taken off
    once they begin after it; it stands for its payer until that payer's next one. So
    sums and distinct payers are running sums over these events, without a frame per row.
    """
    part_ = list(part)
    key, span = [*part_, "dst"], int(th.smurf_window_days * DAY)
    just = F.col("amount").between(th.reporting * th.smurf_just_below_min, th.reporting * th.smurf_just_below).cast("double")
    small = is_small(e)
    d = deposits(e, allowed, th, part_).select(*key, "src", "us", "txn_id", just.alias("just"), money(F.col("amount")).alias("m"), (-F.col("us")).alias("back"))
    # A payer's next deposit is the last one before this in reversed time.
    d = running(d, [*key, "src"], ["back", "txn_id"], {"next": ("max", F.col("back"))}, before=True, plain=small).withColumn("next", -F.col("next"))
    gone = F.col("us") + span + 1
    event = lambda at, n, payers, txn: F.struct(at.alias("at"), F.lit(n).alias("n"), F.lit(payers).alias("payers"), (F.col("just") * n).alias("just"), (F.col("m") * n).cast("decimal(38,2)").alias("m"), txn.alias("txn_id"))
    none = F.lit(None).cast(d.schema["txn_id"].dataType)
    events = d.select(*key, F.inline(F.array(event(F.col("us"), 1, 1, F.col("txn_id")), event(gone, -1, 0, none), event(F.least(F.coalesce("next", gone), gone), 0, -1, none))))
    totals = {"number": ("sum", F.col("n")), "contributors": ("sum", F.col("payers")), "inside": ("sum", F.col("just")), "total": ("sum", F.col("m"))}
    sums = running(events, key, ["at"], totals, peers=True, plain=small)
    sums = sums.select(*key, F.col("at").alias("us"), "txn_id", F.col("number").alias("n"), "contributors", F.col("inside").alias("just"), F.col("total").cast("decimal(28,2)").alias("total"))
    return sums.where(F.col("txn_id").isNotNull() & (F.col("n") >= th.smurf_min_deposits) & (F.col("contributors") >= th.smurf_min_deposits)).withColumn("score", F.col("just") / F.col("n")).drop("just")


def detect_smurfing(e: DataFrame, allowed: DataFrame | None = None, th: Thresholds = DEFAULTS, part: tuple[str, ...] = ()) -> DataFrame:
    """One row per collector: its window of most deposits, then highest structuring score, then earliest end; and the consolidating payment.

    Deposits of equal time are in a window together. The consolidation is the first
    outgoing payment, in the order in which the collector first paid each receiver,
    that is no earlier than the window's start and of at least 0.3 of its total.
    """
    part_ = list(part)
    key = [*part_, "dst"]
    first = F.min(F.struct((-F.col("n")).alias("fewer"), (-F.col("score")).alias("lower"), "us", "txn_id", "n", "score", "total"))
    best = windows(e, allowed, th, part).groupBy(*key).agg(first.alias("w")).select(*key, F.col("w.us").alias("end_us"), "w.n", "w.score", "w.total")
    inside = deposits(e, allowed, th, part_).select(*key, "src", "us", "txn_id").join(best, key).where(f"us between end_us - {int(th.smurf_window_days * DAY)} and end_us")
    hit = inside.groupBy(*key).agg(F.array_sort(F.collect_set("src")).alias("depositors"), F.transform(F.array_sort(F.collect_list(F.struct("us", "txn_id"))), lambda s: s["txn_id"]).alias("txn_ids"), F.min("us").alias("start_us"), F.first("end_us").alias("end_us"), F.first("n").alias("n_deposits"), rounded(F.first("score"), 3).alias("structuring_score"), F.first("total").cast("double").alias("total_amount"))
    out = e.select(*part_, F.col("src").alias("c"), F.col("dst").alias("to"), "us", "txn_id", "amount").join(hit.select(*part_, F.col("dst").alias("c"), "start_us", "total_amount"), [*part_, "c"])
    since = out.groupBy(*part_, "c", "to").agg(F.min(F.struct("us", "txn_id")).alias("since"))
    paid = out.where((F.col("us") >= F.col("start_us")) & (F.col("amount") >= F.col("total_amount") * 0.3)).join(since, [*part_, "c", "to"])
    first = paid.groupBy(*part_, F.col("c").alias("dst")).agg(F.min(F.struct("since", "us", "txn_id", "to", "amount")).alias("p"))
    joined = hit.join(first, key, "left")
    accounts = F.array_sort(F.array_distinct(F.concat("depositors", F.array_compact(F.array("dst", F.col("p.to"))))))
    return joined.select(
        *part_, F.lit("smurfing").alias("type"), F.col("dst").alias("collector"), accounts.alias("accounts"), "depositors", "txn_ids", "start_us", "end_us", "n_deposits",
        F.size("depositors").alias("n_contributors"), "structuring_score", "total_amount", rounded((F.col("end_us") - F.col("start_us")) / DAY, 2).alias("window_days"),
        F.col("p.txn_id").alias("consolidation_txn"), F.col("p.to").alias("consolidation_to"), rounded("p.amount", 2).alias("consolidation_amount"), F.col("p.us").alias("consolidation_us"),
    )
