"""Temporal money cycles: half paths from both ends over narrow edges, joined where they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import DEFAULTS, Thresholds
from ..functions.scalars import HOUR, rounded
from ..session import Staging
from .graph import induced


def detect_cycles(e: DataFrame, allowed: DataFrame | None = None, th: Thresholds = DEFAULTS, part: tuple[str, ...] = ()) -> DataFrame:
    """One row per set of accounts that a loop runs through, its loop of highest retention (ties: earliest start, then transaction ids).

    From an origin, money moves on without going back in time (equal times are
    allowed), within the window of the first hop, and without growing over 2 % a hop;
    the closing payment is compared in time with the first hop alone. ``part`` names
    key columns that separate ledgers searched at once (a bank, a scheme). Levels are
    written tables: a lost executor repeats one level, not the search.

    Loops meet in the middle: the first half grows from the origin on, the second one
    from the closing payment backwards, each of half the payments at most (three of six),
    and the halves are joined by both their ends and the time slot of the closing payment. A half meets the next payments of
    its last account in the time slots, as long as the window, that can hold them, so a
    busy account is dealt out over time; halves whose amounts rule out the wanted retention go.
    """
    part_ = list(part)
    staging = Staging(e.sparkSession, "cycles")
    window, growth, least = int(th.cycle_window_hours * HOUR), th.cycle_growth, th.cycle_min_retention
    shade = max(1.0, growth) ** th.cycle_max_len * (1 + 1e-9)  # more than an amount can grow over a loop, for rounding too
    narrow = staging.write(induced(e, allowed, part_).where("src <> dst").select(*part_, "src", "dst", "us", "amount", "txn_id"))
    slot = lambda c: F.expr(f"{c} div {window + 1}")
    met = [F.col("us").alias("e_us"), F.col("amount").alias("e_amount"), F.col("txn_id").alias("e_txn"), slot("us").alias("slot")]
    onward = narrow.select(*part_, F.col("src").alias("mid"), F.col("dst").alias("e_dst"), *met)
    inward = narrow.select(*part_, F.col("dst").alias("mid"), F.col("src").alias("e_src"), *met)

    first = narrow.where("amount <> 0").select(*part_, F.col("src").alias("origin"), F.col("dst").alias("mid"), F.array("src", "dst").alias("path"), F.col("us").alias("t0"), F.col("us").alias("t"), F.col("amount").alias("a0"), F.col("amount").alias("a"), F.array("txn_id").alias("txns"))
    firsts = [first]
    for _ in range(1, (th.cycle_max_len + 1) // 2):
        grown = firsts[-1].withColumn("slot", F.explode(F.array(slot("t0"), slot("t0") + 1))).join(onward, [*part_, "mid", "slot"])
        fits = (F.col("e_us") >= F.col("t")) & (F.col("e_us") - F.col("t0") <= window) & (F.col("e_amount") <= F.col("a") * growth) & ~F.array_contains("path", F.col("e_dst")) & (F.col("e_amount") * shade >= F.col("a0") * least)
        firsts.append(staging.write(grown.where(fits).select(*part_, "origin", F.col("e_dst").alias("mid"), F.concat("path", F.array("e_dst")).alias("path"), "t0", F.col("e_us").alias("t"), "a0", F.col("e_amount").alias("a"), F.concat("txns", F.array("e_txn")).alias("txns"))))

    # ``f_us, f_amount`` are of the half's first payment, ``l_us`` is the time of its last one but the closing one.
    closing = narrow.select(*part_, F.col("dst").alias("origin"), F.col("src").alias("mid"), F.array().cast(f"array<{narrow.schema['src'].dataType.simpleString()}>").alias("nodes"), F.lit(None).cast("long").alias("f_us"), F.lit(None).cast("long").alias("l_us"), F.col("amount").alias("f_amount"), F.col("us").alias("c_us"), F.col("amount").alias("c_amount"), F.array().cast(f"array<{narrow.schema['txn_id'].dataType.simpleString()}>").alias("after"), F.col("txn_id").alias("c_txn"))
    seconds = [closing]
    for _ in range(1, th.cycle_max_len // 2):
        near = slot("coalesce(f_us, c_us)")
        grown = seconds[-1].withColumn("slot", F.explode(F.array(near - 1, near, near + 1))).join(inward, [*part_, "mid", "slot"])
        fits = (F.abs(F.col("c_us") - F.col("e_us")) <= window) & (F.col("f_us").isNull() | (F.col("e_us") <= F.col("f_us")) & (F.col("l_us") - F.col("e_us") <= window))
        fits &= (F.col("f_amount") <= F.col("e_amount") * growth) & (F.col("e_amount") * least <= F.col("c_amount") * shade) & (F.col("e_src") != F.col("origin")) & ~F.array_contains("nodes", F.col("e_src"))
        seconds.append(staging.write(grown.where(fits).select(*part_, "origin", F.col("e_src").alias("mid"), F.concat(F.array("mid"), "nodes").alias("nodes"), F.col("e_us").alias("f_us"), F.coalesce("l_us", "e_us").alias("l_us"), F.col("e_amount").alias("f_amount"), "c_us", "c_amount", F.concat(F.array("e_txn"), "after").alias("after"), "c_txn")))

    closed: DataFrame | None = None
    for payments in range(2, th.cycle_max_len + 1):
        one = firsts[(payments + 1) // 2 - 1].withColumn("slot", F.explode(F.array(slot("t0"), slot("t0") + 1)))
        two = seconds[payments // 2 - 1].withColumn("slot", slot("c_us"))
        fits = (F.col("c_us") >= F.col("t0")) & (F.col("c_us") - F.col("t0") <= window) & (F.col("c_amount") / F.col("a0") >= least) & (F.col("f_amount") <= F.col("a") * growth)
        fits &= F.col("f_us").isNull() | (F.col("f_us") >= F.col("t")) & (F.col("l_us") - F.col("t0") <= window)
        pair = one.join(two, [*part_, "origin", "mid", "slot"]).where(fits & ~F.arrays_overlap("path", "nodes"))
        loops = pair.select(*part_, F.concat("path", "nodes").alias("path"), F.concat("txns", "after").alias("txns"), "t0", "a0", F.col("c_us").alias("e_us"), F.col("c_amount").alias("e_amount"), F.col("c_txn").alias("e_txn"))
        closed = loops if closed is None else closed.unionByName(loops)
    return staging.keep(cycle_hits(closed, part_))


def cycle_hits(closed: DataFrame, part: list[str]) -> DataFrame:
    """The best loop of each account set, from closed paths ``path, txns, t0, a0`` and their closing payment ``e_us, e_amount, e_txn``."""
    hits = closed.select(*part, F.col("path").alias("accounts"), F.concat("txns", F.array("e_txn")).alias("txn_ids"), F.col("t0").alias("start_us"), F.col("e_us").alias("end_us"), F.col("a0").alias("amount_start"), F.col("e_amount").alias("amount_end"))
    members = F.array_sort("accounts")
    ratio = F.col("amount_end") / F.col("amount_start")
    best = F.row_number().over(W.partitionBy(*part, "members").orderBy(F.desc("ratio"), "start_us", "txn_ids"))
    ranked = hits.withColumn("members", members).withColumn("ratio", ratio).withColumn("best", best).where("best = 1")
    return ranked.select(
        *part, F.lit("cycle").alias("type"), "accounts", F.col("accounts")[0].alias("origin"), "txn_ids", "start_us", "end_us",
        rounded("ratio", 4).alias("retention"), rounded((F.col("end_us") - F.col("start_us")) / HOUR, 2).alias("window_hours"),
        (F.size("accounts") - 1).alias("length"), rounded("amount_start", 2).alias("amount_start"), rounded("amount_end", 2).alias("amount_end"),
    )
