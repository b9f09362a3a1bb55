"""Proportional taint tracing: one DataFrame a depth, each bundle spent in one running sum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import rounded
from ..session import Staging
from .scan import is_small, running

_DUST = 1e-9


@dataclass
class Trace:
    """``nodes``: the tree; ``terminals``: where the money rests; ``dropped``: what was below the minimum, one row."""

    nodes: DataFrame
    terminals: DataFrame
    dropped: DataFrame


def _history(e: DataFrame, holders: DataFrame, side: str) -> DataFrame:
    """``holder, us, txn_id, other, amount`` of the payments into (``dst``) or out of (``src``) accounts."""
    other = "src" if side == "dst" else "dst"
    return e.select(F.col(side).alias("holder"), "us", "txn_id", F.col(other).alias("other"), "amount").join(holders, "holder", "left_semi")


def clean_pool(e: DataFrame, bundles: DataFrame, small: bool = False) -> DataFrame:
    """``bundle, clean``: per bundle (holder, at, own) what came in by then but for its own payment, less what left before, not below 0.

    A holder's history is read once, as one running balance that its bundles look up at
    their times, however many they are. ``small``: the ledger is (``is_small``).
    """
    holders = bundles.select("holder").distinct()
    m, none = F.col("amount").cast("decimal(18,2)"), F.lit(None).cast(bundles.schema["bundle"].dataType).alias("bundle")
    into = _history(e, holders, "dst").select("holder", "us", F.lit(0).alias("turn"), m.cast("decimal(19,2)").alias("m"), none)
    out = _history(e, holders, "src").select("holder", "us", F.lit(2).alias("turn"), (-m).cast("decimal(19,2)").alias("m"), none)
    asked = bundles.select("holder", F.col("at").alias("us"), F.lit(1).alias("turn"), F.lit(0).cast("decimal(19,2)").alias("m"), "bundle")
    # Rows of equal time and turn: several payments in, or bundles that add nothing.
    balance = running(into.unionByName(out).unionByName(asked), ["holder"], ["us", "turn"], {"balance": ("sum", F.col("m"))}, peers=True, plain=small).where("bundle is not null")
    own = F.col("own").cast("decimal(18,2)")
    return balance.join(bundles.select("bundle", "own"), "bundle").select("bundle", F.greatest(F.lit(0.0), (F.col("balance") - own).cast("double")).alias("clean"))


def _spent_by(e: DataFrame, pool: DataFrame, staging: Staging, small: bool) -> DataFrame:
    """The bundles of ``pool`` with the payments their money may leave by: those from their time on, up to what money there is.

    Payments of a holder are numbered and summed up once; a bundle looks up the first and
    the last one, and meets just these by number, not the holder's whole future.
    """
    paid = _history(e, pool.select("holder").distinct(), "src")
    worth = F.greatest(F.col("amount"), F.lit(0.0))
    paid = staging.write(running(paid, ["holder"], ["us", "txn_id"], {"k": ("sum", F.lit(1)), "sum": ("sum", worth)}, plain=small))
    look = ["holder", "at", "turn", "n", "worth", "bundle", "reach"]
    none = F.lit(None).cast(pool.schema["bundle"].dataType).alias("bundle")
    zero, nil = F.lit(0.0), F.lit(None).cast("double")
    firsts = paid.select("holder", F.col("us").alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("n"), worth.alias("worth"), none, nil.alias("reach")).unionByName(
        pool.select("holder", "at", F.lit(0).alias("turn"), F.lit(0).alias("n"), zero.alias("worth"), "bundle", (F.col("clean") + F.col("d")).alias("reach"))
    )
    begun = running(firsts.select(*look), ["holder"], ["at", "turn"], {"k0": ("sum", F.col("n")), "s0": ("sum", F.col("worth"))}, peers=True, plain=small).where("bundle is not null")
    lasts = paid.select("holder", (F.col("sum") - worth).alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("n"), none, F.lit(None).cast("long").alias("k0")).unionByName(
        begun.select("holder", (F.col("s0") + F.col("reach")).alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("n"), "bundle", F.col("k0").cast("long").alias("k0"))
    )
    # One payment more than the sums say, for their rounding.
    bounds = running(lasts, ["holder"], ["at", "turn"], {"k1": ("sum", F.col("n"))}, peers=True, plain=small).withColumn("k1", F.col("k1") + 1)
    bounds = bounds.where("bundle is not null and k1 > k0").select("bundle", F.explode(F.sequence(F.col("k0") + 1, F.col("k1"))).alias("k"))
    mine = pool.join(bounds, "bundle")
    return mine.join(paid.select("holder", "k", F.col("other").alias("dst"), "us", "txn_id", "amount"), ["holder", "k"])


def trace(e: DataFrame, txn_id=None, account=None, since_us: int | None = None, max_depth: int = 6, min_taint: float = 1.0) -> Trace:
    """Follows a payment's whole amount, or an account's first inflow from ``since_us`` on, to where it rests.

    A bundle of dirty money D in an account with clean money C leaves as D / (C + D)
    of each later payment, in order, until it is spent. Bundles below ``min_taint`` are
    dropped, those at the depth limit and unspent rests are terminals. An account
    needs ``since_us``; an unknown payment or no inflow gives empty results.
    """
    if txn_id is None and (account is None or since_us is None):
        raise ValueError("trace needs a txn_id, or an account and since_us")
    if txn_id is not None:
        seed = e.where(F.col("txn_id") == F.lit(txn_id))
    else:
        seed = first_inflows(e.where(F.col("dst") == F.lit(account)), since_us)
    nodes, ends, lost = _follow(e, seed, max_depth, min_taint)
    terminals = ends.groupBy("holder").agg(rounded(F.sum("rest"), 2).alias("amount")).orderBy(F.desc("amount"), "holder")
    return Trace(nodes.drop("root"), terminals, lost.agg(F.coalesce(rounded(F.sum("d"), 2), F.lit(0.0)).alias("dropped")))


def trace_roots(e: DataFrame, roots: DataFrame, max_depth: int = 6, min_taint: float = 1.0) -> Trace:
    """The traces of all payments of ``roots(txn_id)`` in one job; nodes, terminals and dropped have the ``root`` they belong to.

    A bundle is the path of payments from its root on, so the bundles, balances and numbered
    payments of a level are shared by all roots, and roots never mix. Repeated roots are one,
    unknown ones have no rows.
    """
    nodes, ends, lost = _follow(e, e.join(roots.select("txn_id").distinct(), "txn_id", "left_semi"), max_depth, min_taint)
    terminals = ends.groupBy("root", "holder").agg(rounded(F.sum("rest"), 2).alias("amount"))
    return Trace(nodes, terminals, lost.groupBy("root").agg(rounded(F.sum("d"), 2).alias("dropped")))


def first_inflows(e: DataFrame, since_us: int) -> DataFrame:
    """The first payment into each account from ``since_us`` on: the roots of traces by account."""
    return e.where(F.col("us") >= since_us).groupBy("dst").agg(F.min(F.struct("us", "txn_id", "src", "amount")).alias("f")).select("f.txn_id", "f.us", "f.src", "dst", "f.amount")


def _follow(e: DataFrame, seed: DataFrame, max_depth: int, min_taint: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes``, what rests (``root, holder, rest``) and what is dropped (``root, d``) of the traces of all payments of ``seed``."""
    staging = Staging(e.sparkSession, "taint")
    e = staging.write(e.select("txn_id", "us", "src", "dst", "amount"))
    small = is_small(e)
    level = staging.write(seed.select(F.array(F.col("txn_id")).alias("bundle"), F.array().cast(f"array<{e.schema['txn_id'].dataType.simpleString()}>").alias("parent"), F.lit(0).alias("depth"), "txn_id", "src", "dst", "us", "amount", F.col("amount").alias("taint"), F.lit(1.0).alias("fraction")))
    nodes, ends, lost = level, None, None
    root = F.col("bundle")[0].alias("root")
    for depth in range(max_depth + 1):
        held = level.select("bundle", F.col("dst").alias("holder"), F.col("us").alias("at"), F.col("amount").alias("own"), F.col("taint").alias("d"))
        below = held.where(F.col("d") < min_taint).select(root, "d")
        lost = below if lost is None else lost.unionByName(below)
        held = held.where(F.col("d") >= min_taint)
        if depth == max_depth:
            rest = held.select(root, "holder", F.col("d").alias("rest"))
            ends = rest if ends is None else ends.unionByName(rest)
            break
        pool = staging.write(held.join(clean_pool(e, held, small), "bundle").withColumn("f", F.col("d") / (F.col("clean") + F.col("d"))))
        order = W.partitionBy("bundle").orderBy("us", "txn_id")
        spend = _spent_by(e, pool, staging, small)
        # A payment of nothing ends the spending.
        spend = spend.withColumn("stop", F.max((F.col("amount") <= 0).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("stop = 0")
        before = F.coalesce(F.sum("amount").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        portion = F.greatest(F.lit(0.0), F.least(F.col("amount") * F.col("f"), F.col("d") - F.col("f") * before))
        child = spend.withColumn("portion", portion).where(F.col("portion") > _DUST)
        level = staging.write(child.select(F.concat("bundle", F.array("txn_id")).alias("bundle"), F.col("bundle").alias("parent"), F.lit(depth + 1).alias("depth"), "txn_id", F.col("holder").alias("src"), "dst", "us", "amount", F.col("portion").alias("taint"), (F.col("portion") / F.col("amount")).alias("fraction")))
        spent = level.groupBy(F.col("parent").alias("bundle")).agg(F.sum("taint").alias("s"))
        rest = held.join(spent, "bundle", "left").select(root, "holder", (F.col("d") - F.coalesce("s", F.lit(0.0))).alias("rest")).where(F.col("rest") > _DUST)
        ends = rest if ends is None else ends.unionByName(rest)
        nodes = nodes.unionByName(level)
        if level.isEmpty():
            break
    shown = nodes.select(root, "bundle", "parent", "depth", "txn_id", "src", "dst", "us", rounded("amount", 2).alias("amount"), rounded("taint", 2).alias("taint"), rounded("fraction", 4).alias("fraction")).orderBy("root", "depth", "us", "bundle")
    return shown, ends, lost


def totals(t: Trace) -> DataFrame:
    return t.nodes.agg(rounded(F.sum("taint"), 2).alias("total_taint"), F.count("*").alias("n_nodes"), F.max("depth").alias("depth"))


def flow_links(t: Trace) -> DataFrame:
    """Links between accounts by depth, as a flow diagram draws them."""
    return t.nodes.groupBy("depth", "src", "dst").agg(rounded(F.sum("taint"), 2).alias("taint"), F.count("*").alias("n"))
