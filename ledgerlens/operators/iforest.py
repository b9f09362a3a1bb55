"""Isolation forest (Liu, Ting, Zhou 2008) as a table of nodes, and percentile ranks.

Every choice is an integer hash of (seed, tree, node) or (seed, tree, account), so the
same rows give the same forest on any number of executors. A tree is grown in one group
from its own sample of at most ``sample`` rows; rows then walk all trees by one join a
level with the node table, whose size is bounded by trees x 2^(levels + 1).
"""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import draw, rounded
from ..session import Staging
from .scan import is_small, running

FEATURES = ("txn_count", "txns_per_hour", "peak_burst_rate", "pass_through_ratio", "median_hold_min", "amount_mean", "amount_max")
TREES, SAMPLE, SEED = 100, 256, 42
#: Path lengths are counted in millionths, so that their sums don't depend on an order.
UNIT = 1_000_000
_EULER = 0.5772156649015329
NODES = "tree int, node int, members int, feature int, cut double, left int, right int, length long"


def average_path(n: int) -> int:
    """Mean path of an unsuccessful search among n rows, in units of 1 / UNIT."""
    return 0 if n <= 1 else UNIT if n == 2 else round(UNIT * (2 * (log(n - 1) + _EULER) - 2 * (n - 1) / n))


def grow(x: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """The nodes of a tree over the rows of ``x``: an inner one has children ``2 node`` (at or below the cut) and ``2 node + 1``."""
    limit, nodes = ceil(log2(max(len(x), 2))), []
    open_ = [(1, 0, np.arange(len(x)))]
    while open_:
        node, depth, rows = open_.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        free = np.flatnonzero(high > low)
        if depth >= limit or not len(free):
            nodes.append((tree, node, len(rows), -1, None, None, None, UNIT * depth + average_path(len(rows))))
            continue
        f = int(free[draw(seed, tree, node, "feature") % len(free)])
        cut = float(low[f] + draw(seed, tree, node, "cut") / 2.0**32 * (high[f] - low[f]))
        if cut >= high[f]:  # rounded up to the highest value: both sides must have rows
            cut = float(low[f])
        below = x[rows, f] <= cut
        nodes.append((tree, node, len(rows), f, cut, 2 * node, 2 * node + 1, None))
        open_ += [(2 * node, depth + 1, rows[below]), (2 * node + 1, depth + 1, rows[~below])]
    return nodes


def _features() -> list[Column]:
    return [rounded(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 6).alias(c) for c in FEATURES]


def average_path_of(n: Column) -> Column:
    """``average_path`` of a column of counts."""
    mean = F.round(UNIT * (2 * (F.log(n - 1) + _EULER) - 2 * (n - 1) / n)).cast("long")
    return F.when(n <= 1, 0).when(n == 2, UNIT).otherwise(mean)


def forest(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, part: tuple[str, ...] = ()) -> DataFrame:
    """``NODES`` of all trees; no rows without accounts. Features are rounded to six places, null ones are 0.

    A pool of trees x sample accounts, those of least hash, is the most that any tree can
    see; each tree takes the ``sample`` of it that have the least hash with its number.
    ``part`` names text columns that have a forest each (a run).
    """
    name, part_ = F.col("account").cast("string"), list(part)
    order = [F.md5(F.concat(F.lit(f"{seed}:"), name)), F.col("account")]
    rows = features.select(*part_, "account", *_features())
    if part_:
        pool = rows.withColumn("place", F.row_number().over(W.partitionBy(*part_).orderBy(*order))).where(F.col("place") <= trees * sample).drop("place")
    else:
        pool = rows.orderBy(*order).limit(trees * sample)
    dealt = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    turn = F.row_number().over(W.partitionBy(*part_, "tree").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("tree").cast("string"), F.lit(":"), name)), "account"))
    taken = dealt.withColumn("turn", turn).where(F.col("turn") <= sample)

    def one_tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = grow(pdf[list(FEATURES)].to_numpy(float), int(key[-1]), seed)
        out = pd.DataFrame(nodes, columns=[c.split()[0] for c in NODES.split(", ")]).astype({c: "Int64" for c in ("left", "right", "length")})
        return out.assign(**dict(zip(part_, key)))[[*part_, *out.columns]]

    schema = ", ".join([*[f"{c} string" for c in part_], NODES])
    return taken.select(*part_, "tree", *FEATURES).groupBy(*part_, "tree").applyInPandas(one_tree, schema)


#: Nodes that are sent to every task at once; more are joined by their keys.
SENT_NODES = 1 << 21


def path_lengths(features: DataFrame, nodes: DataFrame, trees: int = TREES, sample: int = SAMPLE, part: tuple[str, ...] = ()) -> DataFrame:
    """``account, path`` (and ``part``): the sum of each account's path lengths over all trees, in units of 1 / UNIT.

    One forest has at most trees x 2^(levels + 1) nodes, which bounds what is broadcast; of
    a forest a part they are counted first.
    """
    part_ = list(part)
    send = F.broadcast if not part_ or nodes.count() <= SENT_NODES else lambda df: df
    inner = send(nodes.select(*part_, "tree", "node", "feature", "cut", "left", "right"))
    at = features.select(*part_, "account", F.array(*_features()).alias("x")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(1))
    for _ in range(ceil(log2(max(sample, 2)))):
        at = at.join(inner, [*part_, "tree", "node"])
        down = F.when(F.get("x", F.col("feature")) <= F.col("cut"), F.col("left")).otherwise(F.col("right"))
        at = at.select(*part_, "account", "x", "tree", F.when(F.col("feature") < 0, F.col("node")).otherwise(down).alias("node"))
    return at.join(send(nodes.select(*part_, "tree", "node", "length")), [*part_, "tree", "node"]).groupBy(*part_, "account").agg(F.sum("length").alias("path"))


def anomaly(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, part: tuple[str, ...] = ()) -> DataFrame:
    """``account, raw`` (and ``part``): 2^(-mean path / mean path of a whole sample); higher is more anomalous. No accounts: no rows."""
    part_ = list(part)
    nodes = Staging(features.sparkSession, "forest").write(forest(features, trees, sample, seed, part))
    scale = average_path_of(F.col("members"))
    root = nodes.where("tree = 0 and node = 1").select(*part_, F.when(scale == 0, UNIT).otherwise(scale).alias("scale"))  # one row a forest
    paths = path_lengths(features, nodes, trees, sample, part)
    both = paths.join(root, part_) if part_ else paths.crossJoin(F.broadcast(root))
    return both.select(*part_, "account", F.pow(F.lit(2.0), -F.col("path") / (F.lit(float(trees)) * F.col("scale"))).alias("raw"))


def percentile_rank(raw: DataFrame, value: str = "raw", key: str = "account", part: tuple[str, ...] = ()) -> DataFrame:
    """``key, anomaly`` (and ``part``): 100 x rank / (n - 1), rank by (value, key) from 0.

    A global rank without a single-task window: rows are range-partitioned by value,
    counted per partition, and ranked inside it after the counts before it (one small row each).
    """
    part_ = list(part)
    if part_:
        rows = Staging(raw.sparkSession, "ranks").write(raw.select(*part_, key, value))
        n = rows.groupBy(*part_).agg(F.count("*").alias("n"))
        ranked = running(rows, part_, [value, key], {"rank": ("sum", F.lit(1))}, plain=is_small(rows)).join(n, part_)
        return ranked.select(*part_, key, (100.0 * (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("anomaly"))
    staged = Staging(raw.sparkSession, "ranks").write(raw.select(key, value).repartitionByRange(value, key).withColumn("p", F.spark_partition_id()))
    counts = staged.groupBy("p").agg(F.count("*").alias("n"))  # a row per partition
    before = counts.select("p", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy(F.lit(1))).alias("total"))
    rank = F.row_number().over(W.partitionBy("p").orderBy(value, key)) - 1 + F.col("before")
    return staged.join(F.broadcast(before), "p").select(key, (100.0 * rank / F.greatest(F.col("total") - 1, F.lit(1))).alias("anomaly"))
