"""Case tables of all rings at once: graphs, payments, key accounts, reasons and traces, keyed by ring.

Every table takes the ``rings`` it is of, so one ring's is the same table of one row.
Limits are per ring, by ranks that Spark cuts off before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import graph, taint
from .pipeline import Detection

NEIGHBOURS, PAYMENTS, ACCOUNTS, EXPLAINED, REASONS = 12, 35, 10, 6, 2
TRACE_DEPTH, TRACE_LEAST = 4, 100.0


def members(rings: DataFrame) -> DataFrame:
    """``ring_id, pos, account, role``: each member once, at its first place."""
    one = rings.select("ring_id", "collector", "origin", "terminal", F.posexplode(F.array_distinct("accounts")).alias("pos", "account"))
    role = F.when(F.col("account") == F.col("collector"), "collector").when(F.col("account") == F.col("origin"), "origin").when(F.col("account") == F.col("terminal"), "terminal").otherwise("member")
    return one.select("ring_id", "pos", "account", role.alias("role"))


def payments(d: Detection, rings: DataFrame, limit: int | None = PAYMENTS) -> DataFrame:
    """The first ``limit`` payments of each ring, or all, with ``n``, their number in order of time."""
    ids = rings.select("ring_id", F.explode(F.array_distinct("txn_ids")).alias("txn_id"))
    n = F.row_number().over(W.partitionBy("ring_id").orderBy("us", "txn_id"))
    out = d.edges.join(ids, "txn_id").select("ring_id", n.alias("n"), *d.edges.columns)
    return out.where(F.col("n") <= limit) if limit else out


def neighbours(d: Detection, rings: DataFrame, limit: int = NEIGHBOURS) -> DataFrame:
    """``ring_id, account``: scored accounts that pay a ring's member or are paid by one and are none, the first ``limit`` of each ring."""
    inside = members(rings).select("ring_id", "account")
    out = d.edges.select("src", "dst").join(inside.withColumnRenamed("account", "src"), "src").select("ring_id", F.col("dst").alias("account"))
    into = d.edges.select("src", "dst").join(inside.withColumnRenamed("account", "dst"), "dst").select("ring_id", F.col("src").alias("account"))
    near = out.unionByName(into).distinct().join(inside, ["ring_id", "account"], "left_anti").join(d.scores.select("account"), "account", "left_semi")
    return near.withColumn("n", F.row_number().over(W.partitionBy("ring_id").orderBy("account"))).where(F.col("n") <= limit).select("ring_id", "account")


def nodes(d: Detection, rings: DataFrame) -> DataFrame:
    """Each ring's graph: members and neighbours with role, time layer (dense rank of the first payment in the ring), score and degree."""
    all_ = members(rings).select("ring_id", "account", "role").unionByName(neighbours(d, rings).select("ring_id", "account", F.lit("neighbour").alias("role")))
    paid = payments(d, rings, None).select("ring_id", "us", F.explode(F.array("src", "dst")).alias("account"))
    seen = paid.groupBy("ring_id", "account").agg(F.min("us").alias("first_us"))
    layer = F.dense_rank().over(W.partitionBy("ring_id").orderBy(F.col("first_us").asc_nulls_last()))
    laid = all_.join(seen, ["ring_id", "account"], "left").withColumn("layer", layer)
    known = laid.join(d.scores.select("account", "score"), "account", "left").join(graph.degrees(d.edges), "account", "left")
    return known.select("ring_id", "account", "role", "layer", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("degree", F.lit(0)).alias("degree"))


def key_accounts(d: Detection, rings: DataFrame, limit: int = ACCOUNTS) -> DataFrame:
    """The first ``limit`` accounts of each ring: bank, score, velocity and the filter's verdict; nulls for what isn't scored."""
    first = members(rings).where(F.col("pos") < limit)
    known = first.join(d.accounts, "account", "left").join(d.scores.select("account", "score"), "account", "left").join(d.features, "account", "left").join(d.verdicts.select("account", "rule"), "account", "left")
    return known.select("ring_id", "pos", "account", "role", "bank", "score", "txns_per_hour", "peak_burst_rate", "median_hold_min", "pass_through_ratio", "rule")


def reasons(d: Detection, rings: DataFrame, limit: int = EXPLAINED, each: int = REASONS) -> DataFrame:
    """Why a ring's first ``limit`` accounts were flagged: ``each`` reasons of every one that is scored."""
    first = members(rings).where(F.col("pos") < limit).join(d.scores.select("account", F.slice("reasons", 1, each).alias("r")), "account")
    return first.select("ring_id", "pos", "account", F.posexplode("r").alias("n", "reason"))


def traces(d: Detection, rings: DataFrame, max_depth: int = TRACE_DEPTH, min_taint: float = TRACE_LEAST) -> DataFrame:
    """The nodes of the traces of every ring's first payment, all in one job; rings that begin with the same payment share its trace."""
    first = rings.select("ring_id", F.col("txn_ids")[0].alias("root"))
    t = taint.trace_roots(d.edges, first.select(F.col("root").alias("txn_id")), max_depth, min_taint)
    return first.join(t.nodes, "root").drop("root")
