"""Streaming counterparts: burst alerts, activity sessions and chain hops over a stream of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(edges: DataFrame, late: str) -> DataFrame:
    """Watermarks need timestamps with a zone."""
    return edges.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def burst_alerts(edges: DataFrame, least: int = 5, window: str = "60 minutes", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Accounts with at least ``least`` outgoing payments in a sliding window."""
    counted = _timed(edges, late).groupBy(F.window("ts", window, slide).alias("w"), F.col("src").alias("account")).agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))
    return counted.where(F.col("n") >= least).select("account", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "amount")


def sessions(edges: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of an account's outgoing payments with no gap longer than ``gap``."""
    counted = _timed(edges, late).groupBy(F.session_window("ts", gap).alias("w"), F.col("src").alias("account")).agg(F.count("*").alias("n"))
    return counted.select("account", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def chain_hops(edges: DataFrame, max_delay_min: int = 120, min_forward: float = 0.85, late: str = "1 hour") -> DataFrame:
    """Pairs of payments where the second passes on most of the first within the delay: a stream-stream interval join."""
    a = _timed(edges, late).select(F.col("txn_id").alias("first"), F.col("ts").alias("t1"), F.col("dst").alias("via"), F.col("src").alias("origin"), F.col("amount").alias("a1"))
    b = _timed(edges, late).select(F.col("txn_id").alias("second"), F.col("ts").alias("t2"), F.col("src").alias("via2"), F.col("dst").alias("to"), F.col("amount").alias("a2"))
    near = (F.col("via") == F.col("via2")) & (F.col("t2") >= F.col("t1")) & (F.col("t2") <= F.col("t1") + F.expr(f"INTERVAL {max_delay_min} MINUTES"))
    return a.join(b, near).where((F.col("a2") >= F.col("a1") * min_forward) & (F.col("to") != F.col("origin"))).select("first", "second", "origin", "via", "to", "t1", "t2", "a1", "a2")
