"""The ledger as a temporal directed multigraph, in relations: edges and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def endpoints(e: DataFrame) -> DataFrame:
    """Each edge under both its accounts: ``account, direction, cp, bank, ...``; a self-loop twice."""
    keep = ["txn_id", "us", "amount"]
    out = e.select(F.col("src").alias("account"), F.lit("out").alias("direction"), F.col("dst").alias("cp"), F.col("bank_src").alias("bank"), *keep)
    return out.unionByName(e.select(F.col("dst").alias("account"), F.lit("in").alias("direction"), F.col("src").alias("cp"), F.col("bank_dst").alias("bank"), *keep))


def accounts(e: DataFrame) -> DataFrame:
    """``account, bank``: the bank of the account's first edge (its source side before its destination side)."""
    order = F.struct("us", "txn_id", F.when(F.col("direction") == "out", 0).otherwise(1))
    return endpoints(e).groupBy("account").agg(F.coalesce(F.min_by("bank", order), F.lit("?")).alias("bank"))


def degrees(e: DataFrame) -> DataFrame:
    return endpoints(e).groupBy("account").agg(F.count("*").alias("degree"))


def induced(e: DataFrame, allowed: DataFrame | None, on: list[str] | None = None) -> DataFrame:
    """Edges with both ends in ``allowed(account)``; Catalyst broadcasts it when its measured size permits."""
    if allowed is None:
        return e
    on = on or []
    ends = allowed.select(*on, "account").distinct()
    return e.join(ends.withColumnRenamed("account", "src"), [*on, "src"], "left_semi").join(ends.withColumnRenamed("account", "dst"), [*on, "dst"], "left_semi")


def edge(e: DataFrame, txn_id) -> DataFrame:
    return e.where(F.col("txn_id") == F.lit(txn_id))


def neighbours(e: DataFrame, members: DataFrame, scored: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Accounts next to a ring's ``members(account)`` but not in it, among ``scored(account)``, in order, the first ``limit``."""
    out = e.join(members.select(F.col("account").alias("src")), "src", "left_semi").select(F.col("dst").alias("account"))
    into = e.join(members.select(F.col("account").alias("dst")), "dst", "left_semi").select(F.col("src").alias("account"))
    found = out.unionByName(into).distinct().join(members.select("account"), "account", "left_anti")
    if scored is not None:
        found = found.join(scored.select("account"), "account", "left_semi")
    return found.orderBy("account").limit(limit)


def path_text(c: Column, sep: str = ",") -> Column:
    return F.array_join(c.cast("array<string>"), sep)
