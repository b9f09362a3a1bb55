"""Query surface over a detection run: summaries, rings, graphs, accounts, dossiers, series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import risk_band, rounded
from ..operators import evidence, graph, taint, velocity
from ..operators.scan import is_small, running
from . import cases
from .pipeline import Detection


def summary(d: Detection) -> DataFrame:
    e = d.edges.agg(F.count("*").alias("transactions"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    v = d.verdicts.agg(F.count("*").alias("accounts"), F.count_if("benign").alias("benign"), F.count_if(~F.col("benign")).alias("suspects"))
    return e.crossJoin(v).crossJoin(d.scores.agg(F.count("*").alias("flagged_accounts"))).crossJoin(d.rings.agg(F.count("*").alias("rings")))  # one row each


def health(d: Detection) -> DataFrame:
    """``status, transactions, rings``: one row; ``empty`` without a payment, else ``ok``."""
    n = d.edges.agg(F.count("*").alias("transactions")).crossJoin(d.rings.agg(F.count("*").alias("rings")))  # one row each
    return n.select(F.when(F.col("transactions") == 0, "empty").otherwise("ok").alias("status"), "transactions", "rings")


def funnel(d: Detection) -> DataFrame:
    """``step, stage, n``: payments, accounts, suspects, flagged accounts, rings."""
    s = summary(d)
    stages = ("transactions", "accounts", "suspects", "flagged_accounts", "rings")
    return s.select(F.inline(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(c).alias("stage"), F.col(c).cast("long").alias("n")) for k, c in enumerate(stages)])))


def top_rings(d: Detection, k: int = 6) -> DataFrame:
    return ring_list(d).limit(k)


def ring_list(d: Detection, kind: str | None = None, min_score: float = 0.0, order: str | list[str] = "score", ascending: bool | list[bool] = False, bank: str | None = None, text: str | None = None) -> DataFrame:
    """Rings with band, size and their payments' amounts in time order; by one or several columns, then ring_id.

    Filters: type, least score, a bank among the ring's, and a part of its id or of a member's.
    """
    amounts = d.rings.select("ring_id", F.explode("txn_ids").alias("txn_id")).join(d.edges, "txn_id").groupBy("ring_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "txn_id", "amount"))), lambda s: s["amount"]).alias("sparkline"))
    out = d.rings.join(amounts, "ring_id", "left").where(F.col("score") >= min_score)
    if kind:
        out = out.where(F.col("type") == kind)
    if bank:
        out = out.where(F.array_contains("banks", bank))
    if text:
        out = out.where(F.contains("ring_id", F.lit(text)) | F.exists(F.col("accounts").cast("array<string>"), lambda a: F.contains(a, F.lit(text))))
    columns = [order] if isinstance(order, str) else order
    up = [ascending] * len(columns) if isinstance(ascending, bool) else ascending
    keys = [F.col(c).asc() if a else F.col(c).desc() for c, a in zip(columns, up, strict=True)]
    return out.select("ring_id", "type", "score", risk_band(F.col("score")).alias("band"), F.size("accounts").alias("n_accounts"), "banks", "amount", "start_us", "end_us", "sparkline").orderBy(*keys, "ring_id")


def _ring(d: Detection, ring_id: str) -> DataFrame:
    return d.rings.where(F.col("ring_id") == ring_id)


def ring_edges(d: Detection, ring_id: str) -> DataFrame:
    return evidence.ring_transactions(d.edges, _ring(d, ring_id))


def ring_nodes(d: Detection, ring_id: str) -> DataFrame:
    """One ring's graph: members and up to 12 flagged neighbours, with score, degree, role and time layer."""
    return cases.nodes(d, _ring(d, ring_id)).drop("ring_id")


def account_detail(d: Detection, account) -> DataFrame:
    in_rings = d.rings.where(F.array_contains("accounts", F.lit(account))).agg(F.array_sort(F.collect_list("ring_id")).alias("rings"))
    return d.verdicts.where(F.col("account") == F.lit(account)).join(d.scores, "account", "left").crossJoin(in_rings)  # one row each


def trace_payment(d: Detection, txn_id, max_depth: int = 6, min_taint: float = 1.0) -> taint.Trace:
    """The trace of a payment of the ledger, 1 to 10 deep; an unknown payment is an error."""
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth must be from 1 to 10")
    if not d.edges.where(F.col("txn_id") == F.lit(txn_id)).limit(1).count():
        raise KeyError(f"no payment {txn_id}")
    return taint.trace(d.edges, txn_id=txn_id, max_depth=max_depth, min_taint=min_taint)


def account_timeline(d: Detection, account) -> DataFrame:
    return velocity.burst_timeline(d.edges, account=account).orderBy("bucket")


def verify_ring(d: Detection, ring_id: str, exported_hash: str | None = None) -> DataFrame:
    v = evidence.verify(evidence.chain(evidence.records(_ring(d, ring_id), d.edges)))
    return v.withColumn("matches_export", F.lit(None).cast("boolean") if exported_hash is None else F.col("final_hash") == exported_hash)


def dossier(d: Detection, ring_id: str) -> dict[str, DataFrame]:
    """Sections of a case file: story, payments (35), key accounts (10), reasons (two each of 6), chain, trace of the first payment."""
    ring = _ring(d, ring_id)
    return {
        "story": evidence.case_story(ring),
        "transactions": cases.payments(d, ring).drop("ring_id").orderBy("n"),
        "accounts": cases.key_accounts(d, ring).drop("ring_id").orderBy("pos"),
        "reasons": cases.reasons(d, ring).drop("ring_id").orderBy("pos", "n"),
        "chain": evidence.chain(evidence.records(ring, d.edges)),
        "trace": cases.traces(d, ring).drop("ring_id"),
    }


def dossier_markdown(d: Detection, ring_id: str) -> str:
    out = [f"# Case {ring_id}", ""]
    for name, df in dossier(d, ring_id).items():
        # Whole sections, a row at a time: a chain cut short couldn't be verified.
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in df.toLocalIterator()), ""]
    return "\n".join(out)


def flow_steps(e: DataFrame, accounts: DataFrame, buckets: int = 70) -> DataFrame:
    """``k, cum_in, cum_out, held``: cumulative flow into and out of a set of accounts at the ends of equal buckets of their time span, zero-filled."""
    inside = accounts.select("account")
    into = e.join(inside.withColumnRenamed("account", "dst"), "dst", "left_semi").select("us", F.col("amount").cast("decimal(18,2)").alias("i"), F.lit(0).cast("decimal(18,2)").alias("o"))
    out = e.join(inside.withColumnRenamed("account", "src"), "src", "left_semi").select("us", F.lit(0).cast("decimal(18,2)").alias("i"), F.col("amount").cast("decimal(18,2)").alias("o"))
    moves = into.unionByName(out)
    span = moves.agg(F.min("us").alias("t0"), F.max("us").alias("t1"))
    k = F.when(F.col("t1") == F.col("t0"), 0).otherwise(F.least(F.lit(buckets), F.floor((F.col("us") - F.col("t0")) * buckets / (F.col("t1") - F.col("t0")))))
    per = moves.crossJoin(F.broadcast(span)).groupBy(k.cast("long").alias("k")).agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    steps = e.sparkSession.range(buckets + 1).select(F.col("id").alias("k")).join(per, "k", "left").na.fill(0)
    w = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)  # 71 rows
    cin, cout = F.sum("i").over(w).cast("double"), F.sum("o").over(w).cast("double")
    return steps.select("k", F.coalesce(cin, F.lit(0.0)).alias("cum_in"), F.coalesce(cout, F.lit(0.0)).alias("cum_out"), F.coalesce(cin - cout, F.lit(0.0)).alias("held"))


def hop_delays(e: DataFrame) -> DataFrame:
    """``txn_id, delay_us``: time since the last earlier payment that touched the edge's source; null for its first."""
    touch = graph.endpoints(e).select("account", "us", "txn_id", (F.col("direction") == "out").alias("leaves")).groupBy("account", "us", "txn_id").agg(F.max("leaves").alias("leaves"))
    last = F.lag("us").over(W.partitionBy("account").orderBy("us", "txn_id"))
    return touch.withColumn("last", last).where("leaves").select("txn_id", (F.col("us") - F.col("last")).alias("delay_us"))


def is_fan(e: DataFrame) -> DataFrame:
    return graph.degrees(e).agg((F.max("degree") > 8).alias("fan"))


def replay(e: DataFrame, k: int) -> DataFrame:
    return e.orderBy("us", "txn_id").limit(k)


def rolling_detection(frontier: DataFrame) -> DataFrame:
    """Detection rate of the 7 schemes around each, by cost."""
    w = W.orderBy("friction", "scheme_id").rowsBetween(-3, 3)  # the grid's rows
    return frontier.select("scheme_id", "friction", rounded(F.avg(F.col("detected").cast("int")).over(w), 4).alias("rate"))


def cheapest_evaders(frontier: DataFrame, k: int = 6) -> DataFrame:
    return frontier.where(~F.col("detected")).orderBy("friction", "scheme_id").limit(k)


def sparkline(rings: DataFrame) -> DataFrame:
    """Amounts scaled to 0..1 by their range; a half where there is none."""
    low, high = F.array_min("sparkline"), F.array_max("sparkline")
    return rings.withColumn("scaled", F.transform("sparkline", lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.5)))


def scaled_series(e: DataFrame) -> DataFrame:
    """``account, pos, scaled``: each account's payments in order of time, amounts scaled to 0..1 by its range (a half where there is none).

    A row a payment: places are running counts, so an account of any length is dealt out.
    """
    sides = graph.endpoints(e).select("account", "us", "txn_id", "direction", "amount")
    placed = running(sides, ["account"], ["us", "txn_id", "direction"], {"pos": ("sum", F.lit(1))}, plain=is_small(e))
    span = sides.groupBy("account").agg(F.min("amount").alias("low"), F.max("amount").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("amount") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    return placed.join(span, "account").select("account", (F.col("pos") - 1).cast("int").alias("pos"), scaled.alias("scaled"))
