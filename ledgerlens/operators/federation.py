"""Bank-side signals under pseudonyms and their stitching into cross-bank cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings, Thresholds
from ..functions.scalars import amount_bucket, bucket_rank, hashed_account, rounded
from ..session import Staging
from ..sources.ledger import per_bank
from .hits import all_hits
from .scan import running


def local_hits(e: DataFrame, th: Thresholds = DEFAULTS) -> DataFrame:
    """Each bank's detectors over the payments that it sees, unfiltered and not deduplicated: one search keyed by bank."""
    return all_hits(per_bank(e), None, th, ("bank",))


def build_signals(hits: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per hit and account with a stable ``signal_id``; ``account_id`` stays with the bank."""
    salt = (settings or Settings()).salt
    acc = F.col("account_id")
    direction = F.when(F.coalesce(acc == F.col("origin"), F.lit(False)), "outbound").when(F.coalesce(acc == F.col("collector"), F.lit(False)) | F.coalesce(acc == F.col("terminal"), F.lit(False)), "inbound").otherwise("transit")
    x = F.when(F.col("type") == "smurfing", F.coalesce("structuring_score", F.lit(0.5))).when(F.col("type") == "cycle", 1 - F.coalesce("retention", F.lit(0.9))).otherwise(F.coalesce("retention", F.lit(0.9)))
    amount = F.coalesce(*[F.when(F.col(c) != 0, F.col(c)) for c in ("amount_start", "amount_in", "total_amount")], F.lit(0.0))
    s = hits.select("*", F.posexplode("accounts").alias("pos", "account_id")).select(
        "bank", hashed_account(acc, salt).alias("hashed_id"), F.col("type").alias("pattern_type"), direction.alias("direction"), "start_us", "end_us",
        amount_bucket(amount).alias("amount_bucket"), rounded(F.least(F.lit(100.0), 50 + 50 * x), 1).alias("pattern_score"), "account_id", "hit_id", "pos",
    )
    return s.withColumn("signal_id", F.concat_ws(":", "bank", "hit_id", F.col("pos").cast("string"))).drop("pos")


def coordinator_view(signals: DataFrame) -> DataFrame:
    return signals.drop("account_id")


def islands(signals: DataFrame) -> DataFrame:
    """Signals with ``island``: per type, runs of windows that overlap (closed).

    A type's distinct windows are summed up first (latest end per start). The latest end
    before each, and the count of windows that begin beyond it, are carried from range
    to range of the start times, so a type is never one sorted partition.
    """
    spans = Staging(signals.sparkSession, "islands").write(signals.groupBy("pattern_type", "start_us").agg(F.max("end_us").alias("last")))
    reached = running(spans, ["pattern_type"], ["start_us"], {"reach": ("max", F.col("last"))}, before=True)
    fresh = reached.withColumn("fresh", (F.col("reach").isNull() | (F.col("start_us") > F.col("reach"))).cast("int"))
    numbered = running(fresh, ["pattern_type"], ["start_us"], {"island": ("sum", F.col("fresh"))}).select("pattern_type", "start_us", "island")
    return signals.join(numbered, ["pattern_type", "start_us"])


@dataclass
class Stitched:
    """``cases``, one row each and none as wide as its case is large, and ``members``: ``case_id`` and all columns of its signals."""

    cases: DataFrame
    members: DataFrame


def stitch(signals: DataFrame, min_banks: int = 2) -> Stitched:
    """Cases: components of signals that share a pseudonym, or a type and overlapping windows; those of at least ``min_banks`` banks.

    Islands and pseudonyms form a bipartite graph of O(signals) edges; its components
    are found by label minima with jumps, each round two partial aggregates.
    """
    staging = Staging(signals.sparkSession, "stitch")
    s = staging.write(islands(signals).withColumn("left", F.concat_ws("#", "pattern_type", F.col("island").cast("string"))))
    edges = staging.write(s.select("left", F.col("hashed_id").alias("right")).distinct())
    label = staging.write(edges.groupBy("left").agg(F.min("left").alias("label")))
    while True:
        right = edges.join(label, "left").groupBy("right").agg(F.min("label").alias("label"))
        near = staging.write(edges.join(right, "right").groupBy("left").agg(F.min("label").alias("label")))
        new = staging.write(near.alias("a").join(near.select(F.col("left").alias("l"), F.col("label").alias("jump")), F.col("a.label") == F.col("l")).select("left", F.least("label", "jump").alias("label")))
        moved = new.join(label.select("left", F.col("label").alias("old")), "left").where("label <> old").limit(1).count()
        label = new
        if not moved:
            break
    members = staging.write(s.join(label, "left").select("label", *signals.columns))
    rank = bucket_rank(F.col("amount_bucket"))
    # Pseudonyms are counted one row each, in two partial aggregates; banks and types are few names.
    known = members.groupBy("label", "hashed_id").agg(F.count("*").alias("n")).groupBy("label").agg(F.count("*").cast("int").alias("n_accounts"))
    groups = members.groupBy("label").agg(
        F.array_sort(F.collect_set("bank")).alias("banks"), F.array_sort(F.collect_set("pattern_type")).alias("pattern_types"),
        F.min("start_us").alias("window_start_us"), F.max("end_us").alias("window_end_us"), F.max_by("amount_bucket", rank).alias("amount_bucket"), F.count("*").alias("n_signals"), F.min("signal_id").alias("first_signal"),
    ).where(F.size("banks") >= min_banks).join(known, "label")
    numbered = running(groups, [], ["first_signal"], {"number": ("sum", F.lit(1))})
    cases = staging.write(numbered.withColumn("case_id", F.format_string("FED-%02d", F.col("number"))).drop("number", "first_signal"))
    own = members.join(cases.select("label", "case_id"), "label").drop("label")
    return Stitched(cases.drop("label").orderBy(F.desc("n_signals"), "case_id"), own.select("case_id", *signals.columns))


def case_pseudonyms(stitched: Stitched) -> DataFrame:
    """``case_id, hashed_id, n_signals, banks, pattern_types, first_us, last_us, pattern_score``: a case's signals grouped by pseudonym."""
    return stitched.members.groupBy("case_id", "hashed_id").agg(
        F.count("*").alias("n_signals"), F.array_sort(F.collect_set("bank")).alias("banks"), F.array_sort(F.collect_set("pattern_type")).alias("pattern_types"),
        F.min("start_us").alias("first_us"), F.max("end_us").alias("last_us"), F.max("pattern_score").alias("pattern_score"),
    )


def reveal(signals: DataFrame, hashed_id: str, requester: str) -> DataFrame:
    """The account behind a pseudonym and its banks, for a named requester (mock authorisation: a name of 3 characters or more)."""
    if len(requester.strip()) < 3:
        raise PermissionError("a requester's name of at least 3 characters is needed")
    return signals.where(F.col("hashed_id") == hashed_id).groupBy("hashed_id").agg(F.min("account_id").alias("account_id"), F.array_sort(F.collect_set("bank")).alias("banks"), F.lit(requester.strip()).alias("requester"))


def summary(signals: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Signals per bank, zero-filled."""
    names = signals.sparkSession.createDataFrame([(b,) for b in (settings or Settings()).banks], "bank string")
    return names.join(signals.groupBy("bank").agg(F.count("*").alias("n")), "bank", "left").select("bank", F.coalesce("n", F.lit(0)).alias("n_signals"))
