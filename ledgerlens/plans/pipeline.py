"""The detection run: filter, detect, deduplicate, score, evaluate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..operators import fingerprint, graph, hits, iforest, scoring, velocity
from ..session import Staging, at_once


@dataclass
class Detection:
    """All results of a run, as tables in the shared folder."""

    edges: DataFrame
    accounts: DataFrame
    verdicts: DataFrame
    features: DataFrame
    hits: DataFrame
    scores: DataFrame
    rings: DataFrame


def detect(edges: DataFrame, th: Thresholds = DEFAULTS, anomaly: DataFrame | None = None, run: Column | None = None) -> Detection:
    """``anomaly(account, anomaly)`` replaces the isolation forest's percentiles where given.

    ``run``: of an account its ledger, where ``edges`` holds several that share no account (see
    ``benchmark.in_runs``); each has a forest and percentiles of its own. All else follows from that.
    """
    staging = Staging(edges.sparkSession, "detection")
    e = staging.write(edges)
    verdicts = staging.write(fingerprint.verdicts(fingerprint.fingerprints(e), th))
    suspects = fingerprint.suspects(verdicts)
    kept, features, accounts = at_once(
        lambda: staging.write(hits.dedup_hits(hits.all_hits(e, suspects, th))),
        lambda: staging.write(velocity.velocity_features(e).join(suspects, "account", "left_semi")),
        lambda: staging.write(graph.accounts(e)),
    )
    if anomaly is not None:
        ranks = anomaly
    elif run is not None:
        ranks = iforest.percentile_rank(iforest.anomaly(features.withColumn("run", run), part=("run",)), part=("run",)).drop("run")
    else:
        ranks = iforest.percentile_rank(iforest.anomaly(features))
    scores = staging.write(scoring.account_scores(suspects, scoring.pattern_scores(kept), ranks, features))
    rings = staging.write(scoring.rings(scoring.ring_scores(kept, scores), accounts))
    return Detection(e, accounts, verdicts, features, kept, scores, rings)


def evaluate(d: Detection, truth: DataFrame, decoys: DataFrame, th: Thresholds = DEFAULTS, least: float = 0.5) -> dict[str, DataFrame]:
    """Quality with the benign filter and without it (``phase``), false alarms on look-alikes, and counts."""
    unfiltered = hits.dedup_hits(hits.all_hits(d.edges, None, th)).withColumn("ring_id", F.concat_ws(":", "type", F.col("dedup_rank").cast("string")))
    metrics = hits.prf(d.rings, truth, least).withColumn("phase", F.lit("filtered")).unionByName(hits.prf(unfiltered, truth, least).withColumn("phase", F.lit("unfiltered")))
    counts = truth.agg(F.count("*").alias("truth")).crossJoin(d.rings.agg(F.count("*").alias("filtered"))).crossJoin(unfiltered.agg(F.count("*").alias("unfiltered")))  # one row each
    return {"metrics": metrics, "decoys": hits.decoy_alarms(decoys, d.rings), "counts": counts}
