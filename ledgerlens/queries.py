"""Registered queries of the ledger engine over the ``events`` ledger, and their oracle SQL.

Payments there are small, so the reporting threshold is 100; all other thresholds
are the defaults. Arrays are shown as joined text, sums go through decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .config import DEFAULTS
from .functions.scalars import amount_bucket, hashed_account, risk_band, rounded
from .operators import adversary, evidence, federation, fingerprint, graph, hits, iforest, scan, scoring, taint, velocity
from .operators.chains import detect_chains
from .operators.cycles import detect_cycles
from .operators.graph import path_text
from .operators.smurfing import detect_smurfing, windows
from .plans import benchmark, datagen, pipeline, views
from .session import shared_dir
from .sources.ledger import events_ledger, per_bank

TH = replace(DEFAULTS, reporting=100.0)
SALT = "ledgerlens-demo-salt"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LEDGER = """ledger AS (
  SELECT event_id AS txn_id, ts, epoch_us(ts) AS us, user_id AS src,
         (user_id * 31 + event_id * 17 + 7) % (SELECT max(user_id) + 1 FROM events) AS dst, value AS amount, event_type AS channel
  FROM events
), edges AS (
  SELECT *, 'Bank' || substr('ABC', CAST(src % 3 + 1 AS INTEGER), 1) AS bank_src, 'Bank' || substr('ABC', CAST(dst % 3 + 1 AS INTEGER), 1) AS bank_dst FROM ledger
), act AS (
  SELECT src AS account, 'out' AS direction, dst AS cp, bank_src AS bank, txn_id, us, ts, amount FROM edges
  UNION ALL SELECT dst, 'in', src, bank_dst, txn_id, us, ts, amount FROM edges
)"""


def query(sql: str | None = None, recursive: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{_LEDGER}{sql}"
        return f

    return register


@query(" SELECT txn_id, ts, src, dst, amount, bank_src, bank_dst, channel FROM edges")
def ledger(spark, d):
    return events_ledger(spark, d).drop("us")


@query(" SELECT account, arg_min(bank, us * 4 + CASE direction WHEN 'out' THEN 0 ELSE 1 END) AS bank FROM act GROUP BY account")
def accounts(spark, d):
    return graph.accounts(events_ledger(spark, d))


@query(" SELECT bank, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM (SELECT DISTINCT bank, txn_id, amount FROM act) GROUP BY bank")
def per_bank_counts(spark, d):
    return per_bank(events_ledger(spark, d)).groupBy("bank").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@query(" SELECT account, count(*) AS degree FROM act GROUP BY account")
def degree(spark, d):
    return graph.degrees(events_ledger(spark, d))


_FP = """, pairs AS (SELECT account, cp, count(*) AS c FROM act GROUP BY 1, 2),
rep AS (SELECT account, count(*) AS counterparty_diversity, round(sum(CASE WHEN c >= 2 THEN c ELSE 0 END) / sum(c), 3) AS repeat_counterparty_ratio, round(sum(CASE WHEN c >= 3 THEN c ELSE 0 END) / sum(c), 3) AS periodic_fraction FROM pairs GROUP BY 1),
sums AS (SELECT account, count(*) AS n_txns, CAST(coalesce(sum(CASE direction WHEN 'in' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS in_sum, CAST(coalesce(sum(CASE direction WHEN 'out' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS out_sum, min(us) AS t0 FROM act GROUP BY 1),
gaps AS (SELECT account, (us - lag(us) OVER (PARTITION BY account ORDER BY us, txn_id)) / 1e6 AS g FROM act WHERE direction = 'in'),
cv AS (SELECT account, round(CASE WHEN count(*) < 3 OR avg(g) = 0 THEN 1.0 ELSE stddev_pop(g) / avg(g) END, 3) AS cv_inter_arrival FROM gaps GROUP BY 1),
days AS (SELECT a.account, (a.us - s.t0) // 86400000000 AS day, count(*) AS c FROM act a JOIN sums s USING (account) GROUP BY 1, 2),
dv AS (SELECT account, greatest(90, max(day) + 1) AS l, sum(c) AS n, sum(c * c) AS q FROM days GROUP BY 1),
fp AS (SELECT s.account, CAST(n_txns AS BIGINT) AS n_txns, counterparty_diversity, coalesce(cv_inter_arrival, 1.0) AS cv_inter_arrival, round(sqrt(greatest(0.0, q / l - pow(n / l, 2))) / (n / l), 3) AS daily_volume_cv, repeat_counterparty_ratio, periodic_fraction,
  CASE WHEN in_sum > 0 THEN round(out_sum / in_sum, 3) END AS pass_through_ratio, CASE WHEN in_sum > 0 AND out_sum > 0 THEN round(in_sum / out_sum, 3) END AS in_out_ratio, round(in_sum, 2) AS in_sum, round(out_sum, 2) AS out_sum
  FROM sums s JOIN rep USING (account) JOIN dv USING (account) LEFT JOIN cv USING (account)),
verdict AS (SELECT *, CASE WHEN n_txns < 5 THEN 'thin' WHEN counterparty_diversity < 5 THEN 'narrow' WHEN coalesce(pass_through_ratio > 0.9 AND repeat_counterparty_ratio < 0.8, FALSE) THEN 'mule-like' WHEN NOT (daily_volume_cv <= 0.8 OR repeat_counterparty_ratio >= 0.3) THEN 'erratic' ELSE 'steady' END AS rule FROM fp)"""


@query(_FP + " SELECT * FROM fp")
def fingerprints(spark, d):
    return fingerprint.fingerprints(events_ledger(spark, d))


@query(_FP + " SELECT account, rule, rule = 'steady' AS benign FROM verdict")
def benign_verdicts(spark, d):
    return fingerprint.verdicts(fingerprint.fingerprints(events_ledger(spark, d))).select("account", "rule", "benign")


@query(_FP + " SELECT count(*) AS total, count(*) FILTER (rule = 'steady') AS benign, count(*) FILTER (rule <> 'steady') AS suspect FROM verdict")
def filter_counts(spark, d):
    return fingerprint.filter_counts(fingerprint.verdicts(fingerprint.fingerprints(events_ledger(spark, d))))


_VEL = """, tph AS (SELECT account, count(*) AS txn_count, CASE WHEN count(*) < 2 THEN CAST(count(*) AS DOUBLE) ELSE (count(*) - 1) / greatest((max(us) - min(us)) / 3600000000, 1.0) END AS txns_per_hour FROM act GROUP BY 1),
burst AS (SELECT account, max(c) AS peak_burst_rate FROM (SELECT account, count(*) OVER (PARTITION BY account ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS c FROM act) GROUP BY 1),
held AS (SELECT i.dst AS account, i.txn_id, min(o.us) - min(i.us) AS h FROM edges i JOIN edges o ON o.src = i.dst AND o.us > i.us AND o.amount >= i.amount * 0.75 AND o.amount <= i.amount * 1.25 GROUP BY 1, 2),
hold AS (SELECT account, median(h / 60000000) AS median_hold_min FROM held GROUP BY 1),
flow AS (SELECT account, CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (direction = 'in') AS DOUBLE) AS i, CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (direction = 'out') AS DOUBLE) AS o, count(*) FILTER (direction = 'in') AS n, max(amount) FILTER (direction = 'in') AS amount_max FROM act GROUP BY 1)"""


@query(_VEL + " SELECT account, txn_count, round(txns_per_hour, 6) AS txns_per_hour FROM tph")
def txns_per_hour(spark, d):
    return velocity.txns_per_hour(events_ledger(spark, d)).withColumn("txns_per_hour", rounded("txns_per_hour", 6))


@query(_VEL + " SELECT * FROM burst")
def peak_burst_rate(spark, d):
    return velocity.peak_burst_rate(events_ledger(spark, d))


@query(_VEL + " SELECT account, round(median_hold_min, 4) AS median_hold_min FROM hold")
def median_hold_time(spark, d):
    return velocity.median_hold(events_ledger(spark, d)).withColumn("median_hold_min", rounded("median_hold_min", 4))


@query(_VEL + " SELECT account, CAST(txn_count AS DOUBLE) AS txn_count, round(txns_per_hour, 4) AS txns_per_hour, CAST(peak_burst_rate AS DOUBLE) AS peak_burst_rate, round(coalesce(CASE WHEN i > 0 THEN coalesce(o, 0) / i END, 0), 4) AS pass_through_ratio, round(coalesce(median_hold_min, -1), 4) AS median_hold_min, round(coalesce(i / n, 0), 4) AS amount_mean, round(coalesce(amount_max, 0), 4) AS amount_max FROM tph JOIN burst USING (account) JOIN flow USING (account) LEFT JOIN hold USING (account)")
def velocity_features(spark, d):
    v = velocity.velocity_features(events_ledger(spark, d))
    return v.select("account", *[c if c in ("txn_count", "peak_burst_rate") else rounded(c, 4).alias(c) for c in v.columns if c != "account"])


@query(" SELECT account, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS bucket, count(*) AS n FROM act GROUP BY 1, 2")
def burst_timeline_6h(spark, d):
    return velocity.burst_timeline(events_ledger(spark, d)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


_CYCLES = """, e AS (SELECT src, dst, us, amount, txn_id FROM edges WHERE src <> dst),
paths(path, tail, t0, t, a0, a, txns) AS (
  SELECT [src, dst], dst, us, us, amount, amount, [txn_id] FROM e
  UNION ALL
  SELECT list_append(path, e.dst), e.dst, t0, e.us, a0, e.amount, list_append(txns, e.txn_id) FROM paths JOIN e ON e.src = tail
  WHERE len(path) < 6 AND e.us >= t AND e.us - t0 <= 259200000000 AND e.amount <= a * 1.02 AND NOT list_contains(path, e.dst)
), closed AS (
  SELECT path, list_append(txns, e.txn_id) AS txns, t0, e.us AS t1, a0, e.amount AS a1, e.amount / a0 AS ratio FROM paths JOIN e ON e.src = tail AND e.dst = path[1]
  WHERE e.us >= t0 AND e.us - t0 <= 259200000000 AND e.amount <= a * 1.02 AND e.amount / a0 >= 0.85
), cycles AS (SELECT * FROM closed QUALIFY row_number() OVER (PARTITION BY list_sort(path) ORDER BY ratio DESC, t0, txns) = 1)"""


@query(_CYCLES + " SELECT array_to_string(path, ',') AS accounts, array_to_string(txns, ',') AS txn_ids, t0 AS start_us, t1 AS end_us, round(ratio, 4) AS retention, round((t1 - t0) / 3600000000, 2) AS window_hours, CAST(len(path) - 1 AS INTEGER) AS length FROM cycles", recursive=True)
def cycles(spark, d):
    c = detect_cycles(events_ledger(spark, d), None, TH)
    return c.select(path_text(F.col("accounts")).alias("accounts"), path_text(F.col("txn_ids")).alias("txn_ids"), "start_us", "end_us", "retention", "window_hours", "length")


_CHAINS = """, chain_paths(path, tail, t0, t, a0, a, txns) AS (
  SELECT [src, dst], dst, us, us, amount, amount, [txn_id] FROM edges
  UNION ALL
  SELECT list_append(path, e.dst), e.dst, t0, e.us, a0, e.amount, list_append(txns, e.txn_id) FROM chain_paths JOIN edges e ON e.src = tail
  WHERE e.us BETWEEN t AND t + 7200000000 AND e.amount >= a * 0.85 AND NOT list_contains(path, e.dst)
), chains AS (SELECT * FROM chain_paths WHERE len(txns) >= 3 QUALIFY row_number() OVER (PARTITION BY list_sort(list_distinct(path)) ORDER BY len(path) DESC, t0, txns) = 1)"""


@query(_CHAINS + " SELECT array_to_string(path, ',') AS accounts, array_to_string(txns, ',') AS txn_ids, CAST(len(txns) AS INTEGER) AS length, round((t - t0) / 60000000, 1) AS total_delay_min, CASE WHEN a0 <> 0 THEN round(a / a0, 4) ELSE 0.0 END AS retention FROM chains", recursive=True)
def mule_chains(spark, d):
    c = detect_chains(events_ledger(spark, d), None, TH)
    return c.select(path_text(F.col("accounts")).alias("accounts"), path_text(F.col("txn_ids")).alias("txn_ids"), "length", "total_delay_min", "retention")


_SMURF = """, dep AS (SELECT * FROM edges WHERE amount >= 50 AND amount < 100),
win AS (
  SELECT b.dst, b.us, b.txn_id, count(*) AS n, count(DISTINCT a.src) AS contributors, avg(CASE WHEN a.amount BETWEEN 80 AND 99.5 THEN 1.0 ELSE 0.0 END) AS score, min(a.us) AS start_us, sum(CAST(a.amount AS DECIMAL(18,2))) AS total
  FROM dep b JOIN dep a ON a.dst = b.dst AND a.us BETWEEN b.us - 604800000000 AND b.us GROUP BY 1, 2, 3
), ok AS (SELECT * FROM win WHERE n >= 10 AND contributors >= 10),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, score DESC, us, txn_id) = 1),
since AS (SELECT *, min(us) OVER (PARTITION BY src, dst) AS since FROM edges),
cons AS (SELECT b.dst AS collector, s.txn_id, s.dst AS receiver, s.amount FROM best b JOIN since s ON s.src = b.dst AND s.us >= b.start_us AND s.amount >= CAST(b.total AS DOUBLE) * 0.3 QUALIFY row_number() OVER (PARTITION BY b.dst ORDER BY since, s.us, s.txn_id) = 1)"""


@query(_SMURF + " SELECT dst AS collector, count(*) AS windows, max(n) AS most FROM ok GROUP BY 1")
def smurf_windows(spark, d):
    return windows(events_ledger(spark, d), None, TH).groupBy(F.col("dst").alias("collector")).agg(F.count("*").alias("windows"), F.max("n").alias("most"))


@query(_SMURF + " SELECT dst AS collector, start_us, us AS end_us, n AS n_deposits, CAST(contributors AS INTEGER) AS n_contributors, round(score, 3) AS structuring_score, CAST(total AS DOUBLE) AS total_amount, round((us - start_us) / 86400000000, 2) AS window_days FROM best")
def smurfing(spark, d):
    return detect_smurfing(events_ledger(spark, d), None, TH).select("collector", "start_us", "end_us", "n_deposits", "n_contributors", "structuring_score", "total_amount", "window_days")


@query(_SMURF + " SELECT b.dst AS collector, c.txn_id AS consolidation_txn, c.receiver AS consolidation_to, round(c.amount, 2) AS consolidation_amount FROM best b LEFT JOIN cons c ON c.collector = b.dst")
def smurf_consolidation(spark, d):
    return detect_smurfing(events_ledger(spark, d), None, TH).select("collector", "consolidation_txn", "consolidation_to", "consolidation_amount")


_EVIDENCE = (
    _CYCLES
    + _CHAINS
    + _SMURF
    + """, points AS (
  SELECT unnest(path) AS account, 40.0 AS p FROM cycles
  UNION ALL SELECT unnest(path[2:-2]), 30.0 FROM chains UNION ALL SELECT path[1], 20.0 FROM chains UNION ALL SELECT path[-1], 20.0 FROM chains
  UNION ALL SELECT dst, 55.0 FROM best UNION ALL SELECT DISTINCT ON (b.dst, a.src) a.src, 25.0 FROM best b JOIN dep a ON a.dst = b.dst AND a.us BETWEEN b.start_us AND b.us
)"""
)


@query(_EVIDENCE + " SELECT account, CAST(least(100.0, sum(p)) AS DOUBLE) AS pattern_score FROM points GROUP BY 1", recursive=True)
def pattern_evidence(spark, d):
    return scoring.pattern_scores(hits.all_hits(events_ledger(spark, d), None, TH)).select("account", "pattern_score")


@query()
def dedup_hits(spark, d):
    h = hits.dedup_hits(hits.all_hits(events_ledger(spark, d), None, TH))
    return h.select("type", "dedup_rank", path_text(F.col("accounts")).alias("accounts"), "hit_id")


@query()
def isolation_forest(spark, d):
    """The anomaly of every account, grown and walked over all of them."""
    return iforest.anomaly(velocity.velocity_features(events_ledger(spark, d))).withColumn("raw", rounded("raw", 9))


@query(" SELECT account, 100.0 * (row_number() OVER (ORDER BY v, account) - 1) / greatest(count(*) OVER () - 1, 1) AS anomaly FROM (SELECT account, max(amount) AS v FROM act GROUP BY 1)")
def percentile_rank(spark, d):
    v = graph.endpoints(events_ledger(spark, d)).groupBy("account").agg(F.max("amount").alias("raw"))
    return iforest.percentile_rank(v)


def _detection(spark, d) -> pipeline.Detection:
    return pipeline.detect(events_ledger(spark, d), TH)


@query()
def ring_list(spark, d):
    r = views.ring_list(_detection(spark, d))
    return r.withColumn("banks", path_text(F.col("banks"))).drop("sparkline")


@query()
def account_scores(spark, d):
    return _detection(spark, d).scores.select("account", "score", "pattern_score", "anomaly_score", F.array_join("reasons", "; ").alias("reasons"))


@query()
def summary(spark, d):
    return views.summary(_detection(spark, d))


_SETS = """, one AS (SELECT src, list_sort(list_distinct(list(dst))) AS s FROM edges GROUP BY 1),
sets AS (SELECT min(src) AS src, count(*) AS members, s FROM one GROUP BY s),
flat AS (SELECT src, unnest(s) AS x FROM sets), sizes AS (SELECT src, members, len(s) AS n FROM sets)"""


@query(_SETS + " SELECT a.src AS a, b.src AS b, any_value(p.members) AS members_a, any_value(q.members) AS members_b, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS jaccard FROM flat a JOIN flat b ON a.x = b.x AND a.src < b.src JOIN sizes p ON p.src = a.src JOIN sizes q ON q.src = b.src GROUP BY 1, 2 HAVING count(*) / (any_value(p.n) + any_value(q.n) - count(*)) >= 0.25")
def jaccard_pairs(spark, d):
    """Classes of accounts with the same receivers, paired where these overlap: the set-similarity join behind ring matching."""
    return hits.similar_sets(events_ledger(spark, d).select(F.col("src").alias("account"), F.col("dst").alias("item")), 0.25)


def _seed(spark, d) -> int:
    return events_ledger(spark, d).orderBy(F.desc("amount"), "txn_id").select("txn_id").first()[0]


@query()
def taint_trace(spark, d):
    t = taint.trace(events_ledger(spark, d), txn_id=_seed(spark, d), max_depth=4, min_taint=5.0).nodes
    return t.select(path_text(F.col("bundle")).alias("bundle"), "depth", "txn_id", "src", "dst", "taint", "fraction")


@query()
def taint_terminals(spark, d):
    return taint.trace(events_ledger(spark, d), txn_id=_seed(spark, d), max_depth=4, min_taint=5.0).terminals


@query(", top AS (SELECT * FROM edges ORDER BY amount DESC, txn_id LIMIT 50) SELECT t.txn_id, t.dst AS holder, round(greatest(0.0, CAST(coalesce((SELECT sum(CAST(amount AS DECIMAL(18,2))) FROM edges i WHERE i.dst = t.dst AND i.us <= t.us AND i.txn_id <> t.txn_id), 0) - coalesce((SELECT sum(CAST(amount AS DECIMAL(18,2))) FROM edges o WHERE o.src = t.dst AND o.us < t.us), 0) AS DOUBLE)), 2) AS clean FROM top t")
def clean_pool_asof(spark, d):
    """Balance of the receivers of the 50 largest payments just as they arrive: an as-of aggregate."""
    e = events_ledger(spark, d)
    top = e.orderBy(F.desc("amount"), "txn_id").limit(50).select(F.col("txn_id").alias("bundle"), F.col("dst").alias("holder"), F.col("us").alias("at"), F.col("amount").alias("own"))
    return taint.clean_pool(e, top, scan.is_small(e)).join(top, "bundle").select(F.col("bundle").alias("txn_id"), "holder", rounded("clean", 2).alias("clean"))


@query(" SELECT account, substr(sha256(unhex(opad) || unhex(sha256(unhex(ipad) || encode(CAST(account AS VARCHAR))))), 1, 16) AS hashed_id, bucket FROM (SELECT account, max(amount) AS m, CASE WHEN max(amount) < 1000 THEN '<1k' WHEN max(amount) < 10000 THEN '1k-10k' WHEN max(amount) < 100000 THEN '10k-100k' ELSE '100k+' END AS bucket FROM act GROUP BY 1), (SELECT '" + "".join(f"{b ^ 0x36:02x}" for b in SALT.encode().ljust(64, b"\0")) + "' AS ipad, '" + "".join(f"{b ^ 0x5C:02x}" for b in SALT.encode().ljust(64, b"\0")) + "' AS opad)")
def hashed_accounts(spark, d):
    a = graph.endpoints(events_ledger(spark, d)).groupBy("account").agg(F.max("amount").alias("m"))
    return a.select("account", hashed_account(F.col("account"), SALT).alias("hashed_id"), amount_bucket(F.col("m")).alias("bucket"))


@query()
def federated_signals(spark, d):
    return federation.coordinator_view(federation.build_signals(federation.local_hits(events_ledger(spark, d), TH)))


@query()
def federated_cases(spark, d):
    c = federation.stitch(federation.build_signals(federation.local_hits(events_ledger(spark, d), TH))).cases
    return c.select("case_id", path_text(F.col("banks")).alias("banks"), path_text(F.col("pattern_types")).alias("pattern_types"), "n_accounts", "n_signals", "amount_bucket", "window_start_us", "window_end_us")


_GRID = "SELECT CAST(row_number() OVER (ORDER BY d.i, s.i, c.i, b.i) - 1 AS INTEGER) AS scheme_id, CAST(d.v AS DOUBLE) AS hop_delay_hours, s.v AS n_splits, CASE WHEN s.v > 1 THEN 0.1 ELSE 0.0 END AS jitter, c.v AS n_decoys, b.v AS n_banks, 2.0 AS fee_pct FROM (VALUES (0, 0), (1, 6), (2, 24), (3, 48)) d(i, v), (VALUES (0, 1), (1, 4)) s(i, v), (VALUES (0, 0), (1, 20)) c(i, v), (VALUES (0, 1), (1, 3)) b(i, v)"


def _route(spark, d) -> tuple[DataFrame, DataFrame, str, str, datetime]:
    """The events ledger with text accounts, its suspects, the two quiet accounts that schemes run between, and the middle of its time."""
    e = events_ledger(spark, d)
    e = e.withColumn("txn_id", F.col("txn_id").cast("string")).withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string"))
    suspects = fingerprint.suspects(fingerprint.verdicts(fingerprint.fingerprints(e)))
    ends = [r.account for r in suspects.orderBy("account").limit(2).collect()] or ["0", "1"]
    hour = e.agg(F.expr("(min(us) + max(us)) div 2 div 3600000000")).first()[0] or 0
    return e, suspects, ends[0], ends[-1], datetime(1970, 1, 1) + timedelta(hours=hour)


@query()
def scheme_grid(spark, d):
    """The default grid with each scheme's friction and the payments it injects into the ledger."""
    e, _, source, target, base = _route(spark, d)
    grid = adversary.default_grid()
    injected = adversary.injections(e, grid, source, target, 120.0, base_time=base).groupBy("scheme_id").agg(F.count("*").alias("n_payments"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"), F.countDistinct("src").alias("payers"))
    return adversary.friction_table(adversary.scheme_grid_table(spark, grid)).join(injected, "scheme_id")


def _searched(spark, d, grid: list[adversary.Scheme] | None = None) -> adversary.Report:
    """The search of a grid (the default one) along that route; kept by the content of what it reads."""
    e, suspects, source, target, base = _route(spark, d)
    grid = grid if grid is not None else adversary.default_grid()
    about = adversary.manifest({"source": source, "target": target, "amount": 120.0, "base": base, "thresholds": TH, "grid": grid}, ledger=e, suspects=suspects)
    return adversary.kept_report(spark, f"{shared_dir(spark)}/adversary", about, lambda: adversary.run(e, suspects, source, target, 120.0, grid, th=TH, base_time=base))


@query()
def friction_frontier(spark, d):
    """All 32 schemes of the default grid over the events ledger with text accounts."""
    return _searched(spark, d).frontier.select("scheme_id", "hop_delay_hours", "n_splits", "friction", "detected", F.coalesce("evidence", F.lit("")).alias("evidence"))


@query()
def friction_summary(spark, d):
    """What the search comes to: the naive scheme, the cheapest evader's friction, and that after hardening against it."""
    r = _searched(spark, d)
    head = [(r.baseline_detected, r.friction_before, r.friction_after, r.n_schemes, float(r.hardened.get("chain_max_delay_min", TH.chain_max_delay_min)), r.hardened.get("chain_min_forward", TH.chain_min_forward))]
    return spark.createDataFrame(head, "baseline_detected boolean, friction_before double, friction_after double, n_schemes int, chain_max_delay_min double, chain_min_forward double")


@query(
    _CHAINS
    + """, rec AS (
  SELECT array_to_string(c.path, ',') AS accounts, e.amount, e.txn_id, list_position(c.txns, e.txn_id) AS pos FROM chains c, LATERAL (SELECT unnest(c.txns) AS t) u JOIN edges e ON e.txn_id = u.t
) SELECT accounts, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM rec GROUP BY 1""",
    recursive=True,
)
def ring_transactions(spark, d):
    """Payments behind each chain, counted and summed."""
    e = events_ledger(spark, d)
    c = detect_chains(e, None, TH).select(path_text(F.col("accounts")).alias("accounts"), F.explode("txn_ids").alias("txn_id"))
    return c.join(e, "txn_id").groupBy("accounts").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@query()
def evidence_chain(spark, d):
    det = _detection(spark, d)
    return evidence.chain(evidence.records(det.rings, det.edges))


@query(" SELECT DISTINCT account FROM (SELECT dst AS account FROM edges WHERE src IN (1, 2, 3) UNION SELECT src FROM edges WHERE dst IN (1, 2, 3)) WHERE account NOT IN (1, 2, 3) ORDER BY account LIMIT 12")
def neighbours(spark, d):
    return graph.neighbours(events_ledger(spark, d), spark.createDataFrame([(1,), (2,), (3,)], "account long"))


@query(
    """, m AS (SELECT us, CASE WHEN dst < 10 THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END AS i, CASE WHEN src < 10 THEN CAST(amount AS DECIMAL(18,2)) ELSE 0 END AS o FROM edges WHERE src < 10 OR dst < 10),
sp AS (SELECT min(us) AS t0, max(us) AS t1 FROM m), b AS (SELECT least(70, CAST(floor((us - t0) * 70 / (t1 - t0)) AS BIGINT)) AS k, sum(i) AS i, sum(o) AS o FROM m, sp GROUP BY 1),
s AS (SELECT r.k, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM (SELECT unnest(range(71)) AS k) r LEFT JOIN b USING (k))
SELECT k, CAST(sum(i) OVER w AS DOUBLE) AS cum_in, CAST(sum(o) OVER w AS DOUBLE) AS cum_out, CAST(sum(i - o) OVER w AS DOUBLE) AS held FROM s WINDOW w AS (ORDER BY k)"""
)
def flow_step_series(spark, d):
    return views.flow_steps(events_ledger(spark, d), spark.range(10).select(F.col("id").alias("account")))


@query(", t AS (SELECT account, us, txn_id, bool_or(direction = 'out') AS leaves FROM act GROUP BY 1, 2, 3), l AS (SELECT *, lag(us) OVER (PARTITION BY account ORDER BY us, txn_id) AS last FROM t) SELECT txn_id, us - last AS delay_us FROM l WHERE leaves")
def hop_delays(spark, d):
    return views.hop_delays(events_ledger(spark, d))


@query()
def rolling_detection_rate(spark, d):
    """The detection rate of the schemes around each, by cost, as the search found them."""
    return views.rolling_detection(_searched(spark, d).frontier)


@query()
def cheapest_evaders(spark, d):
    """The six cheapest schemes that the search didn't detect."""
    return views.cheapest_evaders(_searched(spark, d).frontier).select("scheme_id", "friction")


@query(" SELECT channel, bank_src, round(avg(amount), 4) AS mean, round(coalesce(stddev_samp(amount), 0), 4) AS std, count(*) AS n FROM edges GROUP BY GROUPING SETS ((channel, bank_src), (bank_src))")
def benchmark_rollup(spark, d):
    """Mean and sample deviation by two keys and pooled over one: the shape of the benchmark's aggregation."""
    e = events_ledger(spark, d)
    return e.groupingSets([["channel", "bank_src"], ["bank_src"]], "channel", "bank_src").agg(rounded(F.avg("amount"), 4).alias("mean"), rounded(F.coalesce(F.stddev_samp("amount"), F.lit(0.0)), 4).alias("std"), F.count("*").alias("n"))


@query(" SELECT txn_id, row_number() OVER (ORDER BY us, txn_id) AS seq FROM edges QUALIFY seq <= 100")
def replay(spark, d):
    e = views.replay(events_ledger(spark, d), 100)
    return e.select("txn_id", F.row_number().over(W.orderBy("us", "txn_id")).cast("long").alias("seq"))  # 100 rows


@query(" SELECT o_orderpriority, n_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (o_orderpriority, n_name)")
def orders_rollup(spark, d):
    o, c, n = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.rollup("o_orderpriority", "n_name").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def _persons(spark, d) -> int:
    """Accounts a bank of a ledger made for the customers at hand: one for each fifty, beside the 60 of a small bank."""
    return 60 + spark.read.parquet(f"{d}/customer.parquet").count() // 50


@query()
def generated_ring_quality(spark, d):
    """Precision and recall of the whole run on a ledger generated for the table's customers, half the noise, with injected rings."""
    return benchmark.run_one(spark, 42, 0.5, _persons(spark, d))


@query()
def generated_ledger(spark, d):
    return datagen.generate(spark, 7, 0.3, _persons(spark, d), 1)[0].groupBy("bank_src", "channel").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@query(_VEL + " SELECT account, round(CASE WHEN i > 0 THEN coalesce(o, 0) / i END, 4) AS pass_through_ratio FROM flow")
def pass_through(spark, d):
    return velocity.flows(events_ledger(spark, d)).select("account", rounded("pass_through_ratio", 4).alias("pass_through_ratio"))


@query(" SELECT txn_id, src, dst, amount FROM edges WHERE txn_id = 42")
def edge_lookup(spark, d):
    return graph.edge(events_ledger(spark, d), 42).select("txn_id", "src", "dst", "amount")


@query(" SELECT channel, count(*) AS n FROM edges WHERE src % 2 = 0 AND dst % 2 = 0 GROUP BY 1")
def induced_edges(spark, d):
    """Payments between accounts of even number, by channel."""
    e = events_ledger(spark, d)
    return graph.induced(e, graph.endpoints(e).select("account").where("account % 2 = 0")).groupBy("channel").agg(F.count("*").alias("n"))


@query(" SELECT max(c) > 8 AS fan FROM (SELECT account, count(*) AS c FROM act GROUP BY 1)")
def fan_shape(spark, d):
    """Whether any account of the whole ledger has more than eight payments."""
    return views.is_fan(events_ledger(spark, d))


def _probes(spark) -> DataFrame:
    """Twenty accounts as known look-alikes, and one that has no payment."""
    return spark.range(20).unionByName(spark.range(10**9, 10**9 + 1)).select(F.col("id").alias("account"), F.lit("probe").alias("label"))


_PROBES = ", probes AS (SELECT unnest(range(20)) AS account UNION ALL SELECT 1000000000)"


@query(_FP + _PROBES + " SELECT p.account, 'probe' AS label, coalesce(rule = 'steady', FALSE) AS benign FROM probes p LEFT JOIN verdict v USING (account)")
def decoy_check(spark, d):
    return fingerprint.decoy_check(_probes(spark), fingerprint.verdicts(fingerprint.fingerprints(events_ledger(spark, d)))).select("account", "label", "benign")


_MEMBERS = """, members AS (
  SELECT 'cycle' AS type, t0 AS start_us, t1 AS end_us, path AS accounts, 100 * (1 - round(ratio, 4)) AS bonus FROM cycles
  UNION ALL SELECT 'mule_chain', t0, t, path, 10 * least(1.0, CASE WHEN a0 <> 0 THEN round(a / a0, 4) ELSE 0.0 END) FROM chains
  UNION ALL SELECT 'smurfing', b.start_us, b.us, list_distinct(list(x.account)), 10 * any_value(round(b.score, 3)) FROM best b
    JOIN (SELECT b.dst AS collector, a.src AS account FROM best b JOIN dep a ON a.dst = b.dst AND a.us BETWEEN b.start_us AND b.us UNION SELECT dst, dst FROM best UNION SELECT collector, receiver FROM cons) x ON x.collector = b.dst GROUP BY b.dst, b.start_us, b.us
)"""


@query(_EVIDENCE + _MEMBERS + _PROBES + ", inside AS (SELECT account, count(*) AS n FROM (SELECT unnest(list_distinct(accounts)) AS account FROM members) GROUP BY 1) SELECT account, 'probe' AS label, coalesce(n, 0) AS n_hits, n IS NOT NULL AS flagged FROM probes LEFT JOIN inside USING (account)", recursive=True)
def decoy_alarms(spark, d):
    return hits.decoy_alarms(_probes(spark), hits.all_hits(events_ledger(spark, d), None, TH))


@query(_EVIDENCE + ", f AS (SELECT account FROM points GROUP BY 1 HAVING least(100, sum(p)) >= 50), t AS (SELECT DISTINCT account FROM act WHERE account % 3 = 0), n AS (SELECT (SELECT count(*) FROM f SEMI JOIN t USING (account)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM t) AS nt) SELECT round(CASE WHEN nf > 0 THEN tp / nf ELSE 0.0 END, 6) AS precision, round(CASE WHEN nt > 0 THEN tp / nt ELSE 0.0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (nf + nt) ELSE 0.0 END, 6) AS f1 FROM n", recursive=True)
def account_quality(spark, d):
    """Set precision, recall and F1: accounts of 50 points or more against those whose number divides by 3."""
    e = events_ledger(spark, d)
    flagged = scoring.pattern_scores(hits.all_hits(e, None, TH)).where("pattern_score >= 50")
    q = hits.account_prf(flagged, graph.endpoints(e).select("account").where("account % 3 = 0"))
    return q.select(*[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_SCORES = (
    _EVIDENCE
    + """, rnk AS (SELECT account, 100.0 * (row_number() OVER (ORDER BY v, account) - 1) / greatest(count(*) OVER () - 1, 1) AS ano FROM (SELECT account, max(amount) AS v FROM act GROUP BY 1)),
scored AS (SELECT account, round(CAST(least(100.0, 0.6 * coalesce(ps, 0) + 0.4 * ano) AS DOUBLE), 1) AS score, round(CAST(ano AS DOUBLE), 1) AS anomaly_score FROM rnk LEFT JOIN (SELECT account, CAST(least(100.0, sum(p)) AS DOUBLE) AS ps FROM points GROUP BY 1) USING (account))"""
)


def _scored(spark, d) -> tuple[DataFrame, DataFrame]:
    """All hits, and all accounts' scores with the percentile of the largest payment as anomaly."""
    e = events_ledger(spark, d)
    found = hits.all_hits(e, None, TH)
    largest = graph.endpoints(e).groupBy("account").agg(F.max("amount").alias("raw"))
    return found, scoring.account_scores(graph.degrees(e), scoring.pattern_scores(found), iforest.percentile_rank(largest), velocity.velocity_features(e))


@query(_SCORES + " SELECT account, score, anomaly_score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS band FROM scored", recursive=True)
def scores_by_largest_payment(spark, d):
    """Account scores and bands, the percentile of the largest payment as anomaly."""
    return _scored(spark, d)[1].select("account", "score", "anomaly_score", risk_band(F.col("score")).alias("band"))


@query(_SCORES + _MEMBERS + ", m AS (SELECT type, start_us, end_us, accounts, bonus, unnest(accounts) AS account FROM members) SELECT type, start_us, end_us, CAST(len(accounts) AS INTEGER) AS n_accounts, round(CAST(least(100.0, 0.5 * max(score) + 0.3 * avg(anomaly_score) + 20 + bonus) AS DOUBLE), 1) AS score FROM m JOIN scored USING (account) GROUP BY type, start_us, end_us, accounts, bonus", recursive=True)
def ring_scores(spark, d):
    """Scores of all hits from those account scores."""
    found, scores = _scored(spark, d)
    return scoring.ring_scores(found, scores, repeats=True).select("type", "start_us", "end_us", F.size("accounts").alias("n_accounts"), "score")


@query(_CHAINS + ", mem AS (SELECT array_to_string(path, ',') AS chain_id, unnest(path) AS account FROM chains), del AS (SELECT chain_id, (u - t) / 60000000 AS x FROM mem JOIN (SELECT dst AS account, min(us) AS t FROM edges GROUP BY 1) USING (account) JOIN (SELECT src AS account, min(us) AS u FROM edges GROUP BY 1) USING (account) WHERE u >= t) SELECT chain_id, round(median(x), 3) AS median_delay_min, round(sum(x), 3) AS total_delay_min, count(*) AS n FROM del GROUP BY 1", recursive=True)
def chain_velocity(spark, d):
    e = events_ledger(spark, d)
    v = velocity.chain_velocity(e, detect_chains(e, None, TH).select(path_text(F.col("accounts")).alias("chain_id"), "accounts"))
    return v.select("chain_id", rounded("median_delay_min", 3).alias("median_delay_min"), rounded("total_delay_min", 3).alias("total_delay_min"), "n")


@query()
def lever_grid(spark, d):
    """Four levers off or on, crossed, thinned to four schemes and searched."""
    return _searched(spark, d, adversary.lever_grid(24, 2, 5, 2)).frontier.select("scheme_id", "hop_delay_hours", "n_splits", "n_decoys", "friction", "detected", F.coalesce("evidence", F.lit("")).alias("evidence"))


@query(", s AS (SELECT account, amount, row_number() OVER (PARTITION BY account ORDER BY us, txn_id, direction) - 1 AS pos, min(amount) OVER (PARTITION BY account) AS lo, max(amount) OVER (PARTITION BY account) AS hi FROM act) SELECT account, CAST(pos AS INTEGER) AS pos, round(CASE WHEN hi > lo THEN (amount - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled FROM s")
def sparkline(spark, d):
    a = graph.endpoints(events_ledger(spark, d)).groupBy("account").agg(F.transform(F.array_sort(F.collect_list(F.struct("us", "txn_id", "direction", "amount"))), lambda s: s["amount"]).alias("sparkline"))
    return views.sparkline(a).select("account", F.posexplode("scaled").alias("pos", "scaled")).withColumn("scaled", rounded("scaled", 6))


_LOCAL = """, pb AS (SELECT bank_src AS bank, * FROM edges UNION ALL SELECT bank_dst, * FROM edges WHERE bank_dst <> bank_src),
lc(bank, path, tail, t, a, txns, t0) AS (
  SELECT bank, [src, dst], dst, us, amount, [txn_id], us FROM pb
  UNION ALL
  SELECT lc.bank, list_append(path, e.dst), e.dst, e.us, e.amount, list_append(txns, e.txn_id), t0 FROM lc JOIN pb e ON e.bank = lc.bank AND e.src = tail
  WHERE e.us BETWEEN t AND t + 7200000000 AND e.amount >= a * 0.85 AND NOT list_contains(path, e.dst)
), local_chains AS (SELECT * FROM lc WHERE len(txns) >= 3 QUALIFY row_number() OVER (PARTITION BY bank, list_sort(list_distinct(path)) ORDER BY len(path) DESC, t0, txns) = 1)"""


@query(_LOCAL + " SELECT bank, array_to_string(path, ',') AS accounts FROM local_chains", recursive=True)
def local_chains(spark, d):
    """Chains that each bank finds in the payments it sees."""
    c = detect_chains(per_bank(events_ledger(spark, d)), None, TH, ("bank",))
    return c.select("bank", path_text(F.col("accounts")).alias("accounts"))


@query()
def frontier_rates(spark, d):
    """The rolling detection rate and the rank among the cheapest evaders, of schemes as the search found them."""
    f = _searched(spark, d).frontier
    rank = views.cheapest_evaders(f).select("scheme_id", F.row_number().over(W.orderBy("friction", "scheme_id")).alias("cheapest"))  # six rows
    return views.rolling_detection(f).join(rank, "scheme_id", "left")


@query()
def federated_summary(spark, d):
    return federation.summary(federation.build_signals(federation.local_hits(events_ledger(spark, d), TH)))


@query()
def evidence_verify(spark, d):
    det = _detection(spark, d)
    return evidence.verify(evidence.chain(evidence.records(det.rings, det.edges)))


@query()
def case_stories(spark, d):
    return evidence.case_story(_detection(spark, d).rings)


@query()
def taint_links(spark, d):
    return taint.flow_links(taint.trace(events_ledger(spark, d), txn_id=_seed(spark, d), max_depth=4, min_taint=5.0))


@query()
def taint_totals(spark, d):
    return taint.totals(taint.trace(events_ledger(spark, d), txn_id=_seed(spark, d), max_depth=4, min_taint=5.0))


@query(_CHAINS + ", pay AS (SELECT array_to_string(path, ',') AS accounts, unnest(txns) AS txn_id FROM chains), deg AS (SELECT p.accounts, a.account, count(*) AS c FROM pay p JOIN act a USING (txn_id) GROUP BY 1, 2) SELECT accounts, max(c) > 8 AS fan FROM deg GROUP BY 1", recursive=True)
def chain_fans(spark, d):
    """The fan test over the payments of each chain, without a choice of ids."""
    e = events_ledger(spark, d)
    c = detect_chains(e, None, TH).select(path_text(F.col("accounts")).alias("accounts"), F.explode("txn_ids").alias("txn_id"))
    pays = c.join(e, "txn_id").select("accounts", F.explode(F.array("src", "dst")).alias("account"))
    return pays.groupBy("accounts", "account").agg(F.count("*").alias("degree")).groupBy("accounts").agg((F.max("degree") > 8).alias("fan"))


@query(", s AS (SELECT account, amount, row_number() OVER (PARTITION BY account ORDER BY us, txn_id, direction) - 1 AS pos, min(amount) OVER (PARTITION BY account) AS lo, max(amount) OVER (PARTITION BY account) AS hi FROM act) SELECT account, CAST(pos AS INTEGER) AS pos, round(CASE WHEN hi > lo THEN (amount - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled FROM s")
def account_sparklines(spark, d):
    """The scaled series of every account, a row a payment and no array of all of them."""
    return views.scaled_series(events_ledger(spark, d)).withColumn("scaled", rounded("scaled", 6))
