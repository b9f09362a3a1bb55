"""What-if search: evasion schemes injected into the ledger, all of them searched in one keyed job from their payments outwards."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta
from hashlib import sha256
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings, Thresholds
from ..functions.scalars import draw, micros, rounded
from ..session import Staging, at_once
from .delta import NARROW, hits_with
from .graph import accounts as account_table

BASE_TIME = datetime(2026, 2, 10, 10, 0)
DECOY_POOL = 400
NO_EVADER = 999.0


@dataclass(frozen=True)
class Scheme:
    hop_delay_hours: float = 0
    n_splits: int = 1
    jitter: float = 0.0
    n_decoys: int = 0
    n_banks: int = 1
    fee_pct: float = 2.0

    @property
    def extra_accounts(self) -> int:
        return 2 * self.n_splits


def default_grid() -> list[Scheme]:
    return [Scheme(d, s, 0.1 if s > 1 else 0.0, c, b) for d, s, c, b in product((0, 6, 24, 48), (1, 4), (0, 20), (1, 3))]


def cap_grid(grid: list[Scheme], most: int | None) -> list[Scheme]:
    if most is None or most >= len(grid):
        return grid
    return [grid[int(i * len(grid) / most)] for i in range(most)]


def lever_grid(hop_delay_hours: float = 0, n_splits: int = 1, n_decoys: int = 0, n_banks: int = 1, most: int = 4) -> list[Scheme]:
    """Each lever off or on, crossed, thinned to ``most``."""
    both = lambda off, on: (off,) if on == off else (off, on)
    return cap_grid([Scheme(d, s, 0.1 if s > 1 else 0.0, c, b) for d, s, c, b in product(both(0, hop_delay_hours), both(1, n_splits), both(0, n_decoys), both(1, n_banks))], most)


def friction(p: Scheme) -> float:
    """Cost of a scheme over the naive one's: hours, fees and accounts."""
    naive = 0.05 + 2 * Scheme().fee_pct + 2.0
    return (2 * p.hop_delay_hours + 0.05 + 0.05 * p.n_decoys + 2 * p.fee_pct + p.extra_accounts) / naive


def scheme_grid_table(spark, grid: list[Scheme] | None = None) -> DataFrame:
    rows = [(i, float(p.hop_delay_hours), p.n_splits, p.jitter, p.n_decoys, p.n_banks, p.fee_pct) for i, p in enumerate(grid if grid is not None else default_grid())]
    return spark.createDataFrame(rows, "scheme_id int, hop_delay_hours double, n_splits int, jitter double, n_decoys int, n_banks int, fee_pct double")


def friction_table(schemes: DataFrame) -> DataFrame:
    cost = 2 * F.col("hop_delay_hours") + 0.05 + 0.05 * F.col("n_decoys") + 2 * F.col("fee_pct") + 2 * F.col("n_splits")
    return schemes.withColumn("friction", rounded(cost / 6.05, 2))


def scheme_edges(p: Scheme, scheme_id: int, source: str, target: str, amount: float, bank_of: dict, pool: list[str], seed: int = 42, base_time: datetime = BASE_TIME, banks: tuple[str, ...] = Settings().banks) -> list[tuple]:
    """The injected payments: parallel splits over two mules each, with delay, jitter and fees, and decoy payments.

    Draws are hashes of (seed, scheme, what is drawn), so a scheme's payments depend on nothing else.
    """
    names: dict[str, int] = {}
    bank = dict(bank_of)

    def mule(b: str) -> str:
        names[b] = names.get(b, 0) + 1
        bank[f"ADV_{b}_{names[b]}"] = b
        return f"ADV_{b}_{names[b]}"

    out = []

    def pay(key: str, src: str, dst: str, t: datetime, a: float, channel: str) -> None:
        out.append((scheme_id, key, t, src, dst, round(a, 2), bank.get(src, "?"), bank.get(dst, "?"), channel))

    drawn = lambda *what: draw(seed, scheme_id, *what)
    home = banks.index(bank.get(source, banks[0])) if bank.get(source, banks[0]) in banks else 0
    route = [banks[(home + i) % len(banks)] for i in range(max(1, p.n_banks))]
    for s in range(p.n_splits):
        lost = lambda h: 1 - p.jitter * 0.1 * (drawn(s, h, "loss") / 2.0**32)  # noqa: B023, E731
        a, b = (mule(route[i % len(route)]) for i in range(2))
        t = base_time + timedelta(hours=s * p.hop_delay_hours if p.n_splits > 1 else 0)
        value = amount / p.n_splits * lost(0)
        pay(f"ADV{s}_h0", source, a, t, value, "wire")
        for h, (x, y) in enumerate(((a, b), (b, target)), 1):
            t += timedelta(hours=p.hop_delay_hours, minutes=1 + drawn(s, h, "minutes") % 90)
            value *= (1 - p.fee_pct / 100) * lost(h)
            pay(f"ADV{s}_h{h}", x, y, t, value, "wire")
    for i in range(p.n_decoys if pool else 0):
        x, y = (pool[drawn("decoy", i, side) % len(pool)] for side in ("src", "dst"))
        t = base_time + timedelta(hours=drawn("decoy", i, "hours") % 73 - 24, minutes=drawn("decoy", i, "minutes") % 60)
        pay(f"ADV_decoy{i}", x, y, t, 50 + 850 * (drawn("decoy", i, "amount") / 2.0**32), "transfer")
    return out


_INJECTED = "scheme_id int, txn_id string, ts timestamp_ntz, src string, dst string, amount double, bank_src string, bank_dst string, channel string"


def injections(e: DataFrame, schemes: list[Scheme], source: str, target: str, amount: float, seed: int = 42, base_time: datetime = BASE_TIME) -> DataFrame:
    """The payments of all schemes, keyed by ``scheme_id``; decoys run between the DECOY_POOL accounts that pay first, source and target apart."""
    at = account_table(e)
    first = e.select(F.col("src").alias("account"), "us", "txn_id").unionByName(e.select(F.col("dst").alias("account"), "us", "txn_id")).groupBy("account").agg(F.min(F.struct("us", "txn_id")).alias("o"))
    known = at.where(F.col("bank").isin(*Settings().banks) & ~F.col("account").isin(source, target)).join(first, "account").orderBy("o", "account").limit(DECOY_POOL).collect()
    bank_of = {r.account: r.bank for r in [*known, *at.where(F.col("account").isin(source, target)).collect()]}
    pool = [r.account for r in known]
    rows = [r for i, p in enumerate(schemes) for r in scheme_edges(p, i, source, target, amount, bank_of, pool, seed, base_time)]
    return e.sparkSession.createDataFrame(rows, _INJECTED).withColumn("us", micros("ts"))


def _sets(accounts: str = "accounts"):
    return F.array_join(F.array_sort(F.array_distinct(accounts)), ",")


def detected(hits: DataFrame, pre_existing: DataFrame, source: str, target: str) -> DataFrame:
    """``scheme_id, evidence`` of schemes caught: a hit on an injected mule, or on source or target that the ledger didn't have before."""
    mules = F.filter("accounts", lambda a: a.startswith("ADV_"))
    on_ends = F.arrays_overlap("accounts", F.array(F.lit(source), F.lit(target)))
    fresh = hits.withColumn("key", _sets()).join(pre_existing.select(_sets().alias("key"), F.lit(True).alias("old")).distinct(), "key", "left")
    caught = fresh.where((F.size(mules) > 0) | (on_ends & F.col("old").isNull()))
    order = F.struct(F.when(F.col("type") == "cycle", 0).when(F.col("type") == "mule_chain", 1).otherwise(2), "hit_id")
    text = F.when(F.size(mules) > 0, F.concat("type", F.lit(" on injected "), F.array_join(F.slice(F.array_sort(F.array_distinct(mules)), 1, 2), ", "))).otherwise(F.concat("type", F.lit(" on "), F.array_join(F.slice(F.array_sort(F.array_distinct("accounts")), 1, 3), ", ")))
    return caught.withColumn("text", text).groupBy("scheme_id").agg(F.min_by("text", order).alias("evidence"))


@dataclass
class Report:
    baseline_detected: bool
    frontier: DataFrame
    friction_before: float
    friction_after: float
    hardened: dict
    n_schemes: int


class _Search:
    """One ledger and route: what all schemes and thresholds share. Only hits on a mule, the source or the target can count."""

    def __init__(self, e: DataFrame, suspects: DataFrame, schemes: list[Scheme], source: str, target: str, amount: float, seed: int, base_time: datetime) -> None:
        spark, staging = e.sparkSession, Staging(e.sparkSession, "adversary")
        self.e, self.schemes, self.source, self.target = staging.write(e), schemes, source, target
        self.allowed = suspects.select("account").unionByName(spark.createDataFrame([(source,), (target,)], "account string")).distinct()
        self.injected = staging.write(injections(self.e, schemes, source, target, amount, seed, base_time))
        self.mules = self.injected.select("scheme_id", F.explode(F.array("src", "dst")).alias("account")).where(F.col("account").startswith("ADV_")).distinct()
        here = F.coalesce(F.col("src").isin(source, target) | F.col("dst").isin(source, target), F.lit(False))
        base = F.lit(-1).alias("scheme_id")
        self.elsewhere = self.e.where(~here)
        naive = self.injected.where("scheme_id = 0").drop("scheme_id")
        # The ledger's own hits on source and target hold a payment of theirs: these are the seeds. The naive scheme lies in it, its mules not allowed.
        self.own = self.e.where(here).select(base, *NARROW).unionByName(naive.select(base, *NARROW))
        self.known: DataFrame | None = None

    def frontier(self, th: Thresholds) -> tuple[DataFrame, bool, Scheme | None]:
        """The friction table with what is detected, whether the naive scheme is, and the cheapest scheme that isn't."""
        none = self.mules.where("false")
        jobs = [lambda: hits_with(self.e, self.injected, self.allowed, self.mules, th), lambda: hits_with(self.elsewhere, self.own, self.allowed, none, th)]
        found, own = at_once(*jobs)
        if self.known is None:
            self.known = own
        caught = detected(found, self.known, self.source, self.target)
        # Other thresholds can find more in the ledger itself, which then counts in every scheme.
        always = detected(own.where("type <> 'smurfing'"), self.known, self.source, self.target).select("evidence").first()
        table = friction_table(scheme_grid_table(self.e.sparkSession, self.schemes)).join(caught, "scheme_id", "left")
        if always:
            table = table.withColumn("evidence", F.coalesce("evidence", F.lit(always[0])))
        table = Staging(self.e.sparkSession, "frontier").write(table.withColumn("detected", F.col("evidence").isNotNull()))
        rows = {r.scheme_id: r.detected for r in table.select("scheme_id", "detected").collect()}
        evaders = [p for i, p in enumerate(self.schemes) if i and not rows[i]]
        return table.where("scheme_id > 0").orderBy("friction", "scheme_id"), rows[0], min(evaders, key=friction, default=None)


def run(e: DataFrame, suspects: DataFrame, source: str, target: str, amount: float = 100_000.0, grid: list[Scheme] | None = None, most: int | None = None, seed: int = 42, th: Thresholds = DEFAULTS, base_time: datetime = BASE_TIME) -> Report:
    """Baseline, frontier over the grid, cheapest evader, hardened thresholds and the friction after them. Account ids are strings.

    No copy of the ledger is made for a scheme: hits are searched from the injected payments outwards (see ``delta``).
    """
    everything = [Scheme(), *cap_grid(grid if grid is not None else default_grid(), most)]
    search = _Search(e, suspects, everything, source, target, amount, seed, base_time)
    frontier, baseline, lowest = search.frontier(th)
    if lowest is None:
        return Report(baseline, frontier, NO_EVADER, NO_EVADER, {}, len(everything))
    changed = hardening(lowest, th)
    _, _, after = search.frontier(replace(th, **changed))
    return Report(baseline, frontier, round(friction(lowest), 2), round(friction(after), 2) if after else round(friction(lowest) * 3, 2), changed, len(everything))


def hardening(p: Scheme, th: Thresholds = DEFAULTS) -> dict:
    """Thresholds to tighten against the cheapest evader."""
    out: dict = {}
    if p.hop_delay_hours > 0:
        out["chain_max_delay_min"] = max(th.chain_max_delay_min, int((p.hop_delay_hours + 2) * 60))
        out["chain_min_forward"] = min(0.95, th.chain_min_forward + 0.05)
    if p.n_splits >= 4:
        out["smurf_min_deposits"] = th.smurf_min_deposits
    return out or {"chain_min_forward": min(0.95, th.chain_min_forward + 0.05), "cycle_min_retention": min(0.95, th.cycle_min_retention + 0.05)}


def default_route(accounts: DataFrame, suspects: DataFrame, ring_members: DataFrame, degrees: DataFrame) -> tuple[str, str]:
    """The first suspect of BankA and of BankC that is in no ring and has at most 3 payments."""
    free = suspects.join(accounts, "account").join(degrees.where("degree <= 3"), "account").join(ring_members, "account", "left_anti")
    found = {r.bank: r.account for r in free.where(F.col("bank").isin("BankA", "BankC")).groupBy("bank").agg(F.min("account").alias("account")).collect()}
    return found.get("BankA", "BankA_0001"), found.get("BankC", "BankC_0001")


def report_rows(report: Report) -> list[dict]:
    return [r.asDict() for r in report.frontier.collect()] + [_head(report)]


def _head(report: Report) -> dict:
    return {k: v for k, v in asdict(replace(report, frontier=None)).items() if k != "frontier"}


def save_report(report: Report, path: str) -> None:
    """The report in two tables below ``path``: its frontier and one row of the rest, written last."""
    report.frontier.write.mode("overwrite").json(f"{path}/frontier")
    report.frontier.sparkSession.createDataFrame([(json.dumps(_head(report)),)], "head string").write.mode("overwrite").text(f"{path}/head")


class SearchRunning(RuntimeError):
    """Another search holds the folder."""


#: Part of every manifest: reports of other code are not reread.
VERSION = 2


def manifest(parameters: dict, **tables: DataFrame) -> str:
    """What a report depends on, as text: the parameters, and of each table its columns, row count and sums of two hashes a row.

    The sums don't depend on the order of rows or files, and a changed, added or repeated
    row changes them.
    """
    digests = {}
    for name, df in sorted(tables.items()):
        cols = [F.col(c).cast("string") for c in df.columns]
        one, two = (F.xxhash64(F.lit(salt), *[F.struct(c.isNull(), c) for c in cols]).cast("decimal(20,0)") for salt in (1, 2))
        r = df.agg(F.count("*"), F.sum(one), F.sum(two)).first()
        digests[name] = {"columns": df.dtypes, "rows": r[0], "sums": [str(r[1]), str(r[2])]}
    return json.dumps({"version": VERSION, "parameters": parameters, "tables": digests}, sort_keys=True, default=str)


def kept_report(spark: SparkSession, folder: str, about: str, search: Callable[[], Report], stale_hours: float = 6) -> Report:
    """The report that ``folder`` keeps for this manifest, or that of ``search``, which is kept then.

    Reports lie under the digest of their manifest, with the manifest itself beside them, and are
    reread only if it is the same text. One search runs at a time in a folder: a second one
    gets ``SearchRunning``; a mark older than ``stale_hours`` is of a driver that died.
    """
    path = f"{folder}/{sha256(about.encode()).hexdigest()[:32]}"
    jvm = spark._jvm.org.apache.hadoop.fs
    done, running = jvm.Path(f"{path}/manifest/_SUCCESS"), jvm.Path(f"{folder}/running")
    fs = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(done) and spark.read.text(f"{path}/manifest", wholetext=True).first()[0].rstrip("\n") == about:
        return load_report(spark, path)
    if fs.exists(running) and time.time() - fs.getFileStatus(running).getModificationTime() / 1000 > stale_hours * 3600:
        fs.delete(running, False)
    if not fs.createNewFile(running):
        raise SearchRunning(f"a search is already in progress in {folder}")
    try:
        save_report(search(), path)
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    finally:
        fs.delete(running, False)
    return load_report(spark, path)


def load_report(spark: SparkSession, path: str) -> Report:
    """A saved report, so that a search need not be run again."""
    schema = "scheme_id int, hop_delay_hours double, n_splits int, jitter double, n_decoys int, n_banks int, fee_pct double, friction double, evidence string, detected boolean"
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    return Report(frontier=spark.read.schema(schema).json(f"{path}/frontier").orderBy("friction", "scheme_id"), **head)
