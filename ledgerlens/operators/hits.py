"""Hits of the three detectors in one schema, their deduplication and evaluation against known rings."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..config import DEFAULTS, Thresholds
from ..functions.scalars import rounded
from ..session import Staging, at_once
from .chains import detect_chains
from .cycles import detect_cycles
from .scan import is_small, running
from .smurfing import detect_smurfing

#: Column and the detectors that have it; all others get null.
VARIANT = ["origin", "terminal", "collector", "depositors", "retention", "length", "window_hours", "hop_delays_min", "total_delay_min", "structuring_score", "n_deposits", "window_days", "amount_start", "amount_in", "total_amount", "consolidation_txn"]


def all_hits(e: DataFrame, allowed: DataFrame | None = None, th: Thresholds = DEFAULTS, part: tuple[str, ...] = ()) -> DataFrame:
    """Union of the detectors' hits, nullable variant columns, with ``hit_id``: a digest of type and transactions."""
    staging = Staging(e.sparkSession, "hits")
    found = at_once(lambda: detect_cycles(e, allowed, th, part), lambda: detect_chains(e, allowed, th, part), lambda: staging.write(detect_smurfing(e, allowed, th, part)))
    return staging.write(as_hits(found, list(part)))


def as_hits(found: list[DataFrame], part: list[str]) -> DataFrame:
    """One table of several detectors' hits, with ``hit_id``."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    ident = F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in part], "type", F.array_join(F.col("txn_ids").cast("array<string>"), ",")), 256)
    return out.withColumn("hit_id", F.substring(ident, 1, 16))


def dedup_hits(hits: DataFrame, containment: float = 0.8) -> DataFrame:
    """Per type: hits by falling 10 x accounts + deposits (ties by accounts, start), each kept unless a kept one holds that share of its accounts.

    Only earlier hits that hold so much of a hit can drop it; they share one of its
    rarest accounts, so such pairs come from a join at these. Rounds then settle all
    hits whose holders are settled: dropped if one is kept, kept if all are dropped.
    Adds ``dedup_rank``.
    """
    staging = Staging(hits.sparkSession, "dedup")
    size = 10 * F.size(F.array_distinct("accounts")) + F.coalesce("n_deposits", F.lit(0))
    order = F.struct((-size).alias("size"), F.array_sort(F.array_distinct(F.col("accounts").cast("array<string>"))).alias("names"), "start_us", "hit_id")
    sets = staging.write(hits.select("type", "hit_id", F.array_distinct("accounts").alias("s"), order.alias("o")))
    flat = sets.select("type", "hit_id", "o", F.size("s").alias("n"), F.explode("s").alias("account"))
    often = flat.groupBy("type", "account").agg(F.count("*").alias("often"))
    rare = F.row_number().over(W.partitionBy("type", "hit_id").orderBy("often", "account"))
    prefix = flat.join(often, ["type", "account"]).withColumn("k", rare).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * containment - 1e-9) + 1)
    x, y = prefix.alias("x"), flat.alias("y")
    met = x.join(y, (F.col("x.type") == F.col("y.type")) & (F.col("x.account") == F.col("y.account")) & (F.col("y.o") < F.col("x.o"))).select(F.col("x.hit_id").alias("hit"), F.col("y.hit_id").alias("holder")).distinct()
    one, two = (sets.select(F.col("hit_id").alias(name), F.col("s").alias(f"s_{name}")) for name in ("hit", "holder"))
    holds = met.join(one, "hit").join(two, "holder").where(F.size(F.array_intersect("s_hit", "s_holder")) >= containment * F.size("s_hit"))
    open_ = staging.write(holds.select("hit", "holder"))
    kept = sets.select("hit_id").join(open_.select(F.col("hit").alias("hit_id")), "hit_id", "left_anti")
    while open_.limit(1).count():
        kept = staging.write(kept)
        gone = staging.write(open_.join(kept.select(F.col("hit_id").alias("holder")), "holder", "left_semi").select("hit").distinct())
        after = staging.write(open_.join(gone, "hit", "left_anti").join(gone.select(F.col("hit").alias("holder")), "holder", "left_anti"))
        settled = open_.select("hit").distinct().join(gone, "hit", "left_anti").join(after, "hit", "left_anti")
        kept, open_ = kept.unionByName(settled.select(F.col("hit").alias("hit_id"))), after
    ranked = running(sets.join(kept, "hit_id", "left_semi").select("type", "o", "hit_id"), ["type"], ["o"], {"dedup_rank": ("sum", F.lit(1))}, plain=is_small(sets)).select("hit_id", F.col("dedup_rank").cast("int").alias("dedup_rank"))
    return hits.join(ranked, "hit_id").select(*hits.columns, "dedup_rank")


def jaccard(a, b):
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def parity_words(mean: float) -> int:
    """Words of 64 bits, a power of two from 8 to 64, for some six bits an item of a set of mean size: unrelated sets differ in most of their items' bits then."""
    return min(64, max(8, 1 << max(0, ceil(log2(max(mean, 1.0) * 6 / 64)))))


def similar_sets(items: DataFrame, least: float) -> DataFrame:
    """``a, b, members_a, members_b, jaccard`` of ``items(account, item)``: pairs of different item sets that are at least that similar.

    Accounts with the same set are one class, named by the smallest. Sets that similar
    share an item among the rarest ``n - ceil(least * n) + 1`` of each, so classes meet
    only at those, and only if their sizes allow it. Where they meet, two bounds let a pair
    go: at its first common item, what is left of each set must hold the whole overlap; and
    the parities of the sets' hashed items differ in no more bits than the sets do in items
    (Sandes et al. 2017). Only pairs that pass both are moved; their whole sets are compared
    once. Neither bound drops a pair that is similar enough.
    """
    sets = items.distinct().groupBy("account").agg(F.array_sort(F.collect_list("item")).alias("s"))
    classes = Staging(items.sparkSession, "sets").write(sets.groupBy("s").agg(F.min("account").alias("c"), F.count("*").alias("members")).withColumn("n", F.size("s")))
    flat = classes.select("c", "n", F.explode("s").alias("item"))
    often = flat.groupBy("item").agg(F.count("*").alias("often"))
    rare = F.row_number().over(W.partitionBy("c").orderBy("often", "item"))
    words = parity_words(classes.agg(F.avg("n")).first()[0] or 0.0)
    bit = F.pmod(F.xxhash64("item"), F.lit(64 * words))
    parity = [F.bit_xor(F.when(F.floor(bit / 64) == w, F.expr(f"shiftleft(1L, cast(pmod(xxhash64(item), {64 * words}) % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    parities = flat.groupBy("c").agg(*parity)
    # The product is lowered a little: a prefix one longer does no harm, one shorter would.
    prefix = flat.join(often, "item").withColumn("k", rare).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).join(parities, "c").select("c", "n", "k", "item", *[f"w{w}" for w in range(words)])
    x, y = prefix.alias("x"), prefix.alias("y")
    fits = (F.col("x.n") >= F.col("y.n") * least) & (F.col("y.n") >= F.col("x.n") * least)
    both, share = F.col("x.n") + F.col("y.n"), least / (1 + least)  # the overlap is ``share`` of both sizes at least
    fits &= F.least(F.col("x.n") - F.col("x.k"), F.col("y.n") - F.col("y.k")) + 1 >= both * share - 1e-6
    fits &= reduce(Column.__add__, [F.bit_count(F.col(f"x.w{w}").bitwiseXOR(F.col(f"y.w{w}"))) for w in range(words)]) <= both * (1 - 2 * share) + 1e-6
    met = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.c") < F.col("y.c")) & fits).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    side = lambda name: classes.select(F.col("c").alias(name), F.col("s").alias(f"s_{name}"), F.col("members").alias(f"members_{name}"))
    j = F.size(F.array_intersect("s_a", "s_b"))
    j = j / (F.size("s_a") + F.size("s_b") - j)
    return met.join(side("a"), "a").join(side("b"), "b").where(j >= least).select("a", "b", "members_a", "members_b", rounded(j, 6).alias("jaccard"))


def candidate_matches(detected: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """``t, d, weight`` of pairs that overlap enough, or whose detected accounts (two at least) all lie in the truth's; pairs come from shared accounts."""
    t = truth.select("type", F.col("ring_id").alias("t"), F.col("truth_accounts").alias("ta"))
    d = detected.select("type", F.col("ring_id").alias("d"), F.array_distinct("accounts").alias("da"))
    shared = t.withColumn("x", F.explode("ta")).join(d.withColumn("x", F.explode("da")), ["type", "x"]).groupBy("type", "t", "d").agg(F.count("*").alias("n"), F.first(F.size("ta")).alias("nt"), F.first(F.size("da")).alias("nd"))
    j = F.col("n") / (F.col("nt") + F.col("nd") - F.col("n"))
    contained = (F.col("n") == F.col("nd")) & (F.col("nd") >= 2)
    return shared.withColumn("j", j).where((j >= least) | contained).select("type", "t", "d", F.greatest("j", F.when(contained, 0.5).otherwise(0.0)).alias("weight"))


def match_rings(detected: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Greedy one-to-one matches ``type, t, d, weight`` by falling (weight, t, d), in rounds of locally dominant pairs.

    A pair that is the best of both its sides is taken and its neighbours go: nothing that
    the sorted pass takes before it could keep it out. The best pair of all is one in
    every round, and usually very many are, so rounds are few; each is two partial aggregates.
    """
    staging = Staging(detected.sparkSession, "matching")
    pair = F.struct("weight", "t", "d")
    open_ = staging.write(candidate_matches(detected, truth, least))
    taken = open_.where("false")
    while not open_.isEmpty():
        best_t, best_d = (open_.groupBy("type", side).agg(F.max(pair).alias(f"best_{side}")) for side in ("t", "d"))
        won = staging.write(open_.join(best_t, ["type", "t"]).join(best_d, ["type", "d"]).where((F.col("best_t") == pair) & (F.col("best_d") == pair)).select(*open_.columns))
        taken = taken.unionByName(won)
        open_ = staging.write(open_.join(won, ["type", "t"], "left_anti").join(won, ["type", "d"], "left_anti"))
    return taken


def prf(detected: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Per type: ``tp, fp, fn, precision, recall, f1`` (rounded to 3, 0 where undefined)."""
    n = lambda df, name: df.groupBy("type").agg(F.count("*").alias(name))
    m = n(match_rings(detected, truth, least), "tp").join(n(detected, "nd"), "type", "full").join(n(truth, "nt"), "type", "full").na.fill(0)
    p = F.when(F.col("nd") > 0, F.col("tp") / F.col("nd")).otherwise(0.0)
    r = F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).otherwise(0.0)
    f = F.when(F.col("tp") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return m.select("type", "tp", (F.col("nd") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("tp")).alias("fn"), rounded(p, 3).alias("precision"), rounded(r, 3).alias("recall"), rounded(f, 3).alias("f1"))


def decoy_alarms(decoys: DataFrame, hits: DataFrame) -> DataFrame:
    """Each known look-alike with the number of hits that hold it."""
    inside = hits.select("hit_id", F.explode(F.array_distinct("accounts")).alias("account")).groupBy("account").agg(F.count("*").alias("n"))
    return decoys.join(inside, "account", "left").select("account", "label", F.coalesce("n", F.lit(0)).alias("n_hits"), (F.coalesce("n", F.lit(0)) > 0).alias("flagged"))


def account_prf(flagged: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of two sets of accounts."""
    b = flagged.select("account", F.lit(1).alias("f")).distinct().join(truth.select("account", F.lit(1).alias("t")).distinct(), "account", "full")
    tp, nf, nt = F.count_if((F.col("f") == 1) & (F.col("t") == 1)), F.count("f"), F.count("t")
    p, r = F.when(nf > 0, tp / nf).otherwise(0.0), F.when(nt > 0, tp / nt).otherwise(0.0)
    return b.agg(p.alias("precision"), r.alias("recall"), F.when(tp > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
