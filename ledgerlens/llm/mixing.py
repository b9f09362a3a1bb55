"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document d of source s gets a rate r_d in [0, cap]: of all rates that meet the
token constraint sum(r_d * size_d) = target_s, those nearest to 1 in (bounded)
relative entropy. They are exponentially tilted: r / (cap - r) = exp(l_s * x_d) /
(cap - 1), x_d the size over its source's mean. The dual is convex with one unknown
l_s a source; each Newton step needs two sums a source, aggregated over the table of
distinct (source, size) with their counts. A source whose target is its cap has
l_s = infinity: all rates are the cap.

Rates become copies by cumulative rounding over a source's sizes, then a few greedy
corrections bring its tokens to the target as near as single documents allow; equal
sizes of a source share out their copies by hash. All sums are of integers (a
Newton step's in units of 2^-30), so they don't depend on the order of rows and reruns agree.

Bounds: sources are names of a mix, at most MAX_SOURCES (checked), and only their
sums reach the driver. A hot source or size is never gathered in one task: counts
are partial aggregates, and (source, size) cells are dealt out in hash buckets, the
square root of the row count many.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import Scratch, inline_table

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
MAX_SOURCES = 10_000
#: Rounds of corrections at most, and the share of its target that a source may be off without one.
CORRECTIONS, NEAR = 8, 1e-4
RESULTS = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]
_UNIT = 1 << 24  # rates are counted in units of 1 / _UNIT


def word_count(text: Column) -> Column:
    """Number of runs of anything but space and \\t-\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[int], share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Share of all sizes by weight (in order, repeating), none above cap times its size; the excess reshared until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full = [cap * s for s in sizes]
    out: list[float] = [0.0] * len(sizes)
    free, rest = set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(w[i] for i in sorted(free))
        over = {i for i in free if rest * w[i] / total > full[i]}
        if not over:
            for i in free:
                out[i] = rest * w[i] / total
            break
        for i in sorted(over):
            out[i] = float(full[i])
            rest -= full[i]
        free -= over
    return out


def _table(spark, rows: list[dict], ddl: str) -> DataFrame:
    return F.broadcast(inline_table(spark, json.dumps(rows), ddl))  # at most MAX_SOURCES rows


def _tilted(lam: Column, x: Column, cap: float) -> Column:
    """The rate: cap / (1 + (cap - 1) exp(-lam x)), without overflow."""
    return F.lit(float(cap)) / (1 + (cap - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -lam * x))))


def solve(cells: DataFrame, sums: dict[int, tuple[int, int, float]], cap: float = CAP, steps: int = 60, tolerance: float = 1e-10) -> dict[int, float]:
    """l_s of each source of ``cells(sid, size, n)``; ``sums``: rows, tokens and target of each sid that has tokens."""
    spark = cells.sparkSession
    lam: dict[int, float] = {}
    low: dict[int, float] = {}
    high: dict[int, float] = {}
    mean = {s: t / n for s, (n, t, _) in sums.items()}
    todo = set()
    for s, (_, tokens, target) in sums.items():
        if target >= cap * tokens * (1 - 1e-12):
            lam[s] = math.inf
        elif target <= 0:
            lam[s] = -math.inf
        else:
            lam[s] = 0.0
            todo.add(s)
    for _ in range(steps):
        if not todo:
            break
        at = _table(spark, [{"sid": s, "lam": lam[s], "mean": mean[s]} for s in sorted(todo)], "sid:int,lam:double,mean:double")
        x = F.col("size") / F.col("mean")
        r = _tilted(F.col("lam"), x, cap)
        weight = F.col("n") * F.col("size")
        fixed = lambda c: (F.sum(F.round(c * (1 << 30)).cast("decimal(38,0)")).cast("double") / (1 << 30))
        got = cells.join(at, "sid").groupBy("sid").agg(fixed(weight * r).alias("f"), fixed(weight * x * r * (1 - r / cap)).alias("d")).collect()
        for row in got:
            s, target = row.sid, sums[row.sid][2]
            gap = row.f - target
            if abs(gap) <= tolerance * target:
                todo.discard(s)
                continue
            (high if gap > 0 else low)[s] = lam[s]
            new = lam[s] - gap / row.d if row.d > 0 else math.nan
            if not (low.get(s, -math.inf) < new < high.get(s, math.inf)) or abs(new - lam[s]) > 50 + 2 * abs(lam[s]):
                if s in low and s in high:
                    new = (low[s] + high[s]) / 2
                else:
                    new = 2 * lam[s] + (-1 if gap > 0 else 1)
            if abs(new - lam[s]) <= 1e-12 * max(1, abs(new)):
                todo.discard(s)
            lam[s] = new
    return {s: round(v, 9) if math.isfinite(v) else v for s, v in lam.items()}


def mix(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """All rows and columns of ``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies, mix_taken``, which replace columns of these names.

    Sources go by code point, null (a source like any other) last. Null texts and
    texts without words have size 0 and one copy; they weigh nothing. Equal rows may get different
    copies; which of them gets more is not told apart. An empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in RESULTS]
    return _mixed(docs, share, cap, weights).select(*[F.col("mix_row").getField(c).alias(c) for c in own], *RESULTS)


def _mixed(docs: DataFrame, share: float, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """``mix_row``, the rows of ``docs`` as structs so that their columns may have any name, and RESULTS."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = docs.select(F.struct("*").alias("mix_row"), F.col("source").cast("string").alias("source"), F.col("doc_id").alias("doc_id"), word_count(F.col("text").cast("string")).alias("mix_size"))
    narrow = scratch.write(sized.select("source", F.col("mix_size").alias("size"), F.xxhash64("doc_id").alias("h")))
    per_cell = scratch.write(narrow.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = per_cell.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("tokens"))
    rows = per_source.orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix over fewer names")
    wanted = targets([r.tokens for r in rows], share, cap, weights)
    names = [{"sid": i, "source": r.source, "source_size": r.tokens, "target": t} for i, (r, t) in enumerate(zip(rows, wanted))]
    buckets = max(16, math.isqrt(sum(r.n for r in rows)))
    by_name = _table(spark, names, "sid:int,source:string,source_size:bigint,target:double")
    named = per_cell.withColumnRenamed("source", "s_").join(by_name, F.col("s_").eqNullSafe(F.col("source")))
    cells = scratch.write(named.select("sid", "size", "n"))
    sums = {i: (r.n, r.tokens, t) for i, (r, t) in enumerate(zip(rows, wanted)) if r.tokens}
    lam = solve(cells.where("size > 0"), sums, cap)
    copied = scratch.write(_round(cells, lam, sums, cap))
    for _ in range(CORRECTIONS):
        fixes = _corrections(copied, sums, cap)
        if not fixes:
            break
        bump = _table(spark, fixes, "sid:int,size:bigint,bump:bigint")
        copied, before = scratch.write(copied.join(bump, ["sid", "size"], "left").select("sid", "size", "n", (F.col("copies") + F.coalesce("bump", F.lit(0))).alias("copies"))), copied
        scratch.drop(before)
    # Copies of a cell: the same floor for each row and one more for `extra` of its n rows, those first by hash; shared out over hash buckets first.
    dealt = narrow.withColumnRenamed("source", "s_").join(by_name, F.col("s_").eqNullSafe(F.col("source"))).groupBy("sid", "size", F.pmod(F.col("h"), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("sid", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = lambda upto: F.expr(f"cast(copies % n as decimal(19,0)) * cast({upto} as decimal(19,0)) div n")
    shares = scratch.write(
        dealt.join(copied, ["sid", "size"])
        .withColumn("upto", before)
        .select("sid", F.col("size").alias("mix_size"), "bucket", F.floor(F.col("copies") / F.col("n")).cast("int").alias("base"), (part("upto + k") - part("upto")).cast("long").alias("more"))
    )
    rows_ = (
        sized.withColumn("mix_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
        .join(by_name.select(F.col("sid").alias("mix_sid"), F.col("source").alias("mix_name"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")), F.col("source").eqNullSafe(F.col("mix_name")))
        .join(shares.select(F.col("sid").alias("mix_sid"), "mix_size", F.col("bucket").alias("mix_bucket"), F.col("base").alias("mix_base"), F.col("more").alias("mix_more")), ["mix_sid", "mix_size", "mix_bucket"])
    )
    rank = F.row_number().over(W.partitionBy("mix_sid", "mix_size", "mix_bucket").orderBy(F.xxhash64(F.col("doc_id"), F.lit(1)), "doc_id"))
    copies = F.col("mix_base") + (rank <= F.col("mix_more")).cast("int")
    return rows_.withColumn("mix_copies", copies).withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size")).select("mix_row", *RESULTS)


def _round(cells: DataFrame, lam: dict[int, float], sums: dict[int, tuple[int, int, float]], cap: int) -> DataFrame:
    """``sid, size, n, copies``: copies of all rows of a cell, by cumulative rounding over the sizes of a source."""
    spark = cells.sparkSession
    solved = [{"sid": s, "lam": max(-1e300, min(1e300, v)), "mean": sums[s][1] / sums[s][0]} for s, v in sorted(lam.items())]
    at = _table(spark, solved, "sid:int,lam:double,mean:double")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam") >= 1e300, F.lit(float(cap))).when(F.col("lam") <= -1e300, F.lit(0.0)).otherwise(_tilted(F.col("lam"), F.col("size") / F.col("mean"), cap))
    units = F.coalesce(F.round(rate * _UNIT), F.lit(_UNIT)).cast("long") * F.col("n")
    upto = F.sum(units).over(W.partitionBy("sid").orderBy("size").rowsBetween(W.unboundedPreceding, 0))
    whole = lambda c: F.shiftright(c + (_UNIT >> 1), _UNIT.bit_length() - 1)
    return cells.join(at, "sid", "left").withColumn("units", units).withColumn("upto", upto).select("sid", "size", "n", (whole(F.col("upto")) - whole(F.col("upto") - F.col("units"))).cast("long").alias("copies"))


def _corrections(copied: DataFrame, sums: dict[int, tuple[int, int, float]], cap: int) -> list[dict]:
    """For each source that is off its target: the size nearest to what is missing, and by how many copies."""
    spark = copied.sparkSession
    taken = {r.sid: r.t for r in copied.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
    off = {s: gap for s in sums if abs(gap := round(sums[s][2]) - taken[s]) > NEAR * sums[s][2]}
    if not off:
        return []
    gaps = _table(spark, [{"sid": s, "gap": g} for s, g in sorted(off.items())], "sid:int,gap:bigint")
    room = F.when(F.col("gap") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
    fits = copied.join(gaps, "sid").where(F.col("size") > 0).withColumn("room", room).where((F.col("room") > 0) & (F.col("size") < 2 * F.abs("gap")))
    best = fits.groupBy("sid").agg(F.min_by(F.struct("size", "room", "gap"), F.struct(F.abs(F.col("size") - F.abs("gap")), "size")).alias("b")).select("sid", "b.*").collect()
    return [{"sid": r.sid, "size": r.size, "bump": (1 if r.gap > 0 else -1) * max(1, min(r.room, abs(r.gap) // r.size))} for r in best]


def mixed_documents(docs: DataFrame, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it has copies; columns of any name."""
    return _mixed(docs, share, cap, weights).where("mix_copies > 0").select("mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("mix_copy")).select("mix_row.*")
