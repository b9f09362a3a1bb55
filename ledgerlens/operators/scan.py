"""Running totals of groups of any size: totals of ranges of a group, carried over, then the rows of each range.

A window over one group is one sorted partition. Here rows are dealt out by (key, order),
so a group's history lies in as many ranges as it needs; what came before a range is
one small row, and only the first group of a range can have begun in an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import Staging

#: Inputs of at most so many rows are left to plain windows: even a single group of that size is a small task.
PLAIN_ROWS = 1 << 20
_AGGREGATES = {"sum": F.sum, "max": F.max}


def _joined(how: str, before: Column, here: Column) -> Column:
    if how == "max":
        return F.greatest(before, here)
    return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)


def is_small(rows: DataFrame) -> bool:
    """Whether plain windows do for ``rows``, however they are grouped; counting stops beyond PLAIN_ROWS."""
    return rows.limit(PLAIN_ROWS + 1).count() <= PLAIN_ROWS


def running(df: DataFrame, key: list[str], order: list[str], totals: dict[str, tuple[str, Column]], peers: bool = False, before: bool = False, plain: bool = False) -> DataFrame:
    """``df`` with ``{name: (how, value)}`` as running ``sum`` or ``max`` by ``key`` in ``order``.

    A total holds the rows up to and with its own; with ``peers`` those of equal order
    too, with ``before`` only those before it (null for a group's first). Rows of equal
    order must not differ in what ``before`` or a row's place among them would show.
    ``plain``: by a window over each whole group, for inputs that ``is_small`` says so of.
    """
    end = -1 if before else W.currentRow

    def windowed(d: DataFrame, part: list[str]) -> DataFrame:
        w = W.partitionBy(*part).orderBy(*order)
        w = w.rangeBetween(W.unboundedPreceding, W.currentRow) if peers else w.rowsBetween(W.unboundedPreceding, end)
        return d.withColumns({n: _AGGREGATES[how](value).over(w) for n, (how, value) in totals.items()})

    if plain:
        return windowed(df, key)
    staging = Staging(df.sparkSession, "scan")
    dealt = staging.write(df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*key, "_range").agg(*[_AGGREGATES[how](value).alias(n) for n, (how, value) in totals.items()])
    earlier = W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range that has the key
    place = F.row_number().over(W.partitionBy(*key).orderBy("_range"))
    carried = sums.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_range").alias("_at"), place.alias("_place"), *[_AGGREGATES[how](n).over(earlier).alias(f"_{n}") for n, (how, _) in totals.items()]).where("_place > 1")
    here = windowed(dealt, ["_range", *key])
    met = here.join(F.broadcast(carried), [F.col("_range") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]], "left")  # a row for each range at most
    types = {f.name: f.dataType for f in here.schema.fields}
    return met.select(*[c for c in here.columns if c not in totals and c != "_range"], *[_joined(how, F.col(f"_{n}"), F.col(n)).cast(types[n]).alias(n) for n, (how, _) in totals.items()])
