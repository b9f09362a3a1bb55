"""Payment ledgers: sources, adapter, sinks.

Every operator takes edges ``(txn_id, ts, us, src, dst, amount, bank_src, bank_dst,
channel)``; ``us`` is ``ts`` in microseconds, so that windows are plain integer
arithmetic inside code generation. Rows are identified by txn_id; order is (us, txn_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.scalars import micros

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("src_account", T.StringType()),
        T.StructField("dst_account", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("bank_src", T.StringType()),
        T.StructField("bank_dst", T.StringType()),
        T.StructField("channel", T.StringType()),
    ]
)
EDGE_COLUMNS = ["txn_id", "ts", "us", "src", "dst", "amount", "bank_src", "bank_dst", "channel"]
_STRINGS = T.ArrayType(T.StringType())
_RING = [T.StructField(n, T.StringType()) for n in ("ring_id", "type", "origin", "terminal", "collector", "start", "end")] + [T.StructField(n, _STRINGS) for n in ("accounts", "depositors", "exits", "txn_ids")]
TRUTH_SCHEMA = T.StructType(
    [T.StructField(n, T.ArrayType(T.StructType(_RING))) for n in ("cycles", "mule_chains", "smurfing")]
    + [T.StructField("decoys", T.ArrayType(T.StructType([T.StructField("account", T.StringType()), T.StructField("label", T.StringType()), T.StructField("looks_like", T.StringType()), T.StructField("is_criminal", T.BooleanType())])))]
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All bank files of a folder or glob; a payment that is in two banks' files is kept once (first by file, then time)."""
    raw = spark.read.schema(LEDGER_SCHEMA).option("header", True).csv(path).withColumn("_file", F.input_file_name())
    first = F.row_number().over(W.partitionBy("txn_id").orderBy("_file", "timestamp"))
    return edges(raw.withColumn("_n", first).where("_n = 1").withColumn("timestamp", F.to_timestamp_ntz("timestamp", F.lit("yyyy-MM-dd HH:mm:ss"))))


def edges(ledger: DataFrame) -> DataFrame:
    """The engine's columns of a ledger in the file schema."""
    return ledger.select("txn_id", F.col("timestamp").alias("ts"), micros("timestamp").alias("us"), F.col("src_account").alias("src"), F.col("dst_account").alias("dst"), "amount", "bank_src", "bank_dst", "channel")


def bank_label(account: Column) -> Column:
    return F.concat(F.lit("Bank"), F.substring(F.lit("ABC"), (account % 3 + 1).cast("int"), F.lit(1)))


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger derived from the ``events`` table: users pay users."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = e.agg((F.max("user_id") + 1).alias("users"))  # one row
    dst = (F.col("user_id") * 31 + F.col("event_id") * 17 + 7) % F.col("users")
    rows = e.crossJoin(F.broadcast(users)).select(F.col("event_id").alias("txn_id"), "ts", micros("ts").alias("us"), F.col("user_id").alias("src"), dst.alias("dst"), F.col("value").alias("amount"), F.col("event_type").alias("channel"))
    return rows.select("txn_id", "ts", "us", "src", "dst", "amount", bank_label(F.col("src")).alias("bank_src"), bank_label(F.col("dst")).alias("bank_dst"), "channel")


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rings, decoys)`` of a truth document; rings have ``truth_accounts``."""
    doc = spark.read.schema(TRUTH_SCHEMA).json(path, multiLine=True)
    parts = [doc.select(F.inline(kind)) for kind in ("cycles", "mule_chains", "smurfing")]
    rings = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rings.withColumn("truth_accounts", truth_accounts()), doc.select(F.inline("decoys"))


def truth_accounts() -> Column:
    none = F.array().cast("array<string>")
    parts = F.array_union(F.array_union(F.coalesce("depositors", none), F.array_compact(F.array("collector"))), F.coalesce("exits", none))
    return F.when(F.size("accounts") > 0, F.array_distinct("accounts")).otherwise(parts)


def per_bank(e: DataFrame) -> DataFrame:
    """Every row under each bank that it touches: overlapping projections, keyed by ``bank``."""
    return e.select(F.explode(F.array_distinct(F.array("bank_src", "bank_dst"))).alias("bank"), *e.columns)


def write_bank_files(e: DataFrame, path: str) -> None:
    """One CSV folder a bank, each row in every bank's that it touches, without labels."""
    out = per_bank(e.select("txn_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("src").alias("src_account"), F.col("dst").alias("dst_account"), "amount", "bank_src", "bank_dst", "channel"))
    out.write.mode("overwrite").partitionBy("bank").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
