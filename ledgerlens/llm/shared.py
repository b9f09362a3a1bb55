"""Shared folder, written tables, Arrow streaming and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the JVM packs into one Arrow batch at most; texts may be long.
ARROW_ROWS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, or a local one where it is unset and all work is local too (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return spark.sparkContext.getCheckpointDir()


#: What tells a row's text from all others: whether it has no id, the id, and a 64-bit hash of the text.
KEY = ["k_none", "k_id", "k_text"]


def key_of_text() -> list[Column]:
    """The columns KEY of a row of documents; rows without an id sort last, equal texts under one id are one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").isNull().alias("k_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k_id"), F.xxhash64(text).alias("k_text")]


def whole_rows(docs: DataFrame) -> DataFrame:
    """``k_row``, the rows of ``docs`` as structs, and KEY: columns of any name stay inside the struct."""
    return docs.select(F.struct("*").alias("k_row"), *key_of_text())


#: A key has 16 bits of the bitmap, in words of 64; it has at least 2^10 words, and at most 2^21 (some 100 MB where they are sent to).
_KEY_BITS, _LEAST_WORDS, _MOST_WORDS = 4, 10, 21


def word_bits(keys: int) -> int:
    """Bits of the hash that name a word of the bitmap of so many keys."""
    return min(_MOST_WORDS, max(_LEAST_WORDS, max(keys, 1).bit_length() + _KEY_BITS - 6))


def marked(rows: DataFrame, keys: DataFrame, most: int | None = None) -> DataFrame:
    """``rows`` with ``k_maybe``, which is false only if no row of ``keys``, a written table, has the same KEY.

    Keys set bits of a bitmap that is broadcast, so that rows that can't match stay out of
    the exchange of a join that follows. It grows with the keys: one row in 16 at most is
    marked for nothing, up to 8 million keys; from there on its size stays, and so more
    are, half of them at 90 million. What is marked for nothing is moved by the join, whose result is the same.
    ``most``: the bits of a word's name at most, for tests.
    """
    bits_of_word = word_bits(keys.count()) if most is None else most
    word, bit = f"shiftrightunsigned(k_text, {64 - bits_of_word})", "cast(k_text & 63 as int)"
    bits = keys.groupBy(F.expr(word).alias("k_word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("k_bits"))
    joined = rows.withColumn("k_word", F.expr(word)).join(F.broadcast(bits), "k_word", "left")
    return joined.withColumn("k_maybe", F.expr(f"coalesce(bit_get(k_bits, {bit}) = 1, false)")).drop("k_word", "k_bits")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.at}/{self.n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Hands memory that a worker has freed back to the system, where its C library keeps it otherwise: workers go on to other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most ARROW_ROWS rows (the session's setting is lowered to that); a task's freed memory is given back at its end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


#: Bytes of a batch that go to a Python worker at once in the pipeline; a single longer text is one batch.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the bytes of an Arrow batch, not only its rows: buffers on both sides stay small where long texts lie side by side."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: ``(node, root)``, root the smallest node; only nodes that have an edge.

    Alternates large-star and small-star (Kiveris et al. 2014) until the edge set
    stays as it is: O(log n) rounds, never more edges than at the start. Each
    minimum is a partial aggregate and is written before it is joined back, so
    that the join is between two plain exchanges which AQE splits at hub nodes.
    """
    cur = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    signature = _signature(cur)
    while signature[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m")))
        large = scratch.write(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(cur, low, large, low2)
        cur, before, signature = new, signature, _signature(new)
        if signature == before:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def inline_table(spark: SparkSession, rows_json: str, ddl: str) -> DataFrame:
    """A small driver-side list of records as a DataFrame, without Python workers."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(rows_json), f"array<struct<{ddl}>>")))
