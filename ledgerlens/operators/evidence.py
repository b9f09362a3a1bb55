"""Hash-chained evidence: canonical records and their chain, folded per ring inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_text, number_text, rounded

ZERO = "0" * 64


def _strings(c: Column) -> Column:
    return F.to_json(F.transform(c, lambda x: x.cast("string")))


def _time(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")


def records(rings: DataFrame, e: DataFrame) -> DataFrame:
    """``ring_id, seq, record``: the case record, then one per payment of the hit that the ledger has, in order; compact JSON with sorted keys."""
    case = F.concat(
        F.lit('{"accounts":'), _strings(F.col("accounts")), F.lit(',"amount":'), number_text(F.col("amount")), F.lit(',"banks":'), _strings(F.col("banks")), F.lit(',"kind":"case","ring_id":'), json_text(F.col("ring_id")),
        F.lit(',"score":'), number_text(F.col("score")), F.lit(',"type":'), json_text(F.col("type")), F.lit(',"window":['), json_text(_time(F.col("start_us"))), F.lit(","), json_text(_time(F.col("end_us"))), F.lit("]}"),
    )
    txn = F.concat(
        F.lit('{"amount":'), number_text(rounded("amount", 2)), F.lit(',"channel":'), json_text(F.col("channel")), F.lit(',"dst":'), json_text(F.col("dst").cast("string")), F.lit(',"kind":"txn","src":'), json_text(F.col("src").cast("string")),
        F.lit(',"time":'), json_text(_time(F.col("us"))), F.lit(',"txn_id":'), json_text(F.col("txn_id").cast("string")), F.lit("}"),
    )
    ids = rings.select("ring_id", F.posexplode("txn_ids").alias("pos", "txn_id")).join(e, "txn_id").groupBy("ring_id").agg(F.array_sort(F.collect_list(F.struct("pos", txn.alias("r")))).alias("t"))
    return rings.select("ring_id", case.alias("c")).join(ids, "ring_id", "left").select("ring_id", F.posexplode(F.concat(F.array("c"), F.coalesce(F.transform("t", lambda x: x["r"]), F.array().cast("array<string>")))).alias("seq", "record"))


def _hash(record: Column, prev: Column) -> Column:
    return F.sha2(F.concat(F.lit('{"prev":"'), prev, F.lit('","record":'), record, F.lit("}")), 256)


def chain(records_: DataFrame) -> DataFrame:
    """``ring_id, seq, record, prev_hash, hash``; a ring's records are folded in order from 64 zeros."""
    ordered = records_.groupBy("ring_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "record"))), lambda s: s["record"]).alias("r"))
    start = F.array(F.lit(ZERO))
    hashes = F.aggregate("r", start, lambda acc, r: F.concat(acc, F.array(_hash(r, F.element_at(acc, -1)))))
    links = F.transform("r", lambda r, i: F.struct(i.alias("seq"), r.alias("record"), F.col("h")[i].alias("prev_hash"), F.col("h")[i + 1].alias("hash")))
    return ordered.withColumn("h", hashes).select("ring_id", F.inline(links))


def verify(links: DataFrame) -> DataFrame:
    """``ring_id, valid, broken_at, final_hash``: broken where number, predecessor or digest is wrong, first such place."""
    ordered = links.groupBy("ring_id").agg(F.array_sort(F.collect_list(F.struct("seq", "record", "prev_hash", "hash"))).alias("l"))
    prev = lambda i: F.when(i == 0, F.lit(ZERO)).otherwise(F.col("l")[i - 1]["hash"])
    bad = F.transform("l", lambda x, i: F.when((x["seq"] != i) | (x["prev_hash"] != prev(i)) | (x["hash"] != _hash(x["record"], x["prev_hash"])), i))
    broken = F.array_min(F.array_compact(bad))
    return ordered.select("ring_id", broken.isNull().alias("valid"), broken.alias("broken_at"), F.coalesce(F.element_at("l", -1)["hash"], F.lit(ZERO)).alias("final_hash"))


def ring_transactions(e: DataFrame, ring: DataFrame, limit: int | None = None) -> DataFrame:
    ids = ring.select(F.explode("txn_ids").alias("txn_id"))
    out = e.join(ids, "txn_id", "left_semi").orderBy("us", "txn_id")
    return out.limit(limit) if limit else out


def case_story(rings: DataFrame) -> DataFrame:
    """``ring_id, story``: a sentence per type."""
    n, money = F.size("accounts").cast("string"), F.format_string("%.2f", F.col("amount"))
    story = (
        F.when(F.col("type") == "cycle", F.concat(F.lit("Money left "), F.col("origin").cast("string"), F.lit(" and came back through "), n, F.lit(" accounts: "), money, F.lit(" set out.")))
        .when(F.col("type") == "mule_chain", F.concat(money, F.lit(" was passed on quickly from "), F.col("origin").cast("string"), F.lit(" to "), F.col("terminal").cast("string"), F.lit(" over "), n, F.lit(" accounts.")))
        .otherwise(F.concat(F.col("n_deposits").cast("string"), F.lit(" deposits below the reporting threshold gathered "), money, F.lit(" at "), F.col("collector").cast("string"), F.lit(".")))
    )
    return rings.select("ring_id", story.alias("story"))
