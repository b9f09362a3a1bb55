"""Small ledgers for tests."""

from datetime import datetime, timedelta

from ledgerlens.functions.scalars import micros

T0 = datetime(2026, 1, 1, 9, 0)


def at(hours=0.0, minutes=0.0, days=0.0):
    return T0 + timedelta(days=days, hours=hours, minutes=minutes)


def edges(spark, rows):
    """Rows (src, dst, txn_id, amount, time[, bank_src, bank_dst])."""
    full = [(k, t, s, d, float(a), *(b or ("BankA", "BankA")), "wire") for s, d, k, a, t, *b in rows]
    df = spark.createDataFrame(full, "txn_id string, ts timestamp_ntz, src string, dst string, amount double, bank_src string, bank_dst string, channel string")
    return df.withColumn("us", micros("ts"))
