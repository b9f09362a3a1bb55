"""Column functions of the engine: time, text of numbers, bands, keyed hashes."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, MINUTE, DAY = 3_600_000_000, 60_000_000, 86_400_000_000


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone, read as it is written."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def money(c: Column) -> Column:
    """Exact for sums, whatever their order."""
    return c.cast("decimal(18,2)")


def amount_bucket(amount: Column) -> Column:
    return F.when(amount < 1_000, "<1k").when(amount < 10_000, "1k-10k").when(amount < 100_000, "10k-100k").otherwise("100k+")


def bucket_rank(bucket: Column) -> Column:
    return F.when(bucket == "<1k", 0).when(bucket == "1k-10k", 1).when(bucket == "10k-100k", 2).otherwise(3)


def hmac_sha256(key: str, text: Column) -> Column:
    """RFC 2104 from built-in digests, in hex."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in raw)), F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in raw)), F.unhex(inner)), 256)


def hashed_account(account: Column, salt: str) -> Column:
    """The pseudonym a bank shares: 16 hex digits."""
    return F.substring(hmac_sha256(salt, account.cast("string")), 1, 16)


def risk_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 55, "medium").otherwise("low")


def taint_band(fraction: Column) -> Column:
    return F.when(fraction >= 0.66, "high").when(fraction >= 0.33, "medium").otherwise("low")


def number_text(c: Column) -> Column:
    """A double of two decimals at most as JSON text: 1000.0, 980.5, 12345678.25."""
    text = F.regexp_replace(F.format_string("%.2f", c.cast("double")), "0$", "")
    return text


def json_text(c: Column) -> Column:
    """A JSON string literal; ASCII control and non-ASCII characters as the JSON writer of Spark leaves them."""
    return F.substring(F.to_json(F.array(c)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(c))) - 2)


def rounded(c: str | Column, places: int) -> Column:
    """A double to so many places, half up after it is scaled, as SQL's round does; ``F.round`` rounds its shortest decimal text instead."""
    scale = 10.0**places
    return F.round((F.col(c) if isinstance(c, str) else c) * scale) / scale


def percent(c: Column) -> Column:
    """Whole percents, halves to even, as printf writes them."""
    return F.format_string("%.0f%%", F.rint(c * 100))


def draw(*key: object) -> int:
    """32 bits that depend on ``key`` alone, as SQL's md5 gives them too."""
    return int(md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16)
