"""Fill-in-the-middle: ranks by recursive halving against plain slicing, outputs and their exact restoring."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import fim

ALPHABET = ["a", "b", " ", "\n", "é", "中", "😀", "́", "<", "P", ">", "S", "M"]


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@pytest.mark.parametrize("unit", fim.UNITS)
def test_units_and_ranks_against_plain_slicing(unit):
    rng = random.Random(7)
    begin = {"char": r"(?s).", "word": r"(?<![^ \n])[^ \n]", "line": r"(?m)^(?s:.)"}[unit]
    for length in [0, 1, 2, 3, 7, 8, 9, 63, 64, 65, 500, 4097]:
        text = "".join(rng.choices(ALPHABET, k=length))
        data = text.encode()
        starts = [len(text[: m.start()].encode()) for m in re.finditer(begin, text)] if unit != "line" else [0, *[i + 1 for i, b in enumerate(data) if b == 10 and i + 1 < len(data)]] * bool(data)
        mask = fim.unit_starts(data, unit)
        assert [i for i in range(len(data)) if mask >> i & 1] == starts
        assert [fim.ranked_bit(mask, len(data), r) for r in range(len(starts))] == starts
        n, a, b = fim.cut(data, unit, 5, 1_000_003)
        where = [0, *starts[1:], len(data)] if starts else [0]
        assert n == len(starts) and [a, b] == sorted((where[5 % (n + 1)], where[1_000_003 % (n + 1)]), key=where.index)


def rows(rng):
    out = [(None, "no id é"), (None, None), (4, None), (5, ""), (6, "has <M> inside"), (7, "<P"), (8, "<S" * 40), (9, "P><P" * 3 + "S"), (10, "😀" * 1000), (10, "😀" * 1000)]
    out += [(k, "".join(rng.choices(ALPHABET, k=rng.randrange(60)))) for k in range(100, 400)]
    return [*out, (999, "long 中 " * 300_000)]


def test_rows_against_plain_version(spark):
    given = rows(random.Random(3))
    df = spark.createDataFrame(given, "doc_id long, text string").select("*", F.lit(1).alias("n"), F.lit("x").alias("form"), F.lit("y").alias("output"))
    out = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted((plain(*g) for g in given), key=key)
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in given)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_forms_in_their_shares(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "'some text of it' as text")
    n = {r.form: r["count"] for r in fim.fill_in_middle(df).groupBy("form").count().collect()}
    assert abs(n["plain"] - 500) < 80 and abs(n["spm"] - 900) < 110


def test_other_units_and_sentinels_restore(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{i}\nx" for i in range(k % 9))) for k in range(60)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    for unit in ("word", "line"):
        out = fim.fill_in_middle(df, unit, marks, seed="other").withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).join(df, "doc_id").collect()
        assert all(r.back == r.text for r in out) and any(r.form != "plain" for r in out)
        if unit == "word":
            for r in out:
                if r.form != "plain":
                    assert re.fullmatch(r"(w\d+\s|x\s*)*", r.text[: r.prefix_chars])


def test_sentinels_that_could_be_mistaken_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", ">x", "<M>")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)
    with pytest.raises(ValueError):
        fim.fill_in_middle(None, "byte")
