"""Rows that share a doc_id, rows without one, and columns whose names clash with the operators' own."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import langid, line_dedup, mixing, secrets, simhash, substring_dedup, topk
from ledgerlens.llm.shared import KEY, key_of_text, marked, word_bits

RUN = "first repeated line here\nsecond repeated line here\nthird repeated line here"
LONG = " ".join(f"word{k}" for k in range(60))
NAMES = ["_gone", "_spans", "lines", "spans", "mix_sid", "mix_base", "mix_more", "mix_bucket", "mix_name", "mix_row", "k_row", "k_kept", "h", "sid", "size", "rank", "fp", "c", "low", "first", "bands", *KEY]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


STAGES = [langid.keep_identified, line_dedup.deduplicate, substring_dedup.deduplicate, simhash.keep_one, mixing.mixed_documents]


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns_of_any_name(spark, stage):
    df = frame(spark, [(1, RUN, "en", "a"), (2, RUN, "en", "a"), (3, f"other text\n{RUN}", "en", "b"), (4, None, None, None), (5, "", "en", "b"), (None, RUN, "en", None), (3, f"other text\n{RUN}", "en", "b")])
    out = stage(df)
    assert out.columns == df.columns
    assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in out.collect() for n in NAMES)
    assert stage(df.limit(0)).count() == 0


def test_mix_results_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7, "q")], "doc_id long, text string, source string, mix_size int, mix_sid string")
    (r,) = mixing.mix(df).collect()
    assert (r.mix_size, r.mix_sid, r.mix_taken) == (2, "q", r.mix_copies * 2)


def test_lines_go_from_their_own_text_only(spark):
    unique = "\n".join(f"line {k} of a text that is unlike the others" for k in range(5))
    df = frame(spark, [(1, RUN + "\nend of one", "en", "a"), (5, RUN + "\nend of five", "en", "a"), (5, unique, "en", "a"), (None, RUN + "\nno id", "en", "a")])
    got = {(r.doc_id, r.text) for r in line_dedup.deduplicate(df, long_words=None).collect()}
    assert got == {(1, RUN + "\nend of one"), (5, "end of five"), (5, unique), (None, "no id")}


def test_passages_go_from_their_own_text_only(spark):
    a, b = LONG + " and an end of its own", " ".join(f"other{k}" for k in range(60))
    df = frame(spark, [(1, "intro " + LONG, "en", "a"), (5, a, "en", "a"), (5, b, "en", "a"), (None, LONG, "en", "a")])
    got = {r.text for r in substring_dedup.deduplicate(df).collect()}
    assert b in got and a not in got and "intro " + LONG in got and LONG not in got


def test_near_copies_are_told_by_text(spark):
    other = " ".join(f"other{k}" for k in range(60))
    df = frame(spark, [(1, LONG, "en", "a"), (5, LONG + " tail", "en", "a"), (5, other, "en", "a"), (5, other, "en", "a"), (None, LONG, "en", "a"), (None, "only here " + RUN, "en", "a")])
    got = sorted(((r.doc_id or 99), r.text) for r in simhash.keep_one(df).collect())
    assert got == sorted([(1, LONG), (5, other), (99, "only here " + RUN)])


def test_language_of_each_row_alone(spark):
    df = frame(spark, [(1, "english words here", "en", "a"), (1, "123 456", "en", "a"), (None, "789", None, "a"), (None, "more words", None, "a")])
    assert {r.text for r in langid.keep_identified(df).collect()} == {"english words here", "more words"}


def test_top_k_of_empty_vectors_and_repeated_queries(spark):
    rows = [(0, []), (1, []), (50, []), (7, [1.0]), (100, [0.5]), (100, [0.25]), (100, [float("nan")]), (8, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (100, 1, 7, 64 * 256), (100, 2, 8, -64 * 256)]
    only = spark.createDataFrame([(0, []), (5, [])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(only, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 5, 0)]


def test_top_k_with_components_of_any_size(spark):
    rows = [(0, [1e16, 1.0]), (1, [1e308, -1e308]), (2, [0.5, 0.25]), (3, [-131072.0, 131071.5]), (50, [3.0, -2.0]), (7, [99999.25, 0.0]), (8, [float("inf"), 0.0])]
    top = topk.most(2)
    whole = lambda x: max(-top, min(top, math.floor(256 * x)))
    kept = {i: [whole(x) for x in v] for i, v in rows if i not in (1, 8)}
    kept[1] = [top, -top]
    want = []
    for q in (0, 50):
        scored = sorted(((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q))
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()) == want


def test_secrets_of_equal_rows(spark):
    df = frame(spark, [(1, "token=abcdef1", "en", "a"), (1, "token=abcdef1", "en", "a"), (None, None, None, None)])
    assert sorted(str(r.spans) for r in secrets.find_secrets(df).collect()) == ["", "assign:0:13", "assign:0:13"]


@pytest.mark.parametrize("most", [None, 1])
def test_marks_miss_no_key(spark, tmp_path, most):
    rows = spark.range(5000).selectExpr("id as doc_id", "concat('text ', id % 4000) as text").select("doc_id", *key_of_text())
    for keep in (1, 97, 10**9):
        keys = rows.where(F.col("doc_id") % keep == 0)
        got = marked(rows, keys, most).select("doc_id", "k_maybe", "k_text").collect()
        hashes = {r.k_text for r in keys.collect()}
        assert len(got) == 5000 and all(r.k_maybe for r in got if r.k_text in hashes)
        if most is None:
            assert sum(r.k_maybe for r in got) <= sum(r.k_text in hashes for r in got) * 1.0 + 350
    assert not any(r.k_maybe for r in marked(rows, rows.limit(0)).collect())


def test_bitmaps_grow_with_their_keys_up_to_a_bound():
    assert [word_bits(n) for n in (0, 1000, 100_000, 8_000_000, 10**9)] == [10, 10, 15, 21, 21]
    assert all((1 << word_bits(n)) * 64 >= 16 * n for n in range(1, 8_000_000, 99_991))


def test_stages_give_the_same_with_a_bitmap_that_is_full(spark, monkeypatch):
    rows = [(k, f"{RUN}\nown line {k} of it\n{LONG if k % 3 == 0 else ''}", "en", "a") for k in range(40)] + [(100 + k, f"single text number {k} " * 20, "en", "b") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    results = lambda: [sorted(tuple(r) for r in stage(df).collect()) for stage in (line_dedup.deduplicate, simhash.keep_one)]
    plain = results()
    for module in (line_dedup, simhash):
        monkeypatch.setattr(module, "marked", lambda rows, keys: marked(rows, keys, 1))
    assert results() == plain


def test_lines_of_a_very_long_text_go_in_one_pass(spark):
    """80,000 repeated lines in one row: each line is looked up once, not against all deleted ones."""
    repeated = "\n".join(f"repeated line {k} of a text" for k in range(80_000))
    df = spark.createDataFrame([(1, repeated, "en", "a"), (2, f"before\n{repeated}\nafter", "en", "a")], "doc_id long, text string, lang string, source string")
    began = time.time()
    out = {r.doc_id: r.text for r in line_dedup.deduplicate(df).collect()}
    assert out == {1: repeated, 2: "before\nafter"} and time.time() - began < 60


def test_lines_between_the_deleted_ones(spark):
    rows = [("a\nb\nc", [0]), ("a\nb\nc", [1]), ("a\nb\nc", [2]), ("a\nb\nc\n", [0, 1, 2]), ("a\n\nb\n", [1]), ("a", [0]), ("a\nb\nc\nd", [0, 2]), ("\n\n", [1])]
    df = spark.createDataFrame(rows, "text string, gone array<int>")
    want = ["\n".join(line for n, line in enumerate(t.split("\n")) if n not in g) for t, g in rows]
    assert [r[0] for r in df.select(line_dedup.without_lines(F.col("text"), F.col("gone"))).collect()] == want


def test_cuts_of_long_texts_are_linear():
    for n in (50_000, 100_000):
        text = "\n".join(map(str, range(n)))
        began = time.time()
        spans = [{"start": k, "end": k + 1} for k in range(0, len(text), 2)]
        assert substring_dedup.without_spans(text, spans) == text[1::2] and time.time() - began < 4
    assert substring_dedup.without_spans(None, []) is None and substring_dedup.without_spans("ab", []) == "ab"


def test_only_wanted_and_claimed_languages_stay(spark):
    rng = random.Random(1)
    words = {"en": ["the", "of", "and", "with", "this"], "de": ["und", "der", "nicht", "auch", "eine"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=30)), lang, "a") for k, lang in enumerate(["en", "de"] * 30)] + [(100, "12 34", "en", "a"), (101, None, "de", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stay = lambda **x: sorted(r.doc_id for r in langid.keep_identified(df, **x).collect())
    assert stay() == list(range(60)) and stay(wanted=["de"]) == list(range(1, 60, 2)) and stay(wanted=[]) == [] and stay(least=1.01) == []
