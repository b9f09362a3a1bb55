"""Token counts against the library on whole texts, with chunks far smaller than the texts."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import token_counts
from ledgerlens.llm.queries import BYTE_MODEL

PATH = public_tokenizers.path(BYTE_MODEL)
MODEL = token_counts.load(PATH)
WORDS = ["the", " of", "ing ", "'ll", "'", "ll ", "'re", "  ", "\n\n", "\t ", "<|endoftext|>", "<|endof", "text|>", "2024", "é", "中文", "😀", "👩‍👩‍👧", "!?", "...", " ", "x", " ", "don't"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False))


def check(spark, whole, given, **sizes):
    df = spark.createDataFrame(given, "doc_id long, text string").select("*", F.lit(0).alias("n_tokens"), F.lit("k").alias("k_id"), F.lit("p").alias("start"))
    got = sorted((tuple(r) for r in token_counts.count_tokens(df, MODEL, **sizes).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), whole(t), whole(t) > 512) for i, t in given), key=str)


def test_random_texts_in_small_chunks(spark, whole):
    rng = random.Random(11)
    given = [(k, "".join(rng.choices(WORDS, k=rng.randrange(1, 900)))) for k in range(60)]
    given += [(k, "".join(rng.choices(WORDS[rng.randrange(len(WORDS)) :] or ["x"], k=800))) for k in range(60, 90)]
    check(spark, whole, given, step=97, overlap=40)
    check(spark, whole, given, step=400, overlap=400)


def test_pre_tokens_longer_than_overlaps_and_chunks(spark, whole):
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choices("abcdefgh", k=n))
    given = [
        (1, letters(3000)), (2, "a" * 2000), (3, " " * 2000), (4, "x " * 50 + letters(700) + " y" * 300), (5, letters(300) + " " * 300 + "1" * 300 + "!" * 300),
        (6, (letters(150) + " ") * 12), (7, "<|endoftext|>" * 100), (8, "!" * 95 + "<|endoftext|>" + "!" * 200), (9, "\n" * 500 + "end"), (2, "a" * 2000), (None, "a" * 2000), (None, letters(999)),
    ]
    check(spark, whole, given, step=100, overlap=40)


def test_special_token_and_contraction_at_every_place_of_a_seam(spark, whole):
    given = []
    for k in range(60, 145):
        given += [(k, "word " * 12 + "z" * (k - 60) + "<|endoftext|>" + " and on " * 30), (1000 + k, "!" * k + "'ll go " * 30), (2000 + k, "a" * (k % 7) + " " * k + "b c" * 60)]
    check(spark, whole, given, step=100, overlap=40)


def test_nulls_empty_and_default_sizes(spark, whole):
    given = [(1, None), (2, ""), (None, None), (3, "short"), (3, "short"), (4, "a long text, with words. " * 5000), (4, "a long text, with words. " * 5000), (5, "b" * 70_000 + " c" * 40_000)]
    check(spark, whole, given)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty, MODEL).count() == 0


def test_only_tokenizers_that_the_proof_holds_for():
    with pytest.raises(ValueError):
        token_counts.margin(token_counts.load(public_tokenizers.path("word_bpe_49k.json")))
    with pytest.raises(ValueError):
        token_counts.count_tokens(None, MODEL, step=10, overlap=20)
    assert token_counts.margin(MODEL) == 17
