import random

import numpy as np
import pytest
import xxhash

from ledgerlens.llm import simhash
from ledgerlens.llm.shared import Scratch, components


def brute_fp(text, k=4):
    words, w = [], []
    for c in (text or "").encode():
        if c == 32 or 9 <= c <= 13:
            words.append(bytes(w)), w.clear()
        else:
            w.append(c + 32 if 65 <= c <= 90 else c)
    words = [x for x in [*words, bytes(w)] if x]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


TEXTS = ["", None, " \t\n", "One", "one two three", "one two three four", "a b c d e f g É x", "Ab " * 500, "x" * 100_000, "w" + " w" * 30_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_the_plain_rule(text):
    assert simhash.fingerprint(text) == brute_fp(text)


def test_covering_masks_miss_no_pair():
    rng = random.Random(3)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(20_000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4)))
        assert any(diff & (m & (1 << 64) - 1) == 0 for m in masks)


@pytest.mark.parametrize("limit,radius", [(1024, 4), (2, 4), (2, 3)])
def test_components_match_all_pairs(spark, limit, radius):
    rng = random.Random(limit + radius)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:
        for _ in range(rng.randint(1, 6)):
            f ^= sum(1 << i for i in rng.sample(range(64), rng.randint(1, 6)))
            fps.append(f)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    x = np.array(fps).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    want = brute_components(fps, [(fps[i], fps[j]) for i, j in zip(*np.nonzero(near)) if i < j])
    scratch = Scratch(spark, "t")
    edges = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, scratch, limit)
    got = {f: f for f in fps} | {r.node: r.root for r in components(edges, scratch).collect()}
    assert got == want


def test_near_duplicates_and_edge_cases(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from all of the other animals " * 8
    rows = [(5, base, "x"), (3, base.upper(), "y"), (9, base + " end", None), (7, "", None), (8, None, "z"), (1, "single words here only", "q"), (1, "single words here only", "q"), (None, base, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(tuple(r) for r in simhash.near_duplicates(df).collect() if r.doc_id is not None)
    fp = {i: f"{brute_fp(t):016x}" for i, t, _ in rows if i}
    comp = {i: c for i, _, c in got}
    assert len(got) == 7 and {i: f for i, f, _ in got} == fp
    assert comp[5] == comp[3] == 3 and comp[7] == comp[8] == 7 and comp[1] == 1
    empty = simhash.near_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "fingerprint", "component_id"]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {3, 7, 1}


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fp(r.text) for r in rows}
    ids = sorted(fps)
    want = brute_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}
