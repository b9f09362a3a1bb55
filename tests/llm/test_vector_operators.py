"""Top-k, cap filters, mixing and the pipeline against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import caps, mixing, topk

E = "/root/testdata/sf0.001/embeddings.parquet"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (50, [0.5, 0.25], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [1.0, inf], 1), (5, [None, 1.0], 1), (6, [1.0, 0.001], None), (7, [1.0, 0.002], 1), (8, [1.0, 0.003, 0.0], 1), (9, [], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.002], 1)]
    return spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, label int, rank int")


def plain_top_k(rows, k=5):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in {i: a for i, a in v if i % 50 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q and len(a) == len(b))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_matches_all_scores(spark):
    table = spark.read.parquet(E)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    for block in (37, 4096):
        got = sorted(tuple(r) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, block=block).collect())
        assert got == plain_top_k(rows)


def test_top_k_ties_and_scales(spark):
    r = random.Random(1)
    for scale in (0.004, 1e6):
        rows = [(i, [r.choice((-1.0, 0.0, 1.0)) * scale, r.choice((0.0, 1.0)) * scale]) for i in range(300)]
        got = sorted(tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=32).collect())
        assert got == plain_top_k(rows)


def test_top_k_edge_cases(spark):
    odd = odd_vectors(spark)
    rows = [(r.vec_id, r.embedding) for r in odd.collect()]
    assert sorted(tuple(x) for x in topk.top_k(odd, F.col("vec_id") % 50 == 0).collect()) == plain_top_k(rows)
    assert topk.top_k(odd.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(odd, F.lit(False)).count() == 0


def plain_links(ids, labels, x):
    n = {i: 0 for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if labels[a] == labels[b] and labels[a] is not None and x[a] is not None and x[b] is not None and len(x[a]) == len(x[b]):
                u, v = np.array(x[a]), np.array(x[b])
                if u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.98:
                    n[ids[a]] += 1
                    n[ids[b]] += 1
                    p, q = find(ids[a]), find(ids[b])
                    root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("block", [1024, 16])
def test_cap_filters_find_planted_links(spark, block):
    rng = np.random.default_rng(7)
    x = []
    for _ in range(60):
        c = rng.standard_normal(64)
        c /= np.linalg.norm(c)
        x += [c + rng.standard_normal(64) * s for s in rng.choice([0.0, 0.005, 0.012, 0.02], rng.integers(1, 6))]
    hot = rng.standard_normal(64)
    x += [hot + rng.standard_normal(64) * 0.05 for _ in range(80)]
    labels = [int(k) % 2 for k in range(len(x))]
    rows = [(k, [float(f) for f in v], lab) for k, (v, lab) in enumerate(zip(x, labels))]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=block).collect()}
    want = plain_links([r[0] for r in rows], labels, [r[1] for r in rows])
    total, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
    assert total > 1000 and found >= 0.99 * total and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_decoding_lists_exactly_the_caps_above():
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((20, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for parts in (1, 2, 3):
        rotation, books = caps.code(12, parts, 8)
        got = caps.decode(unit, parts, 8, 0.4)
        words = [[]]
        for b in books:
            words = [[*w, k] for w in words for k in range(8)]
        for u, g in zip(unit @ rotation.T, got):
            want = []
            for w in words:
                if np.concatenate([b[k] for b, k in zip(books, w)]) @ u > 0.4:
                    want.append(sum(k * 8 ** (parts - 1 - n) for n, k in enumerate(w)))
            assert sorted(g.tolist()) == sorted(want)


def test_cap_filters_edge_cases(spark):
    odd = odd_vectors(spark).where("vec_id is not null")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in caps.near_duplicates(odd).collect()}
    assert got[0] == (1, 0, True) and got[7] == (1, 0, False)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 8, 9, 50))
    assert caps.near_duplicates(odd.limit(0)).count() == 0


# -- mixing ------------------------------------------------------------------
def test_targets_reshare_the_excess():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200.0, 250 / 3, 500 / 3])
    assert mixing.targets([10, 1000]) == pytest.approx([20.0, 1495.0])
    assert mixing.targets([0, 0]) == [0.0, 0.0] and mixing.targets([]) == []
    t = mixing.targets([7, 50, 900, 30, 30])
    assert sum(t) == pytest.approx(1.5 * 1017) and all(x <= 2 * s + 1e-9 for x, s in zip(t, [7, 50, 900, 30, 30]))


def test_solution_meets_the_constraints_and_is_tilted(spark):
    r = random.Random(8)
    cells = [(s, size, r.randint(1, 5)) for s in range(3) for size in sorted(r.sample(range(1, 4000), 60))]
    sums = {}
    for s, share in ((0, 1.7), (1, 0.4), (2, 1.0)):
        tokens, n = sum(z * k for c, z, k in cells if c == s), sum(k for c, _, k in cells if c == s)
        sums[s] = (n, tokens, share * tokens)
    lam = mixing.solve(spark.createDataFrame(cells, "sid int, size long, n long"), sums)
    for s, (n, tokens, target) in sums.items():
        rate = lambda z: 2 / (1 + math.exp(-lam[s] * z * n / tokens))  # noqa: E731, B023
        assert sum(k * z * rate(z) for c, z, k in cells if c == s) == pytest.approx(target, rel=1e-6)


def test_mix_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).select("doc_id", "source", "text", "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken").collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        words = [w for w in r.text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        assert r.mix_size == len(words) and r.mix_taken == r.mix_copies * r.mix_size <= 2 * r.mix_size
        by.setdefault(r.source, []).append(r)
    sources = sorted(by)
    want = mixing.targets([sum(r.mix_size for r in by[s]) for s in sources])
    for s, t in zip(sources, want):
        assert {r.mix_target for r in by[s]} == {t}
        assert abs(sum(r.mix_taken for r in by[s]) - t) <= max(0.005 * t, 10)
    again = {(r.doc_id, r.mix_taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.mix_taken) for r in rows}


def test_mix_edge_cases(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "w " * 5000, None), (None, "q", "é"), (6, " \n", "only blank")] + [(10 + k, "same words here", "hot") for k in range(300)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r.mix_copies <= 2 for r in got)
    assert all(r.mix_taken == 0 for r in got if not (r.text or "").strip())
    hot = [r for r in got if r.source == "hot"]
    assert abs(sum(r.mix_taken for r in hot) - hot[0].mix_target) <= 3
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.mix_copies for r in got)


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, d)
        after = spark.createDataFrame(after.collect(), after.schema)
        assert after.columns == columns, name
        if name != "mix_sources":
            assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
        before = after
    last = p.STAGES[-1][1](spark, before, d)
    assert last.count() == before.count()
    whole = sorted((r.doc_id, r.ids_sha256) for r in p.run(spark, d).collect())
    assert whole == sorted((r.doc_id, r.ids_sha256) for r in last.collect())


# -- scale, ids and copies ---------------------------------------------------
def near_rows(spark, rows, **settings):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, c int, unit string") if rows and len(rows[0]) == 5 else spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, c int, unit string")
    return sorted([tuple(r) for r in caps.near_duplicates(table, **settings).collect()], key=str)


def test_cap_filters_of_any_scale(spark):
    v = [0.3, -0.4, 0.5, 0.1, 0.2, 0.9, -0.7, 0.6]
    near = [x + 0.001 for x in v]
    for scale in (1e200, 1e-200, 1e300, 5e-324 / 0.1 * 100, 1.0):
        a, b = [x * scale for x in v], [x * scale for x in near]
        got = near_rows(spark, [(1, a, 3), (2, a, 3), (3, b, 3), (4, [x * 0.37 for x in v], 3), (5, a, 4)])
        assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True)], scale


def test_cap_filters_ids_that_repeat_or_lack(spark):
    v, w = [1.0, 2.0], [2.0, -1.0]
    assert near_rows(spark, [(1, v, None), (1, v, 3), (2, v, 3)]) == sorted([(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)], key=str)
    assert near_rows(spark, [(None, v, 3), (2, v, 3), (None, w, 3), (None, [-1.0, -2.0], 3), (None, [-1.0, -2.0], 3)]) == sorted([(None, 1, 2, False), (2, 1, 2, True), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_cap_filters_count_many_copies(spark):
    rng = np.random.default_rng(9)
    hot, near = rng.standard_normal(32), None
    near = hot + rng.standard_normal(32) * 0.01
    rows = spark.range(10_000).selectExpr("id as vec_id", f"array({','.join(map(str, hot.tolist()))}) as embedding", "1 as label")
    rows = rows.unionByName(spark.range(10_000, 10_050).selectExpr("id as vec_id", f"array({','.join(map(str, near.tolist()))}) as embedding", "1 as label"))
    got = caps.near_duplicates(rows).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(10_049, 0, 10_050)]


def test_every_vector_has_its_best_caps():
    rng = np.random.default_rng(4)
    unit = rng.standard_normal((50, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rotation, books = caps.code(16, 2, 16)
    for u, got in zip(unit, caps.decode(unit, 2, 16, 0.99, 5)):
        turned = rotation @ u
        score = (books[0] @ turned[:8])[:, None] + (books[1] @ turned[8:])[None, :]
        assert sorted(np.argsort(-score.ravel())[:5].tolist()) == got.tolist()
