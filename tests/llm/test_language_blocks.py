"""More languages than a matrix may hold are scored in blocks of columns, with the same result."""

import pytest

from ledgerlens.llm import langid


@pytest.mark.parametrize("columns", [1, 3])
def test_blocks_make_no_difference(spark, monkeypatch, columns):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "case when lang = 'en' then concat(lang, doc_id % 4) else lang end as lang")
    rows = rows.unionByName(spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 34", None), (None, "le chat est là", None)], rows.schema))
    want = sorted(map(tuple, langid.identify(rows, 1 << 10).collect()), key=str)
    monkeypatch.setattr(langid, "MATRIX_BYTES", 8 * (1 << 10) * columns)
    got = sorted(map(tuple, langid.identify(rows, 1 << 10).collect()), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)
    assert len({w[2] for w in want}) > 3
