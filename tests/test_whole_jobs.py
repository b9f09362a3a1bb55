import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens import queries
from ledgerlens.operators import adversary

D = "/root/testdata/sf0.001"


def test_friction_frontier_searches_the_whole_grid(spark, monkeypatch):
    def run(e, suspects, source, target, amount=0.0, grid=None, most=None, **_):
        schemes = adversary.cap_grid(grid if grid is not None else adversary.default_grid(), most)
        table = adversary.friction_table(adversary.scheme_grid_table(e.sparkSession, schemes))
        return adversary.Report(True, table.withColumn("detected", F.lit(True)).withColumn("evidence", F.lit("x")), 0.0, 0.0, {}, len(schemes))

    monkeypatch.setattr(adversary, "run", run)
    monkeypatch.setattr(adversary, "kept_report", lambda spark, folder, about, search: search())
    assert queries.friction_frontier(spark, D).count() == 32


@pytest.mark.parametrize("name", ["chain_fans", "account_sparklines"])
def test_fans_and_series_cover_the_whole_ledger(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{D}/events.parquet')")
    want = con.execute(queries.ORACLES[name]).fetchall()
    got = [tuple(r) for r in queries.QUERIES[name](spark, D).collect()]
    assert want and len(got) == len(want) and sorted(r[:-1] for r in got) == sorted(r[:-1] for r in want)
    assert [x[-1] for x in sorted(got)] == pytest.approx([x[-1] for x in sorted(want)], abs=2e-6)
