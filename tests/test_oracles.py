"""Every registered query equals its DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from motes.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(map(repr, pdf.astype(object).where(pdf.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
