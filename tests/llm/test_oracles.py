"""Queries of the corpus operators beside DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from specloom.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    r = c.execute(registry.ORACLES[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(shown(x[columns.index(n)]) for n in order) for x in r.fetchall())
    assert sorted(tuple(shown(x[n]) for n in order) for x in df.collect()) == want


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11))
