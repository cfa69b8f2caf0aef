"""Every query beside its DuckDB counterpart, on the smallest tables."""

import os
from difflib import SequenceMatcher

import duckdb
import pytest

from specloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        return
    r = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(shown(x[columns.index(c)]) for c in order) for x in r.fetchall())
    assert sorted(tuple(shown(x[c]) for c in order) for x in rows) == want


def test_fuzzy_query(spark, duck):
    """The query that SQL can't express, beside plain loops."""
    people = duck.execute("SELECT c_nationkey, floor(c_acctbal / 1000)::BIGINT, c_name, 0 FROM customer UNION ALL SELECT s_nationkey, floor(s_acctbal / 1000)::BIGINT, s_name, 1 FROM supplier").fetchall()
    want = set()
    for key in {p[:2] for p in people}:
        used = set()
        for old in sorted(p[2] for p in people if p[:2] == key and not p[3]):
            free = sorted((-SequenceMatcher(None, old.lower(), p[2].lower()).ratio(), p[2]) for p in people if p[:2] == key and p[3] and p[2] not in used)
            if free and -free[0][0] >= 0.6:
                used.add(free[0][1])
                want.add((*key, old, free[0][1]))
    got = catalogue.QUERIES["rename_fuzzy"](spark, SF).select("nation", "level", "old", "new")
    assert {tuple(r) for r in got.collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
