"""Every registered query of the engine's own operators against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomworks.plans import catalog, details, families, scans  # noqa: F401  the latter register their queries in catalog

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    theirs = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert ours == theirs

