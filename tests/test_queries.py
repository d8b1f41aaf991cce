"""Every engine query against its DuckDB statement, at the smallest scale."""

import os

import duckdb
import pytest

from millrace.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = duck.execute(SQL[name])
    names = sorted(c[0] for c in found.description)
    want = sorted(str([dict(zip([c[0] for c in found.description], r, strict=True))[n] for n in names]) for r in found.fetchall())
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == names
    assert sorted(str([r[n] for n in names]) for r in df.collect()) == want


def test_upserts_keep_only_what_they_show(spark):
    import re

    from millrace.plans.queries import _changed

    try:
        new, _ = _changed(spark, FOLDER)
        kept = re.findall(r"InMemoryRelation \[([^\]]*)\]", new._jdf.queryExecution().withCachedData().toString())
        assert kept and not any("raw_record" in columns or "corrections" in columns for columns in kept)
    finally:
        spark.catalog.clearCache()
