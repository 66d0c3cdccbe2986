"""Every query with SQL gives the rows that a second engine gives for that SQL."""

import math
from decimal import Decimal

import duckdb
import pytest

from loomgraph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_match(spark, other, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = other.sql(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in found.fetchall()), key=repr)
    assert mine == theirs


def test_mention_windows_take_fifteen_lines(spark, tmp_path):
    lines = ["x"] * 100
    lines[20] = lines[45] = lines[90] = "a License"
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.start, r.end) for r in catalog.queries()["tx03_mention_windows"](spark, str(tmp_path)).collect())
    assert got == [(5, 61), (75, 100)]
