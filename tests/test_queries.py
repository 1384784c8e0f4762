"""Every registered query over boxes against its SQL in DuckDB, and plans."""

from contextlib import redirect_stdout
from io import StringIO
from pathlib import Path

import duckdb
import pytest

from boxwright import queries
from boxwright.operators import join, range_query

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the standard tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def normal(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype(object)
    return cols, sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    assert normal(got) == normal(duck.sql(queries.ORACLES[name]).df())


def plan(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_window_bounds_reach_the_scan(spark, tmp_path):
    queries.fixture(spark, str(DATA), "parcels").write.parquet(str(tmp_path / "p"))
    text = plan(range_query.range_single(spark.read.parquet(str(tmp_path / "p")), (100, 100, 300, 300)).select("id"))
    assert "GreaterThanOrEqual(max_x,100.0)" in text and "LessThanOrEqual(min_x,300.0)" in text


def test_grid_plan(spark):
    a, b = (queries.fixture(spark, str(DATA), n) for n in ("parcels", "zones"))
    text = plan(join.join_pairs(a, b, "grid"))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text


def test_sql_range_of_large_sets(spark, duck, monkeypatch):
    monkeypatch.setattr(join, "NESTED_PAIRS", 0)
    got = queries.QUERIES["sql_range"](spark, str(DATA))
    text = plan(got)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert normal(got.toPandas()) == normal(duck.sql(queries.ORACLES["sql_range"]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 14
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
