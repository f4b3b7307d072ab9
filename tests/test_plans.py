"""Every plan against DuckDB on the small tables, and the entry point."""

import duckdb
import pytest

from feedloom import catalogue as C

SF = "/root/testdata/sf0.001"


def rows(frame, cols):
    return sorted((tuple(r) for r in frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in C.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(C.QUERIES))
def test_plan(spark, duck, name):
    if name not in C.ORACLES:
        assert C.QUERIES[name](spark, SF).count() > 0
        return
    got, want = C.QUERIES[name](spark, SF).toPandas(), duck.execute(C.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert rows(got, cols) == rows(want, cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_keyword_boundaries():
    from feedloom.functions.rules import any_of, keyword
    from feedloom.plans.dialect import Duck

    c, d = duckdb.connect(), Duck()
    ask = lambda text, w: c.execute(f"SELECT {keyword(d, 't', w)} FROM (SELECT '{text}' AS t)").fetchone()[0]
    assert ask("The THING is", "thing") and not ask("nothing", "thing") and not ask("thing2", "thing") and ask("a###b", "###")
    assert any_of(d, "t", ()) == "FALSE"
