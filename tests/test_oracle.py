"""Every registered query of the library proper against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from loomline import catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for name in os.listdir(data):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, data, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_agent_loop_goes_on_for_ten_rounds(spark, data):
    got = catalog.QUERIES["agent_loop"](spark, data).toPandas().sort_values("step")
    for _, rounds in got.groupby("query_id"):
        assert rounds.step.tolist() == list(range(len(rounds)))
        assert len(rounds) == 10 or rounds.first_rank.iloc[-1] == 1


@pytest.mark.parametrize("name", ["llm_generate", "llm_validate"])
def test_three_queries_are_asked_per_chunk(spark, data, name):
    got = catalog.QUERIES[name](spark, data).toPandas()
    assert {int(i.rsplit("_", 1)[1]) for i in got.query_id} == {0, 1, 2}
    assert name == "llm_validate" or (got.groupby("chunk_id").size() == 3).all()
