"""Each query against its SQL, and the queries without SQL against what they must be."""

import math

import duckdb
import pytest

from pyspark.sql import functions as F

from plumbline.plans import queries
from plumbline.plans.oracle import oracle_sql
from plumbline.plans.queries import QUERIES
from plumbline.sources.cohort import TABLES, cohort


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def comparable(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = comparable(got.select(*cols).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    found = duck.execute(f"SELECT {names} FROM ({oracle_sql()[name]})").fetchall()
    assert rows == comparable(found) and rows
    assert len(duck.execute(f"SELECT * FROM ({oracle_sql()[name]}) LIMIT 1").description) == len(cols)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_sql())


def test_whole_run_draws_its_rows_once(spark, sf, monkeypatch):
    """Each time the rows are drawn, the order tables are shuffled, and the files stay on disk."""
    drawn = spark.sparkContext.accumulator(0)

    def seen(x):
        drawn.add(1)
        return x

    monkeypatch.setattr(queries, "cohort", lambda *of: cohort(*of).withColumn("mean", F.udf(seen, "double")("mean")))
    assert QUERIES["fit_apply_check"](spark, sf).count() == 12
    assert 0 < drawn.value <= cohort(spark, sf).count()
