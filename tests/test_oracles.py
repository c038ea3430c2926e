"""Every registered operator with a SQL oracle equals it on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from helpers import duck, duck_rows, same, spark_rows

ORACLES = E.oracle_sql()
# z-scores divide by a float mean/sd whose last bits depend on summation order in each engine.
FLOAT_AGGREGATES = {"p08_standardized_features": 9}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "DateType()": "DATE", "TimestampNTZType()": "TIMESTAMP",
                 "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = spark_rows(df)
    want = duck_rows(con, ORACLES[name])
    types = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in df.schema}
    res = con.execute(f"SELECT * FROM ({ORACLES[name]}) LIMIT 0")
    assert types == {d[0]: str(d[1]).upper() for d in res.description}
    assert len(got[1]) == len(want[1])
    assert same(got, want, digits=FLOAT_AGGREGATES.get(name, 12)), name


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "watch_hours", "sessions", "active_users", "revenue_usd", "avg_completion"]
    assert df.count() > 0
