"""Range-partitioned order statistics equal their single-partition SQL definitions."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from reelpulse.operators import ordered


def _frame(spark, values):
    pdf = pd.DataFrame({"k": np.arange(len(values), dtype="int64"), "x": np.asarray(values, dtype="float64")})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("n,tiles,parts", [(23, 5, 3), (4, 5, 2), (100, 5, 7), (1, 5, 1), (57, 4, 16)])
def test_ntile_equals_sql(spark, n, tiles, parts):
    rng = np.random.default_rng(n)
    df, pdf = _frame(spark, rng.integers(0, 4, n))          # heavy ties, broken by k
    got = ordered.ntile(df, ["x", "k"], tiles, "t", num_partitions=parts).toPandas().sort_values("k")
    want = duckdb.sql(f"SELECT k, NTILE({tiles}) OVER (ORDER BY x, k) AS t FROM pdf ORDER BY k").df()
    assert got["t"].tolist() == want["t"].tolist()


@pytest.mark.parametrize("n,tiles,spread", [(23, 5, 4), (4, 5, 2), (100, 5, 1), (1, 5, 1), (57, 4, 100), (200, 7, 9), (0, 5, 1)])
def test_tiles_by_value_equal_ntile(spark, n, tiles, spread):
    rng = np.random.default_rng(n)
    rows = [(int(k), None if rng.random() < 0.1 else float(rng.integers(0, spread))) for k in rng.permutation(n)]
    df = spark.createDataFrame(rows, "k bigint, x double")
    got = {r.k: r.t for r in ordered.tiles_by_value(df, "x", ["k"], tiles, "t", num_partitions=3).collect()}
    con = duckdb.connect()
    con.register("rows", df.toArrow())
    assert got == dict(con.execute(f"SELECT k, NTILE({tiles}) OVER (ORDER BY x NULLS LAST, k) FROM rows").fetchall())


def test_tiles_by_value_order_only_boundary_values(spark, monkeypatch):
    """Of 1,000 rows in 100 values only those of the cut values are positioned."""
    sorted_rows, plain = [], ordered.with_position

    def counted(df, *args, **kw):
        sorted_rows.append(df.count())
        return plain(df, *args, **kw)

    monkeypatch.setattr(ordered, "with_position", counted)
    df = spark.range(1000).selectExpr("id as k", "cast(id div 10 as double) as x")
    assert ordered.tiles_by_value(df, "x", ["k"], 5, "t").groupBy("t").count().filter("count = 200").count() == 5
    assert sorted_rows == []                         # every tile starts with a value
    assert ordered.tiles_by_value(df, "x", ["k"], 3, "t").count() == 1000
    assert sorted_rows == [20]                       # 334 and 667 start within a value


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.integers(1, 9))
def test_position_is_a_permutation_in_order(spark, values, parts):
    df, pdf = _frame(spark, values)
    got = ordered.with_position(df, ["x", "k"], "pos", "n", num_partitions=parts).toPandas()
    want = pdf.sort_values(["x", "k"]).reset_index(drop=True)
    got = got.sort_values("pos").reset_index(drop=True)
    assert got["pos"].tolist() == list(range(len(values)))
    assert got["k"].tolist() == want["k"].tolist()
    assert set(got["n"]) == {len(values)}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("n", [1, 2, 10, 101])
def test_percentile_cont_equals_sql(spark, q, n):
    rng = np.random.default_rng(7 * n)
    df, pdf = _frame(spark, rng.normal(10, 3, n).round(2))
    got = ordered.percentile_cont(df, "x", q, key=["k"], num_partitions=4).collect()[0][0]
    want = duckdb.sql(f"SELECT quantile_cont(x, {q}) FROM pdf").fetchall()[0][0]
    assert got == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_percentile_of_empty_input_is_null(spark):
    df = spark.createDataFrame([], "k long, x double")
    assert ordered.percentile_cont(df, "x", 0.5, key=["k"]).collect()[0][0] is None


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_exclusive_prefix_sum(spark, parts):
    rng = np.random.default_rng(parts)
    pdf = pd.DataFrame({"s": rng.permutation(50).astype("float64"), "w": rng.integers(1, 9, 50)})
    df = spark.createDataFrame(pdf)
    got = ordered.exclusive_prefix_sum(df, ["s"], "w", "before", num_partitions=parts).toPandas()
    got = got.sort_values("s").reset_index(drop=True)
    want = pdf.sort_values("s").reset_index(drop=True)
    assert got["before"].tolist() == (want["w"].cumsum() - want["w"]).tolist()


def test_skewed_sort_key_is_spread(spark):
    """A third of the rows share one value; ties split on the row key across partitions."""
    vals = [1.0] * 300 + list(range(600))
    df, _ = _frame(spark, vals)
    from pyspark.sql import functions as F
    sizes = (df.repartitionByRange(6, "x", "k").groupBy(F.spark_partition_id()).count().toPandas()["count"])
    assert sizes.max() < 300
