"""Metamorphic oracle runs on altered copies of the smallest tables.

* ``dups``  - every 7th customer and part listed twice (dimension keys not unique);
* ``nulls`` - NULL brand (genre), order priority (device), discount (completion)
              and quantity (minutes) on a share of rows;
* ``skew``  - one customer owns a third of all orders and one user a third of all
              events;
* ``empty`` - no orders, lineitems or events (every fact-driven result is empty or
              its aggregate over nothing);
* ``ties``  - constant quantity, discount and event value, so minutes, completion and
              hours tie everywhere (rank, top-k, NTILE and percentile boundaries).

In each, every operator must still equal its SQL oracle: the aggregate-before-join
plans keep row-level join semantics, NULLs are handled as SQL does, and the
hot-key paths (salting, range partitions, partial aggregates) stay exact.
"""

import os
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from helpers import duck, duck_rows, same, spark_rows
from reelpulse.sources.tables import TEST_TABLES

ORACLES = E.oracle_sql()
DIGITS = {"p08_standardized_features": 9}


def _every(table, k, offset=0):
    """Mask selecting every k-th row (shifted by ``offset``)."""
    return pa.array([(i + offset) % k == 0 for i in range(table.num_rows)])


def _null_where(table, column, mask):
    col = table[column]
    nulls = pa.nulls(table.num_rows, type=col.type)
    return table.set_column(table.schema.get_field_index(column), column, pc.if_else(mask, nulls, col))


def _set_where(table, column, mask, value):
    col = table[column]
    return table.set_column(table.schema.get_field_index(column), column,
                            pc.if_else(mask, pa.scalar(value, type=col.type), col))


def _variant(kind, t, table):
    if kind == "dups" and t in ("customer", "part"):
        return pa.concat_tables([table, table.take(pa.array(range(0, table.num_rows, 7)))])
    if kind == "nulls":
        if t == "part":
            return _null_where(table, "p_brand", _every(table, 11))
        if t == "orders":
            return _null_where(table, "o_orderpriority", _every(table, 13))
        if t == "lineitem":
            table = _null_where(table, "l_discount", _every(table, 17))
            return _null_where(table, "l_quantity", _every(table, 19, 5))
        if t == "events":
            return _null_where(table, "value", _every(table, 23))
    if kind == "ties":
        if t == "lineitem":
            everyone = pa.array([True] * table.num_rows)
            return _set_where(_set_where(table, "l_quantity", everyone, 10.0), "l_discount", everyone, 0.05)
        if t == "events":
            return _set_where(table, "value", pa.array([True] * table.num_rows), 7.5)
    if kind == "empty" and t in ("orders", "lineitem", "events"):
        return table.slice(0, 0)
    if kind == "skew":
        if t == "orders":
            return _set_where(table, "o_custkey", _every(table, 3), 1)
        if t == "events":
            return _set_where(table, "user_id", _every(table, 3), 1)
    return table


def _make(kind):
    out = tempfile.mkdtemp(prefix=f"reelpulse-{kind}-")
    for t in TEST_TABLES:
        table = pq.read_table(os.path.join(SF_SMALL, f"{t}.parquet"))
        pq.write_table(_variant(kind, t, table), os.path.join(out, f"{t}.parquet"))
    return out


@pytest.fixture(scope="module", params=["dups", "nulls", "skew", "empty", "ties"])
def variant(request):
    d = _make(request.param)
    return d, duck(d)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle_on_variant(spark, variant, name):
    d, con = variant
    got = spark_rows(E.queries()[name](spark, d))
    want = duck_rows(con, ORACLES[name])
    assert len(got[1]) == len(want[1])
    assert same(got, want, digits=DIGITS.get(name, 12)), name
