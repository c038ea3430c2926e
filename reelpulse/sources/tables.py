"""Readers for the source tables (parquet test tables, canonical CSV/Parquet files)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_HANDLES: dict[tuple[str, str], DataFrame] = {}


def app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", "") or str(id(spark))


def read_table(spark: SparkSession, sf_dir: str, name: str, refresh: bool = False) -> DataFrame:
    """One driver test table.  Column pruning and filters reach the parquet scan.

    The DataFrame handle (file listing and footer schema) is kept per Spark
    application and path, so repeated queries in one session do not list and
    read footers again; ``refresh=True`` re-reads after the files change.
    """
    path = os.path.join(sf_dir, f"{name}.parquet")
    key = (app_id(spark), path)
    if refresh or key not in _HANDLES:
        _HANDLES[key] = spark.read.parquet(path)
    return _HANDLES[key]


def read_canonical(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """Read a canonical table with its fixed schema (never inferred); a malformed row ends the read.

    CSV files carry a header, in any order and letter case; other columns than the table's are an error.
    Timestamps are ``yyyy-MM-dd HH:mm:ss`` and dates ``yyyy-MM-dd``.  JSON has one object a line; absent
    fields are null and fields that the table does not have are ignored.
    """
    return _read(spark, path, table, fmt, "FAILFAST")


def read_with_quarantine(spark: SparkSession, path: str, table: str, quarantine: str,
                         fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """(rows of the table, counts of bad rows): malformed CSV or JSON rows go to ``quarantine`` instead of ending the read.

    A row is bad when a value is not of its column's type, when a CSV row has more or fewer values than the header,
    or when a line is no JSON object.  Bad rows are appended to the Parquet table ``quarantine`` as (table, file, raw,
    empty: the columns without a usable value) before anything is returned; the counts are per file of this read.
    Parquet files have types of their own and cannot hold such rows.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"no quarantine for format {fmt!r}")
    read = _read(spark, path, table, fmt, "PERMISSIVE")
    columns = [f.name for f in S.CANONICAL[table].fields]
    empty = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    bad = read.filter(F.col(RAW).isNotNull()).select(
        F.lit(table).alias("table"), F.input_file_name().alias("file"), F.col(RAW).alias("raw"), empty.alias("empty"))
    run = uuid.uuid4().hex
    target = f"{quarantine.rstrip('/')}/run={run}"
    bad.write.parquet(target)
    counts = spark.read.parquet(target).groupBy("table", "file").agg(F.count(F.lit(1)).alias("bad_rows"))
    # Every column is looked at, whatever a later query selects: a pruned read would not see a row's other bad values.
    return read.filter(F.col(RAW).isNull() & (F.size(empty) >= 0)).select(*columns), counts


#: The line of a malformed row, where a read keeps it.
RAW = "_raw_row"


def _read(spark: SparkSession, path: str, table: str, fmt: str, mode: str) -> DataFrame:
    schema = S.CANONICAL[table]
    extra = [T.StructField(RAW, T.StringType())] if mode == "PERMISSIVE" else []
    wanted = {f.name: f for f in schema.fields}
    reader = spark.read.option("mode", mode).option("columnNameOfCorruptRecord", RAW)
    reader = reader.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd")
    if fmt == "csv":
        # The header says which column is where; names match without regard to case (User_ID, user_id).
        header = spark.read.option("header", True).csv(path).columns
        found = [c.strip().lower() for c in header]
        if sorted(found) != sorted(wanted):
            raise ValueError(f"{path}: columns {header} are not those of {table}, {list(wanted)}")
        in_file = T.StructType([*(T.StructField(c, wanted[name].dataType) for c, name in zip(header, found)), *extra])
        df = reader.schema(in_file).option("header", True).csv(path)
        return df.toDF(*found, *(f.name for f in extra)).select(*wanted, *(f.name for f in extra))
    if fmt == "json":
        return reader.schema(T.StructType([*schema.fields, *extra])).json(path)
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    raise ValueError(f"unknown format {fmt!r}")
