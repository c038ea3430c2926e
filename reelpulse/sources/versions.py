"""Published versions of a mart folder.

A build writes into a folder of its own, ``builds/<id>``, and becomes visible by its manifest, the last thing written:
``manifests/<number>`` lists every table with its folder, the session mart month by month.  A manifest counts once
Spark has committed it (``_SUCCESS``); the highest number is current.  So a build that fails midway leaves the old
version as it was, readers never see a mixture, and a version of some new months is a manifest that points to the old
folders for all other months.  Two builds that publish the same number at once: the second fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = "table string, month string, path string, format string"
#: The folder that Spark writes for a null partition value.
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def new_build(root: str) -> str:
    """A folder for the next build."""
    return f"{root.rstrip('/')}/builds/{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """The committed manifests, ascending, in any store that Spark can list."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/manifests/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName()) for f in (found or []))


def versions(spark: SparkSession, root: str) -> list[int]:
    """All published versions, oldest first."""
    return _numbers(spark, root)


def publish(spark: SparkSession, root: str, entries: list[tuple]) -> int:
    """Make (table, month or None, path, format) entries the current version; returns its number."""
    number = (_numbers(spark, root) or [0])[-1] + 1
    spark.createDataFrame(entries, _COLUMNS).coalesce(1).write.mode("error").json(f"{root.rstrip('/')}/manifests/{number}")
    return number


def manifest(spark: SparkSession, root: str, version: int | None = None) -> list[tuple]:
    """The entries of a version (default: the current one)."""
    known = _numbers(spark, root)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{root} has no published version{'' if version is None else f' {version}'}")
    rows = spark.read.schema(_COLUMNS).json(f"{root.rstrip('/')}/manifests/{version or known[-1]}").collect()
    return [tuple(r) for r in rows]


def month_entries(spark: SparkSession, table: str, path: str) -> list[tuple]:
    """An entry for every month of a table partitioned by month."""
    months = [r.month for r in spark.read.parquet(path).select("month").distinct().collect()]
    return [(table, m or _NO_MONTH, path, "parquet") for m in sorted(months, key=str)]


def read_version(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a version; months that lie in several builds come together."""
    return read_entries(spark, [e for e in manifest(spark, root, version) if e[0] == table], table)


def read_entries(spark: SparkSession, entries: list[tuple], table: str) -> DataFrame:
    """The rows of the given entries of one table."""
    if not entries:
        raise KeyError(f"no table {table!r} in this version")
    parts = []
    for path in sorted({e[2] for e in entries}):
        months = [e[1] for e in entries if e[2] == path]
        kind = next(e[3] for e in entries if e[2] == path)
        reader = spark.read.option("header", True) if kind == "csv" else spark.read
        if months == [None]:
            parts.append(reader.format(kind).load(path))
        else:
            parts.append(reader.option("basePath", path).format(kind).load([f"{path}/month={m}" for m in months])
                         .withColumn("month", F.col("month").cast("string")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
