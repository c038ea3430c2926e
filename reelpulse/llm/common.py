"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(df: DataFrame) -> DataFrame:
    """``df``, after the driver has collected its garbage.  Spark frees the shuffle files of tables that nothing
    refers to any more only then, and operators of many small steps leave many before the driver's heap is full."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to a new table in the shared folder and read back: smaller than a checkpoint for rows
    that repeat values, and likewise safe when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def content_key(text: Column) -> Column:
    """16-byte key of a text: equal texts, and only those, share it."""
    return F.unhex(F.md5(text.cast("binary")))


def rows_of(batches: Iterable[pa.RecordBatch], most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about ``most_bytes`` (a single larger row stays whole), so that
    what a worker holds at once does not depend on how many rows an engine puts into a batch."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def trimmed(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` of a mapInArrow, giving what a task has freed back to the system at its end: Python workers are
    reused, and idle ones would keep it beside the working ones."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # where the C library has it
            if trim is not None:
                trim(0)

    return whole


def map_text(df: DataFrame, text: str, work: Callable[[], Callable[[list], list[list]]], added: list[tuple]) -> DataFrame:
    """``df`` with columns computed from one text column.  ``work()`` runs once per task and returns a function
    from a list of texts (null as None) to one list per added column.  ``added``: (name, Spark type, Arrow
    type); columns of the same name are replaced.  Rows are neither dropped nor moved.

    A string column that stays is read where it is: a second copy of the texts would double what Spark and the
    workers buffer of them."""
    names = [n for n, *_ in added]
    kept = [c for c in df.columns if c not in names]
    own = kept.count(text) == 1 and df.schema[text].dataType == T.StringType()
    held = df.select(*(F.col(c) for c in kept), *([] if own else [F.col(text).cast("string").alias("_llm_text")]))
    at = kept.index(text) if own else len(kept)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in held.schema.fields[:len(kept)]),
                           *(T.StructField(n, T._parse_datatype_string(kind)) for n, kind, _ in added)])

    def run(batches):
        compute = work()
        for part in rows_of(batches):
            columns = compute(part.column(at).to_pylist())
            arrays = [part.column(i) for i in range(len(kept))]
            arrays += [pa.array(c, kind) for c, (_, _, kind) in zip(columns, added)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return held.mapInArrow(trimmed(run), schema)
