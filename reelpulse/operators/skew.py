"""Equality joins whose hot keys are cut into slices, whatever the session's adaptive settings are.

A key that owns a large share of the left rows sends them all to one task of a shuffled join.  Here one aggregate
finds the keys that fill a whole mean partition or more (at most as many keys as there are partitions, and
``MOST_HEAVY`` at most), the left rows of such a key are dealt over slices by a hash of their own columns, and only
the right rows of such keys are copied to every slice.  All other keys join as they would have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slices that a key filling one mean partition gets.
SLICES = 4
#: Most keys that are treated as heavy; the table of them is broadcast.
MOST_HEAVY = 1024
#: Values that a summary of frequent values keeps for each partition.
ROOM = 8


def _fullest(counts: DataFrame, partitions: int) -> tuple[int, list]:
    """(rows, the counts of at least rows / partitions): the counts are kept while both are asked, so that what they
    come from is read once, and computed again if an executor that keeps some is lost."""
    held = counts.persist()
    try:
        total = held.agg(F.sum("n")).first()[0] or 0
        top = held.filter(F.col("n") * partitions >= total).orderBy(F.desc("n")).limit(partitions).collect()
    finally:
        held.unpersist()
    return total, top if total else []


def heavy_keys(left: DataFrame, keys: Sequence[str], counts: DataFrame | None = None,
               partitions: int | None = None) -> list[tuple]:
    """``(*key, slices)`` of every key with at least 1/partitions of the rows.  ``counts`` (keys, ``n``) spares the
    aggregate where the caller already has one.  Null keys never join and are left out of the list."""
    spark = left.sparkSession
    partitions = min(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_HEAVY)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*keys, "n")
    if partitions < 2:
        return []
    total, top = _fullest(counts, partitions)
    return [(*r[:-1], -(-SLICES * r[-1] * partitions // total)) for r in top if None not in r[:-1]]


def heavy_keys_of(left: DataFrame, keys: Sequence[str], partitions: int | None = None) -> dict[str, list[tuple]]:
    """:func:`heavy_keys` of several single-column keys, from one pass over ``left`` that shuffles no counts.

    Every task keeps a summary of frequent values per key, of ``ROOM`` values for each of the partitions; only these
    are sent and merged.  A summary's count is never too small and too large by at most a third of a mean partition, so
    no key that fills one is missed; which keys are sliced never changes a result."""
    spark = left.sparkSession
    partitions = min(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_HEAVY)
    if partitions < 2:
        return {k: [] for k in keys}
    tops = [F.expr(f"approx_top_k(CAST(`{k}` AS STRING), {partitions}, {ROOM * partitions})").alias(f"_top_{i}")
            for i, k in enumerate(keys)]
    found = left.agg(F.count(F.lit(1)).alias("_rows"), *tops).first()
    total = found["_rows"]
    return {k: [(r["item"], -(-SLICES * r["count"] * partitions // total)) for r in found[f"_top_{i}"] or []
                if r["item"] is not None and r["count"] * partitions >= total] for i, k in enumerate(keys)}


def _relation(left: DataFrame, keys: Sequence[str], heavy: list[tuple]) -> DataFrame:
    """The heavy keys as a literal relation of the JVM."""
    rows = F.array(*[F.struct(*[F.lit(v).cast(left.schema[k].dataType).alias(f"_hot_{i}")
                                for i, (k, v) in enumerate(zip(keys, row))], F.lit(row[-1]).cast("int").alias("_hot_n"))
                     for row in heavy])
    return left.sparkSession.range(1).select(F.inline(rows))


def hot_key_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner",
                 spread: Sequence[str] | None = None, counts: DataFrame | None = None,
                 partitions: int | None = None, heavy: list[tuple] | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` (inner, left, left_semi or left_anti) with hot keys of the left side sliced.

    ``spread``: left columns whose hash deals the rows of a key over its slices (default: all other columns); rows
    that agree in all of them stay together.  Rows with a null key cannot match and are dealt likewise, so that a
    left or anti join does not gather them in one task.  ``heavy``: the heavy keys, where they are known already.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    heavy = heavy_keys(left, keys, counts, partitions) if heavy is None else heavy
    absent = F.lit(False)
    for k in keys:
        absent = absent | F.col(k).isNull()
    by = [F.col(c) for c in (spread or [c for c in left.columns if c not in keys] or keys)]

    def slot(n: Column) -> Column:
        return F.pmod(F.xxhash64(*by), n).cast("int")

    n_null = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not heavy:
        if how not in ("left", "left_anti"):
            return left.join(right, keys, how)
        salted = left.withColumn("_slot", F.when(absent, slot(F.lit(n_null))).otherwise(F.lit(0)))
        return salted.join(right.withColumn("_slot", F.lit(0)), [*keys, "_slot"], how).drop("_slot")
    hot = F.broadcast(_relation(left, keys, heavy))

    def marked(side: DataFrame) -> DataFrame:
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & (side[k] == F.col(f"_hot_{i}"))
        return side.join(hot, cond, "left").drop(*[f"_hot_{i}" for i in range(len(keys))])

    slot_of = F.when(F.col("_hot_n").isNotNull(), slot(F.col("_hot_n"))).when(absent, slot(F.lit(n_null)))
    dealt = marked(left).withColumn("_slot", F.coalesce(slot_of, F.lit(0))).drop("_hot_n")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_hot_n"), F.lit(1)) - 1)
    copied = marked(right).withColumn("_slot", F.explode(copies)).drop("_hot_n")
    return dealt.join(copied, [*keys, "_slot"], how).drop("_slot")
