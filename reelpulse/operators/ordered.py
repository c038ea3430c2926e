"""Exact order statistics without a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
Here the total order is split by a range partitioner instead:

1. ``repartitionByRange`` on the (unique) sort key, sorted within partitions;
2. each row's index inside its partition comes from
   ``monotonically_increasing_id`` (partition id in the upper bits, record
   number in the lower 33 bits), which is stable because the in-partition order
   is a total order;
3. a per-partition count table (one row per partition, so bounded by the
   partition count) gives exclusive prefix offsets through a window over those
   few rows, and is broadcast back.

The indexed partitions are materialized once with a reliable ``checkpoint()``
(into the session's checkpoint folder) and both the count table and the rows
read that copy.  Without it the input would be computed twice, and a shuffle
output's row order - hence the range partitioner's sample and bounds - can
differ between the two runs (or after an executor loss), breaking positions.

Position = partition offset + index; NTILE is a formula over positions.
PERCENTILE_CONT and mean tie ranks work on per-value counts and their prefix
sums, so ties collapse before anything is ordered.  Work per task is one range partition; no task
sees more than its share of rows, whatever the skew of the sort values (ties
are split by the unique tail of the key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def _range(df: DataFrame, order, num_partitions: int | None) -> DataFrame:
    """Range-partition on ``order``.  Without an explicit count, AQE may coalesce
    adjacent ranges into fewer partitions; each one is still a contiguous slice
    of the order, which is all the position arithmetic needs."""
    if num_partitions:
        return df.repartitionByRange(num_partitions, *order)
    return df.repartitionByRange(*order)


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "pos",
                  total: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``.

    ``order`` must be unique per row (append the row key to break ties).  When
    ``total`` is given, the row count of ``df`` is added under that name.
    """
    ranged = (_range(df, order, num_partitions)
              .sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))
    checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_total"),
    )
    out = ranged.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_idx"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_pid", "_idx", "_off", "_total")


def ntile(df: DataFrame, order: Sequence[Column | str], tiles: int, name: str,
          num_partitions: int | None = None) -> DataFrame:
    """SQL ``NTILE(tiles) OVER (ORDER BY order)``: the first ``n mod tiles`` buckets get one extra row."""
    pos = with_position(df, order, "_pos", "_n", num_partitions)
    q = F.floor(F.col("_n") / tiles)
    r = F.col("_n") % tiles
    big = r * (q + 1)                         # rows held by the larger buckets
    bucket = (F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (q + 1)))
              .otherwise(r + F.floor((F.col("_pos") - big) / F.greatest(q, F.lit(1)))) + 1)
    return pos.withColumn(name, bucket.cast("bigint")).drop("_pos", "_n")


def _ranged_sums(df: DataFrame, order, weight: str, num_partitions: int | None):
    """Range-partitioned, checkpointed copy with ``_pid``, and the per-partition table
    (``_pid``, ``_off`` = weight before the partition, ``_psum``, ``_total``)."""
    ranged = _range(df, order, num_partitions).withColumn("_pid", F.spark_partition_id())
    checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    sums = ranged.groupBy("_pid").agg(F.sum(weight).alias("_psum"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_pid", F.coalesce(F.sum("_psum").over(before), F.lit(0)).alias("_off"), "_psum",
                          F.sum("_psum").over(Window.partitionBy()).alias("_total"))
    return ranged, offsets


def _with_running(rows: DataFrame, order, weight: str, name: str) -> DataFrame:
    """``name`` = weight strictly before each row: partition offset + running sum inside the
    range partition (a window per partition; each holds one slice of the order)."""
    within = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.col("_off") + F.coalesce(F.sum(weight).over(within), F.lit(0)))


def percentile_cont(df: DataFrame, value: str, q: float, key: Sequence[str] = (),
                    num_partitions: int | None = None) -> DataFrame:
    """Exact ``PERCENTILE_CONT(q) WITHIN GROUP (ORDER BY value)`` as a one-row DataFrame.

    Rows are first grouped by value (a count per distinct value, combined
    map-side), so ties - however many - are one row.  The distinct values are
    range-partitioned; per-partition count sums locate the (at most two)
    partitions holding ranks floor(q(n-1)) and ceil(q(n-1)), and only those are
    scanned for a running count.  The two values are interpolated.  ``key`` is
    accepted for signature compatibility; ties need no breaking here.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_cnt"))
    ranged, offsets = _ranged_sums(counts, [value], "_cnt", num_partitions)
    rank = (F.col("_total").cast("double") - 1.0) * q
    lo, hi = F.floor(rank), F.ceil(rank)

    def within(r, start, size):
        return (F.col(start) <= r) & (r < F.col(start) + F.col(size))

    # At most two partitions hold the target ranks: a bounded broadcast side.
    targets = offsets.filter(within(lo, "_off", "_psum") | within(hi, "_off", "_psum"))
    rows = _with_running(ranged.join(F.broadcast(targets), "_pid"), [value], "_cnt", "_before")
    picked = rows.filter(within(lo, "_before", "_cnt") | within(hi, "_before", "_cnt")).select(
        F.col(value).cast("double").alias("_v"), within(lo, "_before", "_cnt").alias("_is_lo"),
        within(hi, "_before", "_cnt").alias("_is_hi"), (rank - lo).alias("_frac"))
    v_lo = F.max(F.when(F.col("_is_lo"), F.col("_v")))
    v_hi = F.max(F.when(F.col("_is_hi"), F.col("_v")))
    return picked.agg((v_lo + (v_hi - v_lo) * F.max("_frac")).alias("percentile"))


def exclusive_prefix_sum(df: DataFrame, order: Sequence[Column | str], weight: str, name: str,
                         num_partitions: int | None = None) -> DataFrame:
    """Add the sum of ``weight`` over all rows strictly before each row in ``order`` (unique)."""
    ranged, offsets = _ranged_sums(df, order, weight, num_partitions)
    out = _with_running(ranged.join(F.broadcast(offsets.select("_pid", "_off")), "_pid"), order, weight, name)
    return out.drop("_pid", "_off")


def tiles_by_value(df: DataFrame, value: str, key: Sequence[str], tiles: int, name: str,
                   num_partitions: int | None = None) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY value NULLS LAST, key)`` that orders only the rows of the boundary values.

    Counts per distinct value and their prefix sums tell in which value each tile starts; these at most ``tiles - 1``
    (value, offset) pairs go to the driver.  A row of any other value gets its tile by comparing values; only rows of
    a value in whose midst a tile starts are ordered by ``key`` (unique within a value).  ``df`` is read three times:
    pass a checkpointed one.
    """
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_cnt"))
    placed = exclusive_prefix_sum(counts, [F.col(value).asc_nulls_last()], "_cnt", "_before", num_partitions)
    n = df.count()
    starts = [t * (n // tiles) + min(t, n % tiles) for t in range(1, tiles)]
    starts = [p for p in starts if p < n]
    held = F.lit(False)
    for p in set(starts):
        held = held | ((F.col("_before") <= p) & (F.lit(p) < F.col("_before") + F.col("_cnt")))
    found = sorted(placed.filter(held).select(value, "_before", "_cnt").collect(), key=lambda r: r["_before"])
    kind = df.schema[value].dataType

    def same(v) -> Column:
        return F.col(value).eqNullSafe(F.lit(v).cast(kind))

    def above(v) -> Column:                       # nulls last: above every value, nothing above them
        return F.lit(False) if v is None else F.coalesce(F.col(value) > F.lit(v).cast(kind), F.lit(True))

    def tile(index: Column) -> Column:
        at = F.lit(1)
        for p in starts:
            r = next(r for r in found if r["_before"] <= p < r["_before"] + r["_cnt"])
            here = F.lit(True) if p == r["_before"] else index >= p - r["_before"]
            at = at + (above(r[value]) | (same(r[value]) & here)).cast("bigint")
        return at.cast("bigint")

    cut = [r for r in found if any(r["_before"] < p < r["_before"] + r["_cnt"] for p in starts)]
    inside = F.lit(False)
    first, passed = F.lit(0), 0                   # rows of the cut values before each of them
    for r in cut:
        inside = inside | same(r[value])
        first = F.when(same(r[value]), F.lit(passed)).otherwise(first)
        passed += r["_cnt"]
    plain = df.filter(~inside).withColumn(name, tile(F.lit(0)))
    if not cut:
        return plain
    ranged = with_position(df.filter(inside), [F.col(value).asc_nulls_last(), *key], "_pos", num_partitions=num_partitions)
    return plain.unionByName(ranged.withColumn(name, tile(F.col("_pos") - first)).drop("_pos"))
