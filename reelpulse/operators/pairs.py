"""Co-watch pairs (Q34).

``COUNT(*)`` over ``watch a JOIN watch b ON a.user = b.user AND a.content < b.content``
counts *session pairs*.  The same number is ``SUM(n_a * n_b)`` over the distinct
(viewer, title) rows, so sessions are first reduced to one row per
(viewer, title) with a count ``n``; a viewer then contributes at most one row
per catalogue title.  ``distinct_viewers=True`` counts viewers instead (n = 1).

The join itself is on (viewer, slice): a viewer with ``k`` titles is split into
``ceil(k / titles_per_slice)`` slices on the left side and the right side is
replicated once per slice, so one heavy viewer's pair work is spread over many
tasks.  Each (a, b) pair of a viewer is produced in exactly one slice (the slice
of ``a``).  Pair rows are summed by a partial aggregate in the same stage as
the join, so only per-task (a, b) subtotals are shuffled.  ``min_pairs`` can
only be applied after the final sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S


_SPREAD = 8


def cowatch_pairs(watch: DataFrame, min_pairs: int = S.COWATCH_MIN_PAIRS, distinct_viewers: bool = False,
                  titles_per_slice: int = 1024) -> DataFrame:
    uc = watch.groupBy("user_id", "content_id").agg(F.count(F.lit(1)).alias("n"))
    if distinct_viewers:
        uc = uc.withColumn("n", F.lit(1).cast("bigint"))
    # Titles per viewer, counted by an aggregate and joined back, so a heavy viewer's titles never meet in one
    # task.  A second key spreads the join: the counts are repeated for each of its values.
    spread = F.pmod(F.xxhash64("content_id"), F.lit(_SPREAD)).cast("int")
    counts = (uc.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / titles_per_slice).alias("_slices"))
              .withColumn("_part", F.explode(F.array(*map(F.lit, range(_SPREAD))))))
    uc = uc.withColumn("_part", spread).join(counts, ["user_id", "_part"]).drop("_part")
    left = uc.select("user_id", F.col("content_id").alias("content_a"), F.col("n").alias("n_a"),
                     F.pmod(F.xxhash64("content_id"), F.col("_slices")).alias("_slice"))
    right = uc.select("user_id", F.col("content_id").alias("content_b"), F.col("n").alias("n_b"),
                      F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_slices") - 1)).alias("_slice"))
    pairs = left.join(right, ["user_id", "_slice"]).filter(F.col("content_a") < F.col("content_b"))
    return (pairs.groupBy("content_a", "content_b")
            .agg(F.sum(F.col("n_a") * F.col("n_b")).alias("shared_viewers"))
            .filter(F.col("shared_viewers") >= min_pairs))
