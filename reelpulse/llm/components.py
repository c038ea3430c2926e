"""Connected components of an edge table, by repeated joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, swept


def components(edges: DataFrame) -> DataFrame:
    """(key, label) for every key of the edges (a, b): label is the smallest key of its component.

    Each round takes the smallest label among a key and its neighbours, then the label of that label, so
    long chains shorten by half or more.  Both steps combine before they shuffle.  Ends when nothing changes.
    The joins are merge joins: both sides grow with the input, and hash tables built for broadcasts would pile
    up on the driver over the rounds.  Two steps go into each job, as the driver keeps a record of every job.
    """

    def step(labels: DataFrame) -> DataFrame:
        near = (both.join(labels.select(F.col("key").alias("b"), "label").hint("merge"), "b").groupBy("a")
                .agg(F.min("label").alias("near")).withColumnRenamed("a", "key"))
        lower = labels.join(near.hint("merge"), "key").select("key", "old", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        return lower.join(jump.hint("merge"), "label", "left").select(
            "key", "old", F.least("label", F.coalesce("further", "label")).alias("label"))

    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "key")
    while True:
        labels = swept(saved(step(step(labels.withColumn("old", F.col("label"))))))
        if labels.filter(F.col("label") != F.col("old")).isEmpty():
            return labels.select("key", "label")
        labels = labels.select("key", "label")
