"""Quantile edges of numeric columns from summaries that merge by adding counts.

Every value falls into a cell of a fixed grid: ``GRID`` equal steps per power of two, so cells are at most 1/GRID of
the value wide and do not depend on the data.  The counts per (column, cell) see every row, add up over partitions
in any order, and therefore give the same edges for every layout and cluster.  A column has at most ``GRID`` cells
per power of two between its smallest and largest magnitude, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grid cells per power of two.
GRID = 1024


def cell(value: Column, grid: int = GRID) -> Column:
    """The lower edge of a value's grid cell; a null, NaN or infinite value has none."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(value)))) / grid
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(value == 0, F.lit(0.0)).when(finite, F.floor(value / step) * step)


def quantile_summary(df: DataFrame, cols: Sequence[str], grid: int = GRID) -> DataFrame:
    """(name, cell, n): the rows of every column by grid cell."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), cell(F.col(c).cast("double"), grid).alias("cell"))
                                        for c in cols])))
    return long.filter("cell IS NOT NULL").groupBy("name", "cell").agg(F.count(F.lit(1)).alias("n"))


def merged(*summaries: DataFrame) -> DataFrame:
    """One summary of the rows of several."""
    total = summaries[0]
    for s in summaries[1:]:
        total = total.unionByName(s)
    return total.groupBy("name", "cell").agg(F.sum("n").alias("n"))


def edges_of(summary: DataFrame, bins: int) -> dict[str, list[float]]:
    """Up to ``bins - 1`` ascending edges per column: the cells in which the i/bins quantiles lie, and no edge at the
    smallest cell, below which nothing is.  The driver gets these edges only."""
    by = Window.partitionBy("name").orderBy("cell")
    upto = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))
    running = summary.select("name", "cell", upto.alias("upto"), "n", F.sum("n").over(Window.partitionBy("name")).alias("total"),
                             F.min("cell").over(Window.partitionBy("name")).alias("least"))
    # The cell holds the first row of a bin: some i with before < i * total / bins + 1 <= upto.
    first = F.floor((F.col("upto") - 1) * bins / F.col("total"))
    before = F.floor((F.col("upto") - F.col("n") - 1) * bins / F.col("total"))
    found = running.filter((F.col("cell") > F.col("least")) & (first > before)).select("name", "cell").collect()
    edges: dict[str, list[float]] = {}
    for r in sorted(found, key=lambda r: (r["name"], r["cell"])):
        edges.setdefault(r["name"], []).append(r["cell"])
    return edges


def binner(edges: dict[str, list[float]], cols: Sequence[str], suffix: str) -> PipelineModel:
    """The steps from values to bin numbers (column + ``suffix``): the count of edges not above the value.  A null or
    NaN has a bin of its own after the last.  Bins stay numbers: the bucketizer's mark of a category is taken off, as
    learners would otherwise lose their order."""
    inf = float("inf")
    # A column without edges has one bin; a bucketizer wants at least two, so a bound no value reaches is added.
    splits = [[-inf, *(edges.get(c) or [1.7e308]), inf] for c in cols]
    marked = Bucketizer(splitsArray=splits, inputCols=list(cols), outputCols=[f"{c}{suffix}_mark" for c in cols],
                        handleInvalid="keep")
    plain = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"coalesce(`{c}{suffix}_mark`, {len(s) - 1}) + 0.0D AS `{c}{suffix}`" for c, s in zip(cols, splits))
                           + " FROM __THIS__")
    return PipelineModel(stages=[marked, plain])
