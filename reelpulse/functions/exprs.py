"""Reusable column expressions.

Measures are summed as DECIMAL and turned into DOUBLE once, then divided last,
so results do not depend on the order rows arrive in (partitioning, AQE
coalescing, retries): ``mean(x) = CAST(SUM(x) AS DOUBLE) / COUNT(x)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


# Profile numbers arrive as DOUBLE; summed with eight decimals, order does not matter and the source's two
# decimals are kept exactly.
PROFILE_DECIMAL = "decimal(28,8)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_sum(c) -> Column:
    """SUM of a DECIMAL column as DOUBLE (exact sum, one rounding)."""
    return F.sum(col(c)).cast("double")


def hours(minutes) -> Column:
    """Watch hours: SUM(minutes) / 60."""
    return exact_sum(minutes) / 60.0


def mean(c) -> Column:
    """AVG over non-null values, exact decimal sum divided once; NULL when none."""
    return F.try_divide(exact_sum(c), F.count(col(c)))


def mean_double(c) -> Column:
    """AVG of a DOUBLE profile column, exact like :func:`mean` for values of up to eight decimals."""
    return mean(col(c).cast(PROFILE_DECIMAL))


def share(cond: Column) -> Column:
    """AVG(CASE WHEN cond THEN 1 ELSE 0 END) over all rows in the group."""
    return F.try_divide(F.sum(F.when(cond, 1).otherwise(0)).cast("double"), F.count(F.lit(1)))


def month_start(ts) -> Column:
    """First day of the month as DATE."""
    return F.trunc(F.to_date(col(ts)), "month")


def month_label(ts) -> Column:
    """Month as 'yyyy-MM' text (the reference's period strings)."""
    return F.date_format(col(ts), "yyyy-MM")


def is_weekend(ts) -> Column:
    """Saturday or Sunday (weekday(): Monday=0 .. Sunday=6)."""
    return F.weekday(col(ts)) >= 5


def months_between_starts(later, earlier) -> Column:
    """Whole calendar months from ``earlier`` to ``later`` (month-boundary count)."""
    a, b = col(later), col(earlier)
    return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))).cast("bigint")


def duration_bucket(duration) -> Column:
    d = col(duration)
    expr = None
    for bound, label in S.DURATION_BUCKETS:
        expr = F.when(d < bound, label) if expr is None else expr.when(d < bound, label)
    return expr.otherwise(S.DURATION_TOP_LABEL)


def sentiment_label(rating) -> Column:
    r = col(rating)
    return (F.when(r >= S.POSITIVE_RATING, "Positive")
            .when(r <= S.NEGATIVE_RATING, "Negative")
            .otherwise("Neutral"))


def engagement_score(hours_col, people_col, completion_col, weights) -> Column:
    """Weighted engagement score; ``weights`` is one of the presets in ``schema``."""
    w_hours, w_people, w_completion, scale = weights
    return (col(hours_col) * w_hours + col(completion_col) * scale * w_completion
            + col(people_col) * w_people)


# ---------------------------------------------------------------------------
# Partial aggregates: reduce sessions to one row per fine key before a join,
# then roll the partials up.  Decimal partial sums add up exactly.
# ---------------------------------------------------------------------------

def session_partials(watch, *keys):
    """Sessions, minutes and completion sum/count per ``keys`` (combined map-side)."""
    return watch.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("watch_duration").alias("_min"),
        F.sum("completion_rate").alias("_comp"), F.count("completion_rate").alias("_comp_n"))


def rolled_sessions() -> Column:
    """COUNT(*) semantics: 0, not NULL, over no rows."""
    return F.coalesce(F.sum("_n"), F.lit(0).cast("bigint"))


def rolled_hours() -> Column:
    return F.sum("_min").cast("double") / 60.0


def rolled_completion() -> Column:
    return F.try_divide(F.sum("_comp").cast("double"), F.sum("_comp_n"))
