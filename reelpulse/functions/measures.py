"""Semantic-layer measures (M01-M10) as aggregate Column builders.

Each works under any grouping: the BI filter context becomes the ``groupBy``
keys and filters.  ``DIVIDE`` (blank on a zero denominator) is ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import exprs as X


def total_watch_hours() -> Column:                       # M01
    return X.hours("watch_duration")


def active_users() -> Column:                            # M02
    return F.count_distinct("user_id")


def average_completion() -> Column:                      # M03
    return X.mean("completion_rate")


def churn_rate() -> Column:                              # M04
    return F.try_divide(F.count_if(F.col("churn_status") == "Churned").cast("double"),
                        F.count(F.lit(1)))


def subscription_revenue() -> Column:                    # M05 (over users joined to plans)
    return X.exact_sum("monthly_price_usd")


def revenue_per_user() -> Column:                        # M06
    return F.try_divide(subscription_revenue(), F.count_distinct("user_id"))


def premium_adoption() -> Column:                        # M07 (over one row per user and group)
    known = F.col("user_id").isNotNull()
    return F.try_divide(F.count_if(known & F.col("premium")).cast("double"), F.count_if(known))


def one_row_per_user(users: DataFrame, *group: str) -> DataFrame:
    """Users of a group once each, with whether any of their rows is on the Premium plan."""
    premium = F.coalesce(F.col("subscription_type") == "Premium", F.lit(False))
    return users.groupBy(*group, "user_id").agg(F.max(premium).alias("premium"))


def engagement_score() -> Column:                        # M08
    return X.engagement_score(total_watch_hours(), active_users(), average_completion(),
                              S.ENGAGEMENT_QUERY_WEIGHTS)


def completion_retention_rate() -> Column:               # M09
    kept = F.count_distinct(F.when(F.col("completion_rate") >= S.RETENTION_COMPLETION, F.col("user_id")))
    return F.try_divide(kept.cast("double"), F.count_distinct("user_id"))


def weekend_watch_share() -> Column:                     # M10 (of minutes)
    weekend = F.sum(F.when(X.is_weekend("watch_time"), F.col("watch_duration"))).cast("double")
    return F.try_divide(weekend, X.exact_sum("watch_duration"))


def users_with_plans(users: DataFrame, plans: DataFrame) -> DataFrame:
    """RELATED(plan price) for every user: left join to the fixed-size plan table."""
    return users.join(F.broadcast(plans.select("subscription_type", "monthly_price_usd")),
                      "subscription_type", "left")
