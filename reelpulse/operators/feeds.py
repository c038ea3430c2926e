"""Dashboard data feeds (F01, F05-F09, F12): the numbers behind the charts, not the drawing.

The interactive feeds take a multi-value filter on country, genre and plan
(F07).  The default lists are data-driven (first 6 countries, first 8 genres,
all plans, in sorted order) and are applied as semi joins against those small
lists, never collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import checkpoint_dir
from .kpi import enriched_sessions
from .skew import heavy_keys_of, hot_key_join

DEFAULT_COUNTRIES = 6
DEFAULT_GENRES = 8


def headline_kpis(watch: DataFrame, users: DataFrame, content: DataFrame, plans: DataFrame) -> DataFrame:
    """revenue, hours, sessions, churn, completion and premium share as (metric, value) rows.

    Each group of numbers is a one-row aggregate over its own table; the rows are
    stacked, not cross-joined.  Revenue and hours are those of sessions with a known
    title, viewer and plan, from one row per (viewer, title), then per viewer.
    """
    per = (watch.groupBy("user_id", "content_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("watch_duration").alias("_min"))
           .join(content.select("content_id"), "content_id")
           .groupBy("user_id").agg(F.sum("_n").alias("_n"), F.sum("_min").alias("_min")))
    priced = (per.join(users.select("user_id", "subscription_type"), "user_id")
              .join(F.broadcast(plans.select("subscription_type", "monthly_price_usd")), "subscription_type"))
    mart = priced.agg((F.sum(F.col("monthly_price_usd") * F.col("_n")).cast("double") / 30.0).alias("revenue"),
                      X.rolled_hours().alias("watch_hours"))
    sess = watch.agg(F.count(F.lit(1)).cast("double").alias("sessions"),
                     X.mean("completion_rate").alias("completion"))
    people = users.agg(X.share(F.col("churn_status") == "Churned").alias("churn"),
                       X.share(F.col("subscription_type") == "Premium").alias("premium"))

    def long(df):
        return df.unpivot([], df.columns, "metric", "value")

    return long(mart).unionByName(long(sess)).unionByName(long(people))


def share_of_max(df: DataFrame, label: str, value: str, order: str, n: int = 8) -> DataFrame:
    """the first ``n`` rows by ``order`` desc and each value's share of their maximum."""
    top = df.orderBy(F.col(order).desc_nulls_last(), F.col(label).asc_nulls_last()).limit(n)
    return top.select(label, value, F.try_divide(F.col(value), F.max(value).over(Window.partitionBy()))
                      .alias("share_of_max"))


def minmax_trend(monthly: DataFrame, value: str = "watch_hours") -> DataFrame:
    """min-max normalised monthly series (months are calendar-bounded)."""
    whole = Window.partitionBy()
    lo, hi = F.min(value).over(whole), F.max(value).over(whole)
    return monthly.select("month", value, F.try_divide(F.col(value) - lo, hi - lo).alias("normalised"))


def filtered_sessions(watch: DataFrame, users: DataFrame, content: DataFrame, plans: DataFrame,
                      countries: Sequence[str] | None = None, genres: Sequence[str] | None = None,
                      subscription_types: Sequence[str] | None = None) -> DataFrame:
    """enriched sessions whose country, genre and plan are all selected.

    Explicit lists become ``isin`` filters on users and content, ahead of the session
    joins.  Omitted country and genre lists default to the first values, in sorted
    order, that occur in the session mart: the distinct (country, genre) pairs of the
    sessions' ids, a table bounded by the two domains, which is checkpointed so
    that both lists read it.  Nearly all (viewer, title) ids differ, so they are not made
    distinct first, which would shuffle them once more; heavy ones are found once, for
    these joins and those of the mart.  The lists (at most 6 and 8 rows) filter the dimensions
    before they meet the sessions.  With explicit lists the sessions are read once.
    """
    heavy = None
    if subscription_types is not None:
        users = users.filter(F.col("subscription_type").isin(list(subscription_types)))
    if countries is None or genres is None:
        known = users.join(F.broadcast(plans.select("subscription_type")), "subscription_type", "left_semi")
        checkpoint_dir(watch.sparkSession)
        heavy = heavy_keys_of(watch, ["user_id", "content_id"])
        ids = hot_key_join(watch.select("user_id", "content_id"), known.select("user_id", "country"), "user_id",
                           spread=["content_id"], heavy=heavy["user_id"])
        pairs = (hot_key_join(ids, content.select("content_id", "genre"), "content_id", spread=["user_id"],
                              heavy=heavy["content_id"])
                 .select("country", "genre").distinct().checkpoint(eager=True))

    def chosen(df: DataFrame, column: str, given: Sequence[str] | None, most: int) -> DataFrame:
        if given is not None:
            return df.filter(F.col(column).isin(list(given)))
        first = (pairs.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(most))
        return df.join(F.broadcast(first), column, "left_semi")

    return enriched_sessions(watch, chosen(users, "country", countries, DEFAULT_COUNTRIES),
                             chosen(content, "genre", genres, DEFAULT_GENRES), plans, heavy)


def filtered_kpis(filtered: DataFrame) -> DataFrame:
    """KPI cards over the filtered sessions."""
    return filtered.agg(
        F.count(F.lit(1)).alias("sessions"),
        X.hours("watch_duration").alias("watch_hours"),
        X.mean("completion_rate").alias("avg_completion"),
        (X.exact_sum("monthly_price_usd") / 30.0).alias("revenue_proxy"))


def revenue_mix(filtered: DataFrame) -> DataFrame:
    """session revenue per plan and its share of the total."""
    per = filtered.groupBy("subscription_type").agg(F.sum("monthly_price_usd").alias("_price"))
    return per.select(
        "subscription_type", (F.col("_price").cast("double") / 30.0).alias("revenue"),
        F.try_divide(F.col("_price").cast("double"),
                     F.sum("_price").over(Window.partitionBy()).cast("double")).alias("revenue_share"))


def revenue_by_plan_country(filtered: DataFrame) -> DataFrame:
    """session revenue and distinct viewers per plan and country."""
    return filtered.groupBy("subscription_type", "country").agg(
        (X.exact_sum("monthly_price_usd") / 30.0).alias("revenue"),
        F.count_distinct("user_id").alias("users"))
