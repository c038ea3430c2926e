"""Distinct-viewer measures under any filter context, from one table of mergeable partials.

A distinct count cannot be added up, so each new grouping of M02 or M06-M09 would read the facts again.  Here viewers
get dense numbers, and the partial tables hold sets of them: 64 viewers a row, one bit each, per combination of the
context columns.  Sets merge by ``bit_or`` and are counted by ``bit_count``, so any grouping or filter of the context
columns is answered exactly from the same partials, with fixed-width hash aggregates only.  Words of 64 suit sparse
combinations (most hold a few viewers): a row is never larger than the session it comes from, where one fixed bitmap
of 32,768 bits a row would be.

The context is the star joined out: sessions with their viewer and title, where both are known; a session without
one has nulls there and ``known_viewer`` / ``known_title`` false.  Null viewer ids count in sums, not in sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exprs as X
from . import ordered
from .skew import heavy_keys_of, hot_key_join

#: Columns a filter context may use.
SESSION_CONTEXT = ("watch_date", "device_type", "genre", "language", "country", "subscription_type", "known_viewer",
                   "known_title")
USER_CONTEXT = ("country", "subscription_type", "age")


def viewer_numbers(ids: DataFrame) -> DataFrame:
    """(user_id, viewer): the distinct ids numbered densely from 0 in their order."""
    return ordered.with_position(ids.select("user_id").filter(F.col("user_id").isNotNull()).distinct(), ["user_id"], "viewer")


def _bit() -> Column:
    """The viewer's bit in its word."""
    return F.expr("shiftleft(1L, cast(viewer & 63 as int))")


def _count(mask: str) -> Column:
    return F.coalesce(F.sum(F.bit_count(mask)), F.lit(0))


def session_partials(watch: DataFrame, users: DataFrame, content: DataFrame) -> DataFrame:
    """One row per (``SESSION_CONTEXT``, word of viewers): the sets of viewers and of viewers with a session completed
    to the threshold, and the sums of the additive measures."""
    heavy = heavy_keys_of(watch, ["user_id", "content_id"])
    who = viewer_numbers(watch).join(users.select("user_id", "country", "subscription_type", F.lit(True).alias("known_viewer")),
                                     "user_id", "left")
    titles = content.select("content_id", "genre", "language", F.lit(True).alias("known_title"))
    facts = watch.select("session_id", "user_id", "content_id", "watch_time", "device_type", "completion_rate", "watch_duration")
    rows = hot_key_join(facts, who, "user_id", "left", spread=["session_id"], heavy=heavy["user_id"])
    rows = hot_key_join(rows, titles, "content_id", "left", spread=["session_id"], heavy=heavy["content_id"])
    rows = rows.withColumns({
        "watch_date": F.to_date("watch_time"), "word": F.shiftright("viewer", 6),
        "known_viewer": F.coalesce("known_viewer", F.lit(False)), "known_title": F.coalesce("known_title", F.lit(False))})
    weekend = F.when(X.is_weekend("watch_time"), F.col("watch_duration"))
    return rows.groupBy(*SESSION_CONTEXT, "word").agg(
        F.bit_or(_bit()).alias("viewers"),
        F.bit_or(F.when(F.col("completion_rate") >= S.RETENTION_COMPLETION, _bit())).alias("kept"),
        F.count(F.lit(1)).alias("n"), F.sum("watch_duration").alias("minutes"), F.sum(weekend).alias("weekend_minutes"),
        F.sum("completion_rate").alias("completion"), F.count("completion_rate").alias("completion_n"))


def session_measures(partials: DataFrame, by: Sequence[str], where: Column | None = None) -> DataFrame:
    """M01-M03 and M08-M10 per ``by`` (any of ``SESSION_CONTEXT``; none: one row), over the partials that ``where`` keeps."""
    held = partials if where is None else partials.filter(where)
    sums = ("n", "minutes", "weekend_minutes", "completion", "completion_n")
    words = held.groupBy(*by, "word").agg(F.bit_or("viewers").alias("viewers"), F.bit_or("kept").alias("kept"),
                                          *[F.sum(c).alias(c) for c in sums])
    total = words.groupBy(*by).agg(
        F.sum("n").alias("sessions"), _count("viewers").alias("active_users"), _count("kept").alias("_kept"),
        X.hours("minutes").alias("total_watch_hours"),
        F.try_divide(F.sum("completion").cast("double"), F.sum("completion_n")).alias("average_completion"),
        F.try_divide(F.sum("weekend_minutes").cast("double"), X.exact_sum("minutes")).alias("weekend_watch_share"))
    score = X.engagement_score("total_watch_hours", "active_users", "average_completion", S.ENGAGEMENT_QUERY_WEIGHTS)
    return total.select(*by, "sessions", "active_users", "total_watch_hours", "average_completion", "weekend_watch_share",
                        score.alias("engagement_score"),
                        F.try_divide(F.col("_kept").cast("double"), F.col("active_users")).alias("completion_retention_rate"))


def user_partials(users: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per (``USER_CONTEXT``, word of users): the sets of users and of Premium users, rows, churned rows, prices."""
    priced = users.join(F.broadcast(plans.select("subscription_type", "monthly_price_usd")), "subscription_type", "left")
    rows = hot_key_join(priced, viewer_numbers(users), "user_id", "left", spread=["country", "age"]).withColumn(
        "word", F.shiftright("viewer", 6))
    return rows.groupBy(*USER_CONTEXT, "word").agg(
        F.bit_or(_bit()).alias("members"), F.bit_or(F.when(F.col("subscription_type") == "Premium", _bit())).alias("premium"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("churn_status") == "Churned").alias("churned"),
        F.sum("monthly_price_usd").alias("price"))


def user_measures(partials: DataFrame, by: Sequence[str], where: Column | None = None) -> DataFrame:
    """M04-M07 per ``by`` (any of ``USER_CONTEXT``)."""
    held = partials if where is None else partials.filter(where)
    words = held.groupBy(*by, "word").agg(F.bit_or("members").alias("members"), F.bit_or("premium").alias("premium"),
                                          *[F.sum(c).alias(c) for c in ("n", "churned", "price")])
    total = words.groupBy(*by).agg(_count("members").alias("users"), _count("premium").alias("_premium"),
                                   F.sum("n").alias("_n"), F.sum("churned").alias("_churned"),
                                   X.exact_sum("price").alias("subscription_revenue"))
    return total.select(*by, "users", F.try_divide(F.col("_churned").cast("double"), F.col("_n")).alias("churn_rate"),
                        "subscription_revenue", F.try_divide("subscription_revenue", "users").alias("revenue_per_user"),
                        F.try_divide(F.col("_premium").cast("double"), F.col("users")).alias("premium_adoption"))
