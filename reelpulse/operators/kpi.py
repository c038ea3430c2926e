"""Executive, daily and monthly KPIs.

Global windows here run over already-aggregated rows (days, months, devices,
hours), whose count is bounded by the calendar or a fixed domain, not by data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .skew import heavy_keys_of, hot_key_join


def executive_kpis(watch: DataFrame, users: DataFrame, plans: DataFrame) -> DataFrame:
    """Q01: sessions, active users, hours, completion and the per-session revenue proxy.

    Sessions are reduced to one row per viewer before meeting users, so a viewer
    with a large share of sessions is combined map-side and never forms a skewed
    join partition; the per-session price sum is price x sessions per viewer.
    """
    per_user = X.session_partials(watch, "user_id")
    s = (per_user.join(users.select("user_id", "subscription_type"), "user_id")
         .join(F.broadcast(plans.select("subscription_type", "monthly_price_usd")), "subscription_type"))
    return s.agg(
        X.rolled_sessions().alias("watch_sessions"),
        F.count_distinct("user_id").alias("active_users"),
        X.rolled_hours().alias("watch_hours"),
        X.rolled_completion().alias("avg_completion"),
        (F.sum(F.col("monthly_price_usd") * F.col("_n")).cast("double") / 30.0).alias("revenue_proxy"),
    )


def daily_active_users(watch: DataFrame, approx: bool = False) -> DataFrame:
    """Q02: per day distinct viewers, sessions and hours (``approx=True``: HyperLogLog++ sketch)."""
    viewers = F.approx_count_distinct("user_id") if approx else F.count_distinct("user_id")
    return (watch.groupBy(F.to_date("watch_time").alias("watch_date"))
            .agg(viewers.alias("dau"),
                 F.count(F.lit(1)).alias("sessions"),
                 X.hours("watch_duration").alias("watch_hours")))


def monthly_hours(watch: DataFrame) -> DataFrame:
    return watch.groupBy(X.month_start("watch_time").alias("month")).agg(
        X.hours("watch_duration").alias("watch_hours"))


def monthly_growth(watch: DataFrame) -> DataFrame:
    """Q03: month-over-month growth of watch hours; NULL for the first month and after a zero."""
    w = Window.orderBy("month")
    prior = F.lag("watch_hours").over(w)
    return monthly_hours(watch).select(
        "month", "watch_hours", prior.alias("prior_month"),
        ((F.col("watch_hours") - prior) / F.nullif(prior, F.lit(0.0))).alias("growth_rate"))


def weekend_vs_weekday(watch: DataFrame) -> DataFrame:
    """Q10: Saturday/Sunday sessions against the rest of the week."""
    day_type = F.when(X.is_weekend("watch_time"), "Weekend").otherwise("Weekday")
    return watch.groupBy(day_type.alias("day_type")).agg(
        F.count(F.lit(1)).alias("sessions"),
        X.hours("watch_duration").alias("watch_hours"),
        X.mean("completion_rate").alias("completion"))


def device_share(watch: DataFrame) -> DataFrame:
    """Q14: sessions per device and their share of all sessions."""
    per = watch.groupBy("device_type").agg(
        F.count(F.lit(1)).alias("sessions"), X.mean("completion_rate").alias("avg_completion"))
    return per.select(
        "device_type", "sessions",
        (F.col("sessions").cast("double") / F.sum("sessions").over(Window.partitionBy())).alias("session_share"),
        "avg_completion")


def hour_of_day(watch: DataFrame) -> DataFrame:
    """Q24: sessions and hours by clock hour."""
    return watch.groupBy(F.hour("watch_time").cast("bigint").alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("sessions"), X.hours("watch_duration").alias("watch_hours"))


def rolling_dau(watch: DataFrame, rows: int = 7) -> DataFrame:
    """Q28: daily distinct viewers and their mean over the last ``rows`` day rows (not calendar days)."""
    d = watch.groupBy(F.to_date("watch_time").alias("day")).agg(F.count_distinct("user_id").alias("dau"))
    w = Window.orderBy("day").rowsBetween(-(rows - 1), 0)
    return d.select("day", "dau", F.avg("dau").over(w).alias("rolling_7d_dau"))


def calendar_features(watch: DataFrame) -> DataFrame:
    """Watch date, 'yyyy-MM' month, weekday name and weekend flag per session."""
    return watch.select(
        "session_id", "user_id", "content_id", "watch_time",
        F.to_date("watch_time").alias("watch_date"),
        X.month_label("watch_time").alias("month"),
        F.date_format("watch_time", "EEEE").alias("weekday"),
        X.is_weekend("watch_time").alias("is_weekend"))


def enriched_sessions(watch: DataFrame, users: DataFrame, content: DataFrame, plans: DataFrame,
                      heavy: dict[str, list[tuple]] | None = None) -> DataFrame:
    """P02+P03: sessions joined to viewer, title and plan (inner joins), with calendar
    columns and the session revenue (monthly price / 30).

    users and content grow with the data, so their join strategy is left to the
    optimizer and AQE (broadcast only when their measured size allows it); the
    plan table has four rows and is always broadcast.  Viewers and titles that own
    more sessions than a partition should hold are found by one aggregate and their
    sessions sliced over tasks (:mod:`.skew`), in any session.  ``heavy``: these keys, where they are known already.
    """
    heavy = heavy_keys_of(watch, ["user_id", "content_id"]) if heavy is None else heavy
    rows = hot_key_join(watch, users, "user_id", spread=["session_id"], heavy=heavy["user_id"])
    rows = hot_key_join(rows, content, "content_id", spread=["session_id"], heavy=heavy["content_id"])
    return (rows.join(F.broadcast(plans), "subscription_type")
            .withColumn("watch_date", F.to_date("watch_time"))
            .withColumn("month", X.month_label("watch_time"))
            .withColumn("weekday", F.date_format("watch_time", "EEEE"))
            .withColumn("is_weekend", X.is_weekend("watch_time"))
            .withColumn("revenue_usd", F.col("monthly_price_usd").cast("double") / 30.0))


def session_revenue(enriched: DataFrame) -> DataFrame:
    """P03 on its own: revenue per session."""
    return enriched.select("session_id", "subscription_type", "revenue_usd")


def monthly_kpis(enriched: DataFrame) -> DataFrame:
    """Monthly hours, sessions, active users, revenue and completion."""
    return enriched.groupBy("month").agg(
        X.hours("watch_duration").alias("watch_hours"),
        F.count("session_id").alias("sessions"),
        F.count_distinct("user_id").alias("active_users"),
        (X.exact_sum("monthly_price_usd") / 30.0).alias("revenue_usd"),
        X.mean("completion_rate").alias("avg_completion"))


def priced_viewers(users: DataFrame, plans: DataFrame) -> DataFrame:
    """(user_id, _k, _price): one row per viewer with a known plan, the rows and the prices that users x plans has."""
    return (users.select("user_id", "subscription_type")
            .join(F.broadcast(plans.select("subscription_type", "monthly_price_usd")), "subscription_type")
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("_k"), F.sum("monthly_price_usd").alias("_price")))


def monthly_kpis_direct(watch: DataFrame, users: DataFrame, content: DataFrame, plans: DataFrame) -> DataFrame:
    """P04 from the star schema: sessions of known titles are reduced to one row per
    (viewer, month) before the users and plans joins, then rolled up by month
    exactly as :func:`monthly_kpis` sums the mart rows (revenue = price x sessions).
    Viewers are one row each at the join, so its rows are distinct (viewer, month)
    pairs and distinct viewers a plain count, without further tables of pairs in a task."""
    per = (watch.join(content.select("content_id"), "content_id")
           .groupBy("user_id", X.month_label("watch_time").alias("month")).agg(
               F.count("session_id").alias("_n"), F.count(F.lit(1)).alias("_rows"),
               F.sum("watch_duration").alias("_min"), F.sum("completion_rate").alias("_comp"),
               F.count("completion_rate").alias("_comp_n")))
    j = per.join(priced_viewers(users, plans), "user_id")
    return j.groupBy("month").agg(
        (F.sum(F.col("_min") * F.col("_k")).cast("double") / 60.0).alias("watch_hours"),
        F.sum(F.col("_n") * F.col("_k")).alias("sessions"),
        F.count(F.lit(1)).alias("active_users"),
        (F.sum(F.col("_price") * F.col("_rows")).cast("double") / 30.0).alias("revenue_usd"),
        F.try_divide(F.sum(F.col("_comp") * F.col("_k")).cast("double"), F.sum(F.col("_comp_n") * F.col("_k")))
        .alias("avg_completion"))


def monthly_growth_mart(monthly: DataFrame) -> DataFrame:
    """Percentage change of monthly hours, 0 for the first month."""
    prior = F.lag("watch_hours").over(Window.orderBy("month"))
    return monthly.withColumn(
        "watch_growth_rate", F.coalesce(F.try_divide(F.col("watch_hours"), prior) - 1.0, F.lit(0.0)))
