"""Watch-time forecast (P17): least squares of monthly hours on t = 0..n-1.

Sums are taken over exact monthly minutes (DECIMAL) and the closed-form slope
and intercept are evaluated once on those sums, so the result does not depend
on row order.  Months are a calendar-bounded table; the future months come from
``sequence`` + ``explode`` on the one-row fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def monthly_minutes(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("month").agg(F.sum("watch_duration").alias("minutes"))


def monthly_minutes_direct(watch: DataFrame, users: DataFrame, content: DataFrame, plans: DataFrame) -> DataFrame:
    """Exact minutes per 'yyyy-MM' month of the sessions that reach the session mart,
    reduced to (viewer, month) partials before the users and plans joins."""
    per = (watch.join(content.select("content_id"), "content_id")
           .groupBy("user_id", F.date_format("watch_time", "yyyy-MM").alias("month"))
           .agg(F.sum("watch_duration").alias("_min")))
    j = (per.join(users.select("user_id", "subscription_type"), "user_id")
         .join(F.broadcast(plans.select("subscription_type")), "subscription_type"))
    return j.groupBy("month").agg(F.sum("_min").alias("minutes"))


def linear_fit(monthly: DataFrame) -> DataFrame:
    """One row: n, slope and intercept in minutes per month index, last month label."""
    t = (F.row_number().over(Window.orderBy("month")) - 1).cast("bigint")
    indexed = monthly.withColumn("t", t)
    sums = indexed.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("t").cast("double").alias("sx"),
        F.sum(F.col("t") * F.col("t")).cast("double").alias("sxx"),
        F.sum("minutes").cast("double").alias("sy"),
        F.sum(F.col("t") * F.col("minutes")).cast("double").alias("sxy"),
        F.max("month").alias("last_month"))
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"),
                         F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = sums.withColumn("slope", F.coalesce(slope, F.lit(0.0)))
    return fit.withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))


def watch_time_forecast(monthly: DataFrame, horizon: int = S.FORECAST_MONTHS) -> DataFrame:
    """Forecast hours for the ``horizon`` months after the last observed month."""
    fit = linear_fit(monthly)
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    future = fit.select("*", step)
    first_day = F.to_date(F.concat(F.col("last_month"), F.lit("-01")))
    return future.select(
        F.date_format(F.add_months(first_day, F.col("step")), "yyyy-MM").alias("month"),
        ((F.col("intercept") + F.col("slope") * (F.col("n") - 1.0 + F.col("step"))) / 60.0)
        .alias("forecast_watch_hours"))
