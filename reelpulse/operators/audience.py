"""Viewer, cohort and churn analytics (Q07-Q09, Q11-Q13, Q15, Q18, Q19, Q25, Q27,
Q29, Q33, Q35, P07, P18, F03, F12, F13).

Per-viewer work is expressed as aggregations (which combine map-side) rather than
windows partitioned by viewer, so a viewer holding a large share of all sessions
is pre-aggregated in every task instead of sorted in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exprs as X
from ..session import checkpoint_dir
from . import ordered


def churn_by_plan(users: DataFrame) -> DataFrame:
    """Q07: churn rate and users per plan."""
    return users.groupBy("subscription_type").agg(
        X.share(F.col("churn_status") == "Churned").alias("churn_rate"),
        F.count(F.lit(1)).alias("users"))


def retention_cohorts(watch: DataFrame, users: DataFrame) -> DataFrame:
    """Q08: viewers retained per signup-month cohort and month index.

    The index counts month boundaries from signup to activity and may be negative
    (activity before signup).  Activity is reduced to distinct (viewer, month)
    pairs and cohorts to distinct (viewer, cohort) pairs, so the joined rows are
    distinct and distinct viewers per (cohort, index) is a plain count.
    """
    activity = watch.select("user_id", X.month_start("watch_time").alias("activity_month")).distinct()
    cohorts = users.select("user_id", F.trunc("signup_date", "month").alias("cohort_month")).distinct()
    return (cohorts.join(activity, "user_id")
            .withColumn("cohort_index", X.months_between_starts("activity_month", "cohort_month"))
            .groupBy("cohort_month", "cohort_index")
            .agg(F.count(F.lit(1)).alias("retained_users")))


def binge_by_device(watch: DataFrame, min_sessions: int = S.BINGE_MIN_SESSIONS,
                    min_minutes: int = S.BINGE_MIN_MINUTES) -> DataFrame:
    """Q09: share of viewer-device-days that are binge days, and mean daily minutes."""
    daily = watch.groupBy("user_id", "device_type", F.to_date("watch_time").alias("watch_date")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("watch_duration").alias("minutes"))
    binge = (F.col("sessions") >= min_sessions) | (F.col("minutes") >= min_minutes)
    return daily.groupBy("device_type").agg(
        X.share(binge).alias("binge_day_rate"), X.mean("minutes").alias("avg_daily_minutes"))


def country_engagement(watch: DataFrame, users: DataFrame) -> DataFrame:
    """Q11: viewers, sessions, hours and completion per country (per-viewer partials
    first, so a heavy viewer is one row at the join)."""
    per_user = X.session_partials(watch, "user_id")
    return per_user.join(users.select("user_id", "country"), "user_id").groupBy("country").agg(
        F.count_distinct("user_id").alias("viewers"),
        X.rolled_sessions().alias("sessions"),
        X.rolled_hours().alias("watch_hours"),
        X.rolled_completion().alias("avg_completion"))


def premium_adoption_by_signup(users: DataFrame) -> DataFrame:
    """Q12: share of Premium subscribers per signup month."""
    return users.groupBy(F.trunc("signup_date", "month").alias("signup_month")).agg(
        X.share(F.col("subscription_type") == "Premium").alias("premium_adoption"))


def revenue_per_user_by_country(users: DataFrame, plans: DataFrame) -> DataFrame:
    """Q13: summed monthly plan price, users and revenue per user by country."""
    j = users.join(F.broadcast(plans.select("subscription_type", "monthly_price_usd")), "subscription_type")
    return j.groupBy("country").agg(
        X.exact_sum("monthly_price_usd").alias("monthly_arr"),
        F.count(F.lit(1)).alias("users"),
        X.mean("monthly_price_usd").alias("revenue_per_user"))


def top_genres_per_country(watch: DataFrame, users: DataFrame, content: DataFrame, k: int = 3) -> DataFrame:
    """Q15: the ``k`` genres with most minutes per country (ties by genre name).

    Minutes are summed per (viewer, title) before the dimension joins.  The
    window runs over (country, genre) aggregates; Catalyst adds a
    WindowGroupLimit so only ``k`` rows per country leave each task.
    """
    x = (watch.groupBy("user_id", "content_id").agg(F.sum("watch_duration").alias("_m"))
         .join(users.select("user_id", "country"), "user_id")
         .join(content.select("content_id", "genre"), "content_id")
         .groupBy("country", "genre").agg(F.sum("_m").alias("_minutes")))
    w = Window.partitionBy("country").orderBy(F.col("_minutes").desc_nulls_last(), F.col("genre").asc_nulls_last())
    return (x.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
            .select("country", "genre", F.col("_minutes").cast("double").alias("minutes"),
                    F.col("rn").cast("bigint").alias("rn")))


def user_engagement(watch: DataFrame) -> DataFrame:
    return watch.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        X.hours("watch_duration").alias("watch_hours"),
        X.mean("completion_rate").alias("completion"))


def upgrade_candidates(watch: DataFrame, users: DataFrame, plans=S.UPGRADE_PLANS,
                       pct: float = S.UPGRADE_PERCENTILE, approx: bool = False) -> DataFrame:
    """Q18: Basic/Standard viewers strictly above the exact ``pct`` percentile of hours
    among all viewers.  The percentile is exact (per-value counts and their
    range-partitioned prefix sums, ``ordered.percentile_cont``), used as a scalar
    subquery; ``approx=True`` uses a one-pass
    ``percentile_approx`` sketch instead (opt-in, not the reference's result)."""
    # Checkpointed once: the percentile and the filter read the same per-viewer rows.
    checkpoint_dir(watch.sparkSession)
    e = user_engagement(watch).checkpoint(eager=True)
    cut = (e.agg(F.percentile_approx("watch_hours", pct, 10000)) if approx
           else ordered.percentile_cont(e, "watch_hours", pct, key=["user_id"]))
    return (e.filter(F.col("watch_hours") > cut.scalar())
            .join(users.filter(F.col("subscription_type").isin(*plans))
                  .select("user_id", "country", "subscription_type"), "user_id")
            .select("user_id", "country", "subscription_type", "watch_hours", "sessions"))


def engagement_drop(watch: DataFrame, factor=S.ENGAGEMENT_DROP_FACTOR) -> DataFrame:
    """Q19: viewer months whose minutes fell below ``factor`` x the previous observed month.

    The window is per viewer over monthly aggregates, so a partition holds at most
    one row per calendar month of that viewer.
    """
    m = watch.groupBy("user_id", X.month_start("watch_time").alias("month")).agg(
        F.sum("watch_duration").alias("_minutes"))
    prior = F.lag("_minutes").over(Window.partitionBy("user_id").orderBy("month"))
    seq = m.withColumn("_prior", prior)
    return (seq.filter(F.col("_prior").isNotNull()
                       & (F.col("_minutes") < F.col("_prior") * F.lit(factor)))
            .select("user_id", "month", F.col("_minutes").cast("double").alias("minutes"),
                    F.col("_prior").cast("double").alias("prior_minutes")))


def frequency_quintiles(watch: DataFrame, tiles: int = 5) -> DataFrame:
    """Q25: per-viewer sessions/hours/completion with NTILE(5) over sessions and over hours
    (ties broken by viewer id).  Tiles come from counts per value; only viewers of the values in
    which a tile starts are ordered (:func:`ordered.tiles_by_value`).  The per-viewer rows are
    checkpointed once, as both tiles read them several times."""
    f = watch.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        X.hours("watch_duration").alias("hours"),
        X.mean("completion_rate").alias("completion"))
    checkpoint_dir(watch.sparkSession)
    f = ordered.tiles_by_value(f.checkpoint(eager=True), "sessions", ["user_id"], tiles, "frequency_quintile")
    return ordered.tiles_by_value(f, "hours", ["user_id"], tiles, "watch_time_quintile")


def last_genre_before_churn(watch: DataFrame, users: DataFrame, content: DataFrame) -> DataFrame:
    """Q27: genre of each churned viewer's latest session, counted per genre.

    Latest = max (watch_time, session_id).  Spark plans a struct maximum with strings
    as a sort aggregate: tasks sort the sessions they hold by viewer, before and after
    the shuffle, and combine map-side.  Only sessions of churned viewers are sorted.
    """
    churned = users.filter(F.col("churn_status") == "Churned").select("user_id")
    last = (watch.join(churned, "user_id", "left_semi").groupBy("user_id")
            .agg(F.max(F.struct("watch_time", "session_id", "content_id")).alias("_last"))
            .select(F.col("_last.content_id").alias("content_id")))
    return last.join(content.select("content_id", "genre"), "content_id").groupBy("genre").agg(
        F.count(F.lit(1)).alias("churned_last_sessions"))


def plan_migration(users: DataFrame) -> DataFrame:
    """Q29: users and mean profile watch hours per country and plan."""
    return users.groupBy("country", "subscription_type").agg(
        F.count(F.lit(1)).alias("users"), X.mean_double("watch_hours").alias("avg_profile_watch_hours"))


def country_language_affinity(watch: DataFrame, users: DataFrame, content: DataFrame) -> DataFrame:
    """Q33: sessions and hours per viewer country and title language (per (viewer, title)
    partials before the dimension joins)."""
    return (X.session_partials(watch, "user_id", "content_id")
            .join(users.select("user_id", "country"), "user_id")
            .join(content.select("content_id", "language"), "content_id")
            .groupBy("country", "language").agg(
                X.rolled_sessions().alias("sessions"), X.rolled_hours().alias("watch_hours")))


def churn_features(watch: DataFrame, users: DataFrame, content: DataFrame) -> DataFrame:
    """Q35: one row per user (with or without sessions) of churn model features.

    Sessions are reduced to per-user partials first (counts and exact sums, so a
    heavy viewer is one row at the join), left-joined to users, and rolled up by
    the five profile columns as the SQL groups them.  A user without sessions
    gets 0 sessions, NULL minutes and completion, 0 genres, and mobile share 0
    (its one null-extended row counts as a non-mobile row).
    """
    keys = ["user_id", "age", "country", "subscription_type", "churn_status"]
    per_user = (watch.join(content.select("content_id", "genre"), "content_id", "left")
                .groupBy("user_id").agg(
                    F.count("session_id").alias("_n"),
                    F.count(F.lit(1)).alias("_rows"),
                    F.sum("watch_duration").alias("_min"),
                    F.sum("completion_rate").alias("_comp"),
                    F.count("completion_rate").alias("_comp_n"),
                    F.count_distinct("genre").alias("_genres"),
                    F.sum(F.when(F.col("device_type") == "Mobile", 1).otherwise(0)).alias("_mob")))
    j = users.select(*keys).join(per_user, "user_id", "left")
    return j.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("sessions"),
        F.sum("_min").cast("double").alias("total_watch_minutes"),
        F.try_divide(F.sum("_comp").cast("double"), F.sum("_comp_n")).alias("avg_completion"),
        F.coalesce(F.max("_genres"), F.lit(0)).cast("bigint").alias("unique_genres"),
        F.try_divide(F.sum(F.coalesce("_mob", F.lit(0))).cast("double"),
                     F.sum(F.coalesce("_rows", F.lit(1)))).alias("mobile_share"))


def user_features(enriched: DataFrame) -> DataFrame:
    """Feature mart of viewers with sessions (inner), plus profile columns.

    Profile columns depend on user_id alone, so they ride along in the same
    aggregation (``any_value``) instead of a second join.
    """
    return enriched.groupBy("user_id").agg(
        F.sum("watch_duration").cast("double").alias("total_watch_minutes"),
        F.count("session_id").alias("sessions"),
        X.mean("completion_rate").alias("avg_completion"),
        F.count_distinct("genre").alias("unique_genres"),
        X.share(F.col("is_weekend")).alias("weekend_share"),
        X.share(F.col("device_type") == "Mobile").alias("mobile_share"),
        (X.exact_sum("monthly_price_usd") / 30.0).alias("revenue"),
        F.any_value("age").alias("age"),
        F.any_value("country").alias("country"),
        F.any_value("subscription_type").alias("subscription_type"),
        F.any_value("churn_status").alias("churn_status"))


def user_features_direct(watch: DataFrame, users: DataFrame, content: DataFrame, plans: DataFrame) -> DataFrame:
    """P07 from the star schema without the row-level session mart.

    Sessions that reach the mart (known titles) are reduced to per-viewer
    partials first - counts, exact sums, weekend and mobile counts, distinct
    genres - so users and plans are joined on one row per viewer and a heavy
    viewer is combined map-side.  The roll-up after the joins sums the partials
    over joined rows, exactly as :func:`user_features` does over the mart rows.
    """
    per_user = (watch.join(content.select("content_id", "genre"), "content_id")
                .groupBy("user_id").agg(
                    F.count("session_id").alias("_n"),
                    F.count(F.lit(1)).alias("_rows"),
                    F.sum("watch_duration").alias("_min"),
                    F.sum("completion_rate").alias("_comp"),
                    F.count("completion_rate").alias("_comp_n"),
                    F.count_distinct("genre").alias("_genres"),
                    F.sum(F.when(X.is_weekend("watch_time"), 1).otherwise(0)).alias("_wk"),
                    F.sum(F.when(F.col("device_type") == "Mobile", 1).otherwise(0)).alias("_mob")))
    j = (per_user.join(users.select("user_id", "age", "country", "subscription_type", "churn_status"), "user_id")
         .join(F.broadcast(plans.select("subscription_type", "monthly_price_usd")), "subscription_type"))
    return j.groupBy("user_id").agg(
        F.sum("_min").cast("double").alias("total_watch_minutes"),
        F.sum("_n").alias("sessions"),
        F.try_divide(F.sum("_comp").cast("double"), F.sum("_comp_n")).alias("avg_completion"),
        F.max("_genres").alias("unique_genres"),
        F.try_divide(F.sum("_wk").cast("double"), F.sum("_rows")).alias("weekend_share"),
        F.try_divide(F.sum("_mob").cast("double"), F.sum("_rows")).alias("mobile_share"),
        (F.sum(F.col("monthly_price_usd") * F.col("_rows")).cast("double") / 30.0).alias("revenue"),
        F.any_value("age").alias("age"),
        F.any_value("country").alias("country"),
        F.any_value("subscription_type").alias("subscription_type"),
        F.any_value("churn_status").alias("churn_status"))


def dedupe_devices(observations: DataFrame, order: str = "device_id") -> DataFrame:
    """One row per (user, device type); the row first in ``order`` is kept.

    ``min(struct(order, ...))`` fixes which row stays; with strings it is a sort aggregate
    (tasks sort what they hold by user and device type) that combines map-side.
    """
    cols = [c for c in observations.columns if c not in ("user_id", "device_type", order)]
    kept = observations.groupBy("user_id", "device_type").agg(
        F.min(F.struct(order, *cols)).alias("_first"))
    return kept.select("user_id", "device_type", *[F.col(f"_first.{c}").alias(c) for c in [order, *cols]])


def country_summary(features: DataFrame, users: DataFrame) -> DataFrame:
    """per country, viewers with sessions, their minutes and churned share
    (multi-key inner join of users and the feature mart)."""
    keys = ["user_id", "age", "country", "subscription_type", "churn_status"]
    j = users.select(*keys).join(features.select(*keys, "total_watch_minutes"), keys)
    return j.groupBy("country").agg(
        F.count("user_id").alias("users"),
        X.exact_sum(F.col("total_watch_minutes").cast(X.PROFILE_DECIMAL)).alias("watch_minutes"),
        X.share(F.col("churn_status") == "Churned").alias("churned"))


def churn_counts_by_plan(users: DataFrame) -> DataFrame:
    """users per plan and churn status."""
    return users.groupBy("subscription_type", "churn_status").agg(F.count(F.lit(1)).alias("size"))
