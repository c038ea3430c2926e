"""Content and genre analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exprs as X
from ..session import checkpoint_dir
from . import ordered
from .kpi import priced_viewers


def _by_minutes():
    """Order of top titles: most minutes first, then the grouping columns, so the cut is the same in every run."""
    return [F.desc_nulls_last("_minutes"), *map(F.asc_nulls_last, ("title", "content_type", "genre"))]


def _with_content(watch: DataFrame, content: DataFrame, *cols: str) -> DataFrame:
    return watch.join(content.select("content_id", *cols), "content_id")


def _title_partials(watch: DataFrame, content: DataFrame, *cols: str) -> DataFrame:
    """Session partials per title, joined to the catalogue: one row per title at the join, however hot."""
    return X.session_partials(watch, "content_id").join(content.select("content_id", *cols), "content_id")


def genre_watch(watch: DataFrame, content: DataFrame) -> DataFrame:
    """Q04: sessions, hours and completion per genre."""
    return _title_partials(watch, content, "genre").groupBy("genre").agg(
        X.rolled_sessions().alias("sessions"),
        X.rolled_hours().alias("watch_hours"),
        X.rolled_completion().alias("avg_completion"))


def genre_hours(watch: DataFrame, content: DataFrame) -> DataFrame:
    """M01 per genre: hours from per-title partials."""
    return _title_partials(watch, content, "genre").groupBy("genre").agg(X.rolled_hours().alias("total_watch_hours"))


def title_totals(watch: DataFrame, content: DataFrame) -> DataFrame:
    """Per (title, type, genre): sessions, exact minutes and completion.

    Sessions are reduced to per-title partials before meeting the catalogue, so
    the join carries one row per title (and a heavily watched title is combined
    map-side); titles sharing a name are then rolled up.
    """
    return (X.session_partials(watch, "content_id")
            .join(content.select("content_id", "title", "content_type", "genre"), "content_id")
            .groupBy("title", "content_type", "genre").agg(
                X.rolled_sessions().alias("sessions"),
                F.sum("_min").alias("_minutes"),
                X.rolled_completion().alias("avg_completion")))


def top_titles_ranked(watch: DataFrame, content: DataFrame, n: int = 50) -> DataFrame:
    """Q05: RANK by minutes watched, first ``n`` ranks.

    The ranks of the first ``n`` rows equal their ranks inside the top ``n``, so the
    top ``n`` is taken first (per-partition top-k, then a merge of k rows per
    partition) and ranked after; no global window over all titles.
    """
    top = (title_totals(watch, content)
           .orderBy(*_by_minutes()).limit(n))
    return top.select(
        "title", "content_type", "genre", "sessions",
        F.col("_minutes").cast("double").alias("minutes_watched"), "avg_completion",
        F.rank().over(Window.orderBy(F.col("_minutes").desc_nulls_last())).cast("bigint").alias("content_rank"))


def content_engagement(watch: DataFrame, content: DataFrame) -> DataFrame:
    """Q06: per title sessions, viewers, hours, completion and the engagement score.

    Aggregated per title id first, then joined to the catalogue and rolled up by
    (id, title, genre): sums add over joined rows exactly as the SQL's
    row-level join would, and the distinct-viewer count is the same on every
    joined copy.
    """
    per = watch.groupBy("content_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("watch_duration").alias("_min"),
        F.sum("completion_rate").alias("_comp"), F.count("completion_rate").alias("_comp_n"),
        F.count_distinct("user_id").alias("_viewers"))
    perf = (per.join(content.select("content_id", "title", "genre"), "content_id")
            .groupBy("content_id", "title", "genre").agg(
                X.rolled_sessions().alias("sessions"),
                F.max("_viewers").alias("viewers"),
                X.rolled_hours().alias("watch_hours"),
                X.rolled_completion().alias("completion")))
    return perf.withColumn("engagement_score", X.engagement_score(
        "watch_hours", "viewers", "completion", S.ENGAGEMENT_QUERY_WEIGHTS))


def low_completion_risk(watch: DataFrame, content: DataFrame,
                        min_sessions: int = S.LOW_COMPLETION_MIN_SESSIONS,
                        max_rate: float = S.LOW_COMPLETION_MAX_RATE) -> DataFrame:
    """Q16: titles with at least ``min_sessions`` sessions and completion below ``max_rate``."""
    g = (X.session_partials(watch, "content_id")
         .join(content.select("content_id", "title", "genre", "content_type"), "content_id")
         .groupBy("title", "genre", "content_type").agg(
             X.rolled_sessions().alias("sessions"), X.rolled_completion().alias("avg_completion")))
    return g.filter((F.col("sessions") >= min_sessions) & (F.col("avg_completion") < float(max_rate)))


def review_sentiment_by_genre(reviews: DataFrame, content: DataFrame) -> DataFrame:
    """Q17: mean rating, share of ratings >= 4 and review count per genre (per-title partials first)."""
    per = reviews.groupBy("content_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("rating").alias("_sum"), F.count("rating").alias("_rated"),
        F.sum(F.when(F.col("rating") >= S.POSITIVE_RATING, 1).otherwise(0)).alias("_pos"))
    return per.join(content.select("content_id", "genre"), "content_id").groupBy("genre").agg(
        F.try_divide(F.sum("_sum").cast("double"), F.sum("_rated")).alias("avg_rating"),
        F.try_divide(F.sum("_pos").cast("double"), F.sum("_n")).alias("positive_share"),
        F.sum("_n").alias("reviews"))


def original_vs_licensed(watch: DataFrame, content: DataFrame) -> DataFrame:
    """Q20: originals against licensed titles; imdb is session-weighted."""
    rated = F.col("imdb_rating").isNotNull()
    return _title_partials(watch, content, "original_flag", "imdb_rating").groupBy("original_flag").agg(
        X.rolled_sessions().alias("sessions"),
        X.rolled_hours().alias("watch_hours"),
        X.rolled_completion().alias("completion"),
        F.try_divide(F.sum(F.col("imdb_rating") * F.col("_n")).cast("double"), F.sum(F.when(rated, F.col("_n"))))
        .alias("imdb"))


def release_ramp(watch: DataFrame, content: DataFrame, max_days: int = S.RAMP_MAX_DAYS) -> DataFrame:
    """Q21: sessions per title and day since release, days 0..max_days.

    Day difference counts calendar-day boundaries (a watch 12 hours before the
    release is day -1, not 0).  Sessions are counted per (title id, day) before
    the catalogue join.
    """
    daily = watch.groupBy("content_id", F.to_date("watch_time").alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"))
    j = daily.join(content.select("content_id", "title", "release_date"), "content_id")
    return (j.withColumn("days_since_release", F.datediff("_day", "release_date").cast("bigint"))
            .filter(F.col("days_since_release").between(0, max_days))
            .groupBy("title", "days_since_release").agg(F.sum("_n").alias("sessions")))


def language_demand(watch: DataFrame, content: DataFrame) -> DataFrame:
    """Q22: sessions, hours and distinct viewers per language."""
    return _with_content(watch, content, "language").groupBy("language").agg(
        F.count(F.lit(1)).alias("sessions"),
        X.hours("watch_duration").alias("watch_hours"),
        F.count_distinct("user_id").alias("viewers"))


def completion_by_duration(watch: DataFrame, content: DataFrame) -> DataFrame:
    """Q23: completion and sessions per duration bucket."""
    j = _title_partials(watch, content, "duration")
    return j.groupBy(X.duration_bucket("duration").alias("duration_bucket")).agg(
        X.rolled_completion().alias("avg_completion"), X.rolled_sessions().alias("sessions"))


def rewatch_rate(watch: DataFrame, content: DataFrame) -> DataFrame:
    """Q26: share of a title's viewers who watch it again strictly after their first watch.

    A viewer has a later session exactly when their latest watch of the title is
    after their first one, so one aggregation per (viewer, title) replaces the
    self-join; it combines map-side, so a heavy viewer is never one task's load.
    """
    per_viewer = watch.groupBy("user_id", "content_id").agg(
        (F.max("watch_time") > F.min("watch_time")).alias("rewatched"))
    return (per_viewer.join(content.select("content_id", "title", "genre"), "content_id")
            .groupBy("title", "genre")
            .agg(X.share(F.col("rewatched")).alias("content_retention_rate")))


def catalogue_saturation(content: DataFrame) -> DataFrame:
    """Q30: titles and mean imdb per genre and release year."""
    return content.groupBy("genre", "release_year").agg(
        F.count(F.lit(1)).alias("titles"), X.mean("imdb_rating").alias("avg_imdb"))


def high_rating_low_discovery(watch: DataFrame, content: DataFrame, min_imdb=S.HIGH_IMDB,
                              pct: float = S.DISCOVERY_PERCENTILE, approx: bool = False) -> DataFrame:
    """Q31: imdb >= ``min_imdb`` titles with fewer sessions than the ``pct`` percentile
    of sessions over all titles (titles never watched count with 0)."""
    counts = watch.groupBy("content_id").agg(F.count("session_id").alias("_n"))
    # Counted per title id first, then rolled up by the SQL's grouping columns.
    perf = (content.select("content_id", "title", "genre", "imdb_rating")
            .join(counts, "content_id", "left")
            .groupBy("content_id", "title", "genre", "imdb_rating")
            .agg(F.sum(F.coalesce(F.col("_n"), F.lit(0))).cast("bigint").alias("sessions")))
    # Checkpointed once: the percentile and the filter read the same per-title rows.
    checkpoint_dir(watch.sparkSession)
    perf = perf.checkpoint(eager=True)
    cut = (perf.agg(F.percentile_approx("sessions", pct, 10000).cast("double")) if approx
           else ordered.percentile_cont(perf, "sessions", pct, key=["content_id"]))
    return (perf.filter((F.col("imdb_rating") >= min_imdb) & (F.col("sessions") < cut.scalar()))
            .withColumn("imdb_rating", F.col("imdb_rating").cast("double")))


def monthly_genre_hours(watch: DataFrame, content: DataFrame) -> DataFrame:
    """Q32: hours per month and genre (forecast input)."""
    per = X.session_partials(watch, "content_id", X.month_start("watch_time").alias("month"))
    return (per.join(content.select("content_id", "genre"), "content_id")
            .groupBy("month", "genre").agg(X.rolled_hours().alias("watch_hours")))


def genre_performance(enriched: DataFrame) -> DataFrame:
    """Genre mart with the mart-weighted engagement score."""
    g = enriched.groupBy("genre").agg(
        X.hours("watch_duration").alias("watch_hours"),
        F.count("session_id").alias("sessions"),
        F.count_distinct("user_id").alias("active_users"),
        X.mean("completion_rate").alias("avg_completion"),
        (X.exact_sum("monthly_price_usd") / 30.0).alias("revenue_usd"),
        X.mean("imdb_rating").alias("avg_imdb"))
    return g.withColumn("engagement_score", X.engagement_score(
        "watch_hours", "active_users", "avg_completion", S.ENGAGEMENT_MART_WEIGHTS))


def genre_performance_direct(watch: DataFrame, users: DataFrame, content: DataFrame, plans: DataFrame) -> DataFrame:
    """P06 from the star schema: sessions are reduced to one row per (viewer, title) before any join, then to
    (viewer, genre), and meet users and plans last, one row per viewer, so that distinct viewers are a plain count.
    Sums over these rows are those over the mart's rows."""
    per = watch.groupBy("user_id", "content_id").agg(
        F.count("session_id").alias("_ids"), F.count(F.lit(1)).alias("_n"), F.sum("watch_duration").alias("_min"),
        F.sum("completion_rate").alias("_comp"), F.count("completion_rate").alias("_comp_n"))
    rated = F.col("imdb_rating").isNotNull()
    by_genre = (per.join(content.select("content_id", "genre", "imdb_rating"), "content_id")
                .groupBy("user_id", "genre").agg(
                    F.sum("_ids").alias("_ids"), F.sum("_n").alias("_n"), F.sum("_min").alias("_min"),
                    F.sum("_comp").alias("_comp"), F.sum("_comp_n").alias("_comp_n"),
                    F.sum(F.col("imdb_rating") * F.col("_n")).alias("_imdb"),
                    F.sum(F.when(rated, F.col("_n"))).alias("_imdb_n")))
    k = F.col("_k")
    g = (by_genre.join(priced_viewers(users, plans), "user_id")
         .groupBy("genre").agg(
             (F.sum(F.col("_min") * k).cast("double") / 60.0).alias("watch_hours"),
             F.sum(F.col("_ids") * k).alias("sessions"),
             F.count(F.lit(1)).alias("active_users"),
             F.try_divide(F.sum(F.col("_comp") * k).cast("double"), F.sum(F.col("_comp_n") * k)).alias("avg_completion"),
             (F.sum(F.col("_price") * F.col("_n")).cast("double") / 30.0).alias("revenue_usd"),
             F.try_divide(F.sum(F.col("_imdb") * k).cast("double"), F.sum(F.col("_imdb_n") * k)).alias("avg_imdb")))
    return g.withColumn("engagement_score", X.engagement_score(
        "watch_hours", "active_users", "avg_completion", S.ENGAGEMENT_MART_WEIGHTS))


def completion_retention_by_genre(watch: DataFrame, content: DataFrame) -> DataFrame:
    """M09 per genre: share of a genre's viewers with any session completed to the threshold.

    One row per (viewer, title), then per (viewer, genre), replaces two distinct counts over the joined fact."""
    kept = F.max(F.coalesce(F.col("completion_rate") >= S.RETENTION_COMPLETION, F.lit(False)))
    per = watch.filter(F.col("user_id").isNotNull()).groupBy("user_id", "content_id").agg(kept.alias("_kept"))
    return (per.join(content.select("content_id", "genre"), "content_id")
            .groupBy("genre", "user_id").agg(F.max("_kept").alias("_kept"))
            .groupBy("genre").agg(F.try_divide(F.count_if("_kept").cast("double"), F.count(F.lit(1)))
                                  .alias("completion_retention_rate")))


def review_sentiment(reviews: DataFrame) -> DataFrame:
    """Sentiment label per review."""
    return reviews.withColumn("sentiment_label", X.sentiment_label("rating"))


def top_titles_by_minutes(sessions: DataFrame, n: int = 10) -> DataFrame:
    """top ``n`` titles by minutes (sessions need title, genre, content_type)."""
    g = sessions.groupBy("title", "genre", "content_type").agg(
        F.count("session_id").alias("sessions"),
        X.mean("completion_rate").alias("avg_completion"),
        F.sum("watch_duration").alias("_minutes"))
    return (g.orderBy(*_by_minutes()).limit(n)
            .withColumn("watch_minutes", F.col("_minutes").cast("double")).drop("_minutes"))


def top_titles(watch: DataFrame, content: DataFrame, n: int = 10) -> DataFrame:
    """F04 over raw sessions: per-title partials first, then the catalogue join."""
    t = title_totals(watch, content)
    return (t.orderBy(*_by_minutes()).limit(n)
            .select("title", "genre", "content_type", "sessions", "avg_completion",
                    F.col("_minutes").cast("double").alias("watch_minutes")))


def genre_content_rollup(sessions: DataFrame) -> DataFrame:
    """genre -> content type hierarchy with totals at every level and
    minutes-weighted completion (ROLLUP (genre, content_type); ``level`` is the
    grouping id: 0 leaf, 1 genre total, 3 grand total).

    Sessions are aggregated once at the leaf level; the genre and grand totals
    roll up that small table, instead of expanding every session row three
    times.  As in SQL, the grand total row exists even when there are no
    sessions.
    """
    dc = F.col("watch_duration") * F.col("completion_rate")
    leaf = sessions.groupBy("genre", "content_type").agg(F.sum("watch_duration").alias("_d"), F.sum(dc).alias("_dc"))
    genre = leaf.groupBy("genre").agg(F.sum("_d").alias("_d"), F.sum("_dc").alias("_dc"))
    total = leaf.agg(F.sum("_d").alias("_d"), F.sum("_dc").alias("_dc"))
    none = F.lit(None).cast("string")
    rows = (leaf.select("genre", "content_type", "_d", "_dc", F.lit(0).cast("bigint").alias("level"))
            .unionByName(genre.select("genre", none.alias("content_type"), "_d", "_dc",
                                      F.lit(1).cast("bigint").alias("level")))
            .unionByName(total.select(none.alias("genre"), none.alias("content_type"), "_d", "_dc",
                                      F.lit(3).cast("bigint").alias("level"))))
    return rows.select(
        "genre", "content_type", F.col("_d").cast("double").alias("watch_minutes"),
        F.try_divide(F.col("_dc").cast("double"), F.col("_d").cast("double")).alias("weighted_completion"),
        "level")


def top_genres_by_score(genre_perf: DataFrame, n: int = 10) -> DataFrame:
    """F16: the ``n`` genres with the highest mart engagement score."""
    return genre_perf.orderBy(F.col("engagement_score").desc_nulls_last(), F.col("genre").asc_nulls_last()).limit(n)
