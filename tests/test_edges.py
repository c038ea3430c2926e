"""Edge cases on small literal star-schema tables (FIXTURES.md §7)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from reelpulse import schema as S
from reelpulse.operators import audience as A
from reelpulse.operators import content as C
from reelpulse.operators import kpi as K
from reelpulse.operators import ml as ML
from reelpulse.sources.bindings import subscription_plans

T = dt.datetime


def users(spark, rows):
    return spark.createDataFrame(rows, S.USERS)


def content(spark, rows):
    return spark.createDataFrame(rows, S.CONTENT_LIBRARY)


def watch(spark, rows):
    return spark.createDataFrame(rows, S.WATCH_HISTORY)


def title(cid, genre="Drama", duration=90, release=dt.date(2024, 1, 10), imdb="8.1"):
    return (cid, f"T{cid}", "Movie", genre, 2024, D(imdb), duration, "English", "Licensed", release)


def session(sid, uid, cid, ts, comp="0.50", device="Mobile", minutes="30.00"):
    return (sid, uid, cid, ts, D(comp), device, D(minutes))


def user(uid, plan="Basic", churn="Active", signup=dt.date(2024, 2, 15), country="X"):
    return (uid, 30, country, plan, signup, 10.0, churn)


def test_user_without_sessions_kept_in_churn_features(spark):
    u = users(spark, [user(1), user(2)])
    c = content(spark, [title(10)])
    w = watch(spark, [session("s1", 1, 10, T(2024, 3, 1))])
    got = {r.user_id: r for r in A.churn_features(w, u, c).collect()}
    assert got["2"].sessions == 0 and got["2"].total_watch_minutes is None and got["2"].avg_completion is None
    assert got["2"].unique_genres == 0 and got["2"].mobile_share == 0.0
    assert got["1"].sessions == 1 and got["1"].mobile_share == 1.0


def test_title_without_sessions_counts_as_zero(spark):
    c = content(spark, [title(10, imdb="9.0"), title(11, imdb="9.0"), title(12, imdb="5.0"), title(13, imdb="9.5")])
    w = watch(spark, [session(f"s{i}", 1, cid, T(2024, 3, 1)) for i, cid in enumerate([11, 12, 12, 13, 13, 13])])
    got = sorted(r.content_id for r in C.high_rating_low_discovery(w, c).collect())
    # sessions 0,1,2,3 -> 25th percentile 0.75: only the unwatched high-rated title qualifies
    assert got == ["10"]


def test_single_month_growth_is_null_and_mart_growth_zero(spark):
    w = watch(spark, [session("s1", 1, 10, T(2024, 3, 1)), session("s2", 1, 10, T(2024, 3, 9))])
    rows = K.monthly_growth(w).collect()
    assert len(rows) == 1 and rows[0].prior_month is None and rows[0].growth_rate is None
    mart = spark.createDataFrame([("2024-03", 1.0)], "month string, watch_hours double")
    assert K.monthly_growth_mart(mart).collect()[0].watch_growth_rate == 0.0


def test_zero_prior_month_gives_null_growth(spark):
    w = watch(spark, [session("s1", 1, 10, T(2024, 3, 1), minutes="0.00"),
                      session("s2", 1, 10, T(2024, 4, 1), minutes="60.00")])
    rows = K.monthly_growth(w).orderBy("month").collect()
    assert rows[1].prior_month == 0.0 and rows[1].growth_rate is None


def test_negative_cohort_index(spark):
    u = users(spark, [user(1, signup=dt.date(2024, 3, 31))])
    w = watch(spark, [session("s1", 1, 10, T(2024, 1, 31, 23)), session("s2", 1, 10, T(2024, 4, 1))])
    got = sorted((r.cohort_index, r.retained_users) for r in A.retention_cohorts(w, u).collect())
    assert got == [(-2, 1), (1, 1)]


def test_release_ramp_counts_day_boundaries(spark):
    c = content(spark, [title(10, release=dt.date(2024, 1, 10))])
    w = watch(spark, [session("a", 1, 10, T(2024, 1, 9, 12)),      # 12 h before release: day -1
                      session("b", 1, 10, T(2024, 1, 10, 23)),     # day 0
                      session("c", 1, 10, T(2024, 3, 10, 1)),      # day 60
                      session("d", 1, 10, T(2024, 3, 11, 1))])     # day 61
    got = sorted((r.days_since_release, r.sessions) for r in C.release_ramp(w, c).collect())
    assert got == [(0, 1), (60, 1)]


def test_weekend_is_saturday_and_sunday(spark):
    w = watch(spark, [session("fri", 1, 10, T(2024, 3, 1)), session("sat", 1, 10, T(2024, 3, 2)),
                      session("sun", 1, 10, T(2024, 3, 3)), session("mon", 1, 10, T(2024, 3, 4))])
    got = {r.day_type: r.sessions for r in K.weekend_vs_weekday(w).collect()}
    assert got == {"Weekend": 2, "Weekday": 2}


def test_null_genre_is_a_group(spark):
    c = content(spark, [title(10, genre=None), title(11)])
    w = watch(spark, [session("a", 1, 10, T(2024, 3, 1)), session("b", 1, 11, T(2024, 3, 1))])
    got = {r.genre: r.sessions for r in C.genre_watch(w, c).collect()}
    assert got == {None: 1, "Drama": 1}


def test_rank_ties_share_rank(spark):
    c = content(spark, [title(10), title(11), title(12)])
    w = watch(spark, [session("a", 1, 10, T(2024, 3, 1), minutes="50.00"),
                      session("b", 1, 11, T(2024, 3, 1), minutes="50.00"),
                      session("c", 1, 12, T(2024, 3, 1), minutes="10.00")])
    got = sorted((r.title, r.content_rank) for r in C.top_titles_ranked(w, c, 2).collect())
    assert got == [("T10", 1), ("T11", 1)]


def test_latest_watch_tie_broken_by_session_id(spark):
    u = users(spark, [user(1, churn="Churned")])
    c = content(spark, [title(10, genre="Drama"), title(11, genre="Kids")])
    w = watch(spark, [session("s1", 1, 10, T(2024, 3, 1)), session("s2", 1, 11, T(2024, 3, 1))])
    got = [(r.genre, r.churned_last_sessions) for r in A.last_genre_before_churn(w, u, c).collect()]
    assert got == [("Kids", 1)]


def test_rewatch_needs_a_strictly_later_watch(spark):
    c = content(spark, [title(10), title(11)])
    w = watch(spark, [session("a", 1, 10, T(2024, 3, 1)), session("b", 1, 10, T(2024, 3, 1)),   # same time
                      session("c", 2, 10, T(2024, 3, 1)), session("d", 2, 10, T(2024, 3, 5)),   # later
                      session("e", 1, 11, T(2024, 3, 1))])
    got = {r.title: r.content_retention_rate for r in C.rewatch_rate(w, c).collect()}
    assert got == {"T10": 0.5, "T11": 0.0}


def test_device_dedup_keeps_first_row(spark):
    obs = spark.createDataFrame([("D2", 1, "Mobile", dt.date(2025, 1, 2)), ("D1", 1, "Mobile", dt.date(2025, 1, 1)),
                                 ("D3", 1, "Tablet", dt.date(2025, 1, 3))],
                                "device_id string, user_id long, device_type string, last_active_date date")
    got = sorted(tuple(r) for r in A.dedupe_devices(obs).collect())
    assert got == [(1, "Mobile", "D1", dt.date(2025, 1, 1)), (1, "Tablet", "D3", dt.date(2025, 1, 3))]


def test_zero_users_in_a_country_has_no_row(spark):
    u = users(spark, [user(1, country="A")])
    got = [r.country for r in A.revenue_per_user_by_country(u, subscription_plans(spark)).collect()]
    assert got == ["A"]


def test_auc_with_ties_and_single_class(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.9), (3, 1, 0.5), (4, 0, 0.1)],
                                   "user_id long, label int, score double")
    # pairs (pos, neg): (0.9,0.9)=.5 (0.9,0.1)=1 (0.5,0.9)=0 (0.5,0.1)=1 -> 2.5/4
    assert ML.roc_auc(scored).collect()[0][0] == pytest.approx(0.625)
    one = scored.withColumn("label", F.lit(1))
    assert ML.roc_auc(one).collect()[0][0] is None


def test_duplicate_catalogue_rows_count_like_a_row_level_join(spark):
    """A title listed twice doubles its sessions (as the SQL join does) but not its viewers."""
    import duckdb
    c = content(spark, [title(10), title(10), title(11)])
    w = watch(spark, [session("a", 1, 10, T(2024, 3, 1)), session("b", 2, 10, T(2024, 3, 2)),
                      session("c", 1, 11, T(2024, 3, 1))])
    got = {r.content_id: (r.sessions, r.viewers) for r in C.content_engagement(w, c).collect()}
    wp, cp = w.toPandas(), c.toPandas()
    want = duckdb.sql("SELECT c.content_id, COUNT(*) AS s, COUNT(DISTINCT w.user_id) AS v FROM wp w "
                      "JOIN cp c ON w.content_id = c.content_id GROUP BY c.content_id, c.title, c.genre").fetchall()
    assert got == {cid: (s, v) for cid, s, v in want} == {"10": (4, 2), "11": (1, 1)}


def test_churn_features_equal_sql_with_duplicate_user_rows(spark):
    import duckdb
    u = users(spark, [user(1), user(1), user(2), user(3, plan="Premium")])
    c = content(spark, [title(10, genre="Drama"), title(11, genre="Kids")])
    w = watch(spark, [session("a", 1, 10, T(2024, 3, 1), device="Mobile"),
                      session("b", 1, 11, T(2024, 3, 2), device="Tablet", comp="0.90"),
                      session("c", 2, 12, T(2024, 3, 3), minutes="5.00")])          # title 12 not in catalogue
    up, cp, wp = u.toPandas(), c.toPandas(), w.toPandas()
    want = duckdb.sql("""
        WITH seen AS (FROM wp LEFT JOIN (SELECT content_id, genre FROM cp) USING (content_id)
          SELECT user_id, count(*) AS k, sum(watch_duration) AS mins, sum(completion_rate) AS done,
            count(completion_rate) AS known, count(DISTINCT genre) AS genres, count_if(device_type = 'Mobile') AS phone
          GROUP BY user_id),
        people AS (SELECT user_id, count(*) AS copies FROM up GROUP BY user_id)
        SELECT user_id, coalesce(k, 0) * copies, (mins * copies)::DOUBLE, done::DOUBLE / nullif(known, 0),
          coalesce(genres, 0), coalesce(phone::DOUBLE / k, 0.0)
        FROM people LEFT JOIN seen USING (user_id)""").fetchall()
    got = A.churn_features(w, u, c).select("user_id", "sessions", "total_watch_minutes", "avg_completion",
                                          "unique_genres", "mobile_share").collect()
    norm = lambda rows: sorted(tuple(None if x is None else (round(x, 12) if isinstance(x, float) else x)
                                     for x in r) for r in rows)
    assert norm(got) == norm(want)
    assert {r.user_id: r.sessions for r in got} == {"1": 4, "2": 1, "3": 0}
