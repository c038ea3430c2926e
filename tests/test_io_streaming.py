"""Sources, sinks and the streaming daily activity operator."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import same, spark_rows
from reelpulse import schema as S
from reelpulse.operators import audience as A
from reelpulse.operators import content as C
from reelpulse.operators import feeds as FD
from reelpulse.operators import kpi as K
from reelpulse.operators import ml as ML
from reelpulse.sources import sinks
from reelpulse.sources.bindings import event_sessions, load_star
from reelpulse.sources.tables import read_canonical
from reelpulse.streaming import daily_activity as SD


def test_csv_roundtrip_with_fixed_schema(spark, scratch):
    t = load_star(spark, SF_SMALL)
    path = sinks.write_csv(t.watch, os.path.join(scratch, "watch_history"))
    back = read_canonical(spark, path, "watch_history")
    assert back.schema == S.WATCH_HISTORY
    assert back.columns == t.watch.columns
    ids = t.watch.withColumns({c: F.col(c).cast("string") for c in ("user_id", "content_id")})
    assert same(spark_rows(back), spark_rows(ids))


def test_export_filtered_sessions(spark, scratch):
    t = load_star(spark, SF_SMALL)
    f = FD.filtered_sessions(t.watch, t.users, t.content, t.plans, countries=["NATION_1", "NATION_2"])
    path = sinks.export_filtered_sessions(f.select("session_id", "country", "genre"), os.path.join(scratch, "f"))
    back = spark.read.option("header", True).csv(path)
    assert back.count() == f.count() > 0
    assert {r.country for r in back.select("country").distinct().collect()} <= {"NATION_1", "NATION_2"}


def test_build_marts_without_models(spark, scratch):
    out = sinks.build_marts(spark, SF_SMALL, scratch, with_models=False)
    monthly = spark.read.parquet(out["monthly_kpis"])
    assert monthly.count() > 0 and "watch_growth_rate" in monthly.columns
    enriched = spark.read.parquet(out["watch_enriched"])
    t = load_star(spark, SF_SMALL)
    assert enriched.count() == K.enriched_sessions(t.watch, t.users, t.content, t.plans).count() > 0
    assert enriched.filter(F.col("month") == "1995-01").count() == enriched.filter(
        (F.year("watch_time") == 1995) & (F.month("watch_time") == 1)).count() > 0
    assert set(out) == {"watch_enriched", "monthly_kpis", "genre_performance", "review_sentiment", "watch_time_forecast"}


def test_streaming_daily_activity_matches_batch(spark, scratch):
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    src = os.path.join(scratch, "events")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(4).write.parquet(src)
    q = SD.run_daily_activity(spark, src, out, ckpt)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out)
    batch = K.daily_active_users(event_sessions(spark, SF_SMALL))
    # Append mode emits a day once the watermark (max time - 1 day) has passed it.
    joined = streamed.join(batch.withColumnRenamed("dau", "b_dau").withColumnRenamed("sessions", "b_s")
                           .withColumnRenamed("watch_hours", "b_h"), "watch_date")
    rows = joined.collect()
    assert len(rows) == streamed.count() > 0
    assert batch.count() - len(rows) <= 2
    for r in rows:
        assert (r.dau, r.sessions) == (r.b_dau, r.b_s)
        assert abs(r.watch_hours - r.b_h) < 1e-9


def test_build_marts_with_models(spark, scratch):
    out = sinks.build_marts(spark, SF_SMALL, scratch, with_models=True)
    segs = spark.read.parquet(out["viewer_segments"])
    assert segs.select("viewer_segment").distinct().count() == 5
    recs = spark.read.option("header", True).csv(out["recommendation_preview"])
    assert recs.count() == 50
    metrics = spark.read.json(out["model_metrics"]).collect()[0]
    t = load_star(spark, SF_SMALL)
    assert metrics.sessions == t.watch.count() and metrics.reviews == t.reviews.count()
    assert spark.read.parquet(out["user_features"]).count() == segs.count()
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.clustering import KMeansModel
    assert KMeansModel.load(os.path.join(out["models"], "viewer_segmentation_kmeans")).getK() == 5
    assert RandomForestClassificationModel.load(
        os.path.join(out["models"], "churn_prediction_random_forest")).getNumTrees == 160


def test_streaming_drops_data_later_than_the_watermark(spark, scratch):
    import datetime as dt
    rows1 = [(1, dt.datetime(2024, 1, 1, 10), 1, "view", 10.0, '{"k": 1}'),
             (2, dt.datetime(2024, 1, 5, 10), 2, "view", 10.0, '{"k": 1}')]
    rows2 = [(3, dt.datetime(2024, 1, 1, 11), 3, "view", 10.0, '{"k": 1}'),    # 4 days late: dropped
             (4, dt.datetime(2024, 1, 9, 10), 4, "view", 10.0, '{"k": 1}')]
    src, out, ckpt = (os.path.join(scratch, x) for x in ("src", "out", "ckpt"))
    spark.createDataFrame(rows1, SD.EVENTS_SCHEMA).write.parquet(os.path.join(src, "b1"))
    SD.run_daily_activity(spark, os.path.join(src, "*"), out, ckpt).awaitTermination(300)
    spark.createDataFrame(rows2, SD.EVENTS_SCHEMA).write.parquet(os.path.join(src, "b2"))
    SD.run_daily_activity(spark, os.path.join(src, "*"), out, ckpt).awaitTermination(300)
    got = {r.watch_date: r.dau for r in spark.read.parquet(out).collect()}
    assert got[dt.date(2024, 1, 1)] == 1          # the late viewer 3 did not reopen the closed day
    assert dt.date(2024, 1, 5) in got


def test_hourly_sessions_on_batch_input(spark):
    w = event_sessions(spark, SF_SMALL)
    got = SD.hourly_sessions(w).groupBy(F.hour("hour_start").alias("h")).agg(
        F.sum("sessions").alias("sessions"), F.sum("watch_hours").alias("watch_hours"))
    want = K.hour_of_day(w)
    rows = {r.h: (r.sessions, r.watch_hours) for r in got.collect()}
    for r in want.collect():
        assert rows[r.hour_of_day][0] == r.sessions
        assert abs(rows[r.hour_of_day][1] - r.watch_hours) < 1e-6


def test_canonical_json_and_parquet_readers(spark, scratch):
    t = load_star(spark, SF_SMALL)
    for fmt, writer in (("json", sinks.write_json), ("parquet", sinks.write_parquet)):
        path = writer(t.content, os.path.join(scratch, f"content_{fmt}"))
        back = read_canonical(spark, path, "content_library", fmt=fmt)
        assert back.schema == S.CONTENT_LIBRARY
        assert same(spark_rows(back), spark_rows(t.content.withColumn("content_id", F.col("content_id").cast("string"))))


def test_command_line_run_writes_result(spark, scratch):
    from reelpulse.__main__ import main
    out = os.path.join(scratch, "q07")
    assert main(["run", "q07_churn_by_plan", SF_SMALL, "--out", out]) == 0
    back = spark.read.parquet(out)
    assert back.count() == 4 and set(back.columns) == {"subscription_type", "churn_rate", "users"}
    assert main(["run", "no_such_operator", SF_SMALL]) == 2


SOURCE_FILES = {
    "users": ("User_ID,Age,Country,Subscription_Type,Signup_Date,Watch_Hours,Churn_Status",
              ["U100000,31,India,Premium,2023-05-01,41.27,Active", "U100001,19,Brazil,Mobile,2022-02-11,3.5,Churned"]),
    "subscription_plans": ("Plan_ID,Subscription_Type,Monthly_Price_USD,Max_Streams,Resolution",
                           ["P_PREMIUM,Premium,18.99,4,4K Ultra HD", "P_MOBILE,Mobile,4.99,1,Mobile HD"]),
    "content_library": ("Content_ID,Title,Content_Type,Genre,Release_Year,IMDB_Rating,Duration,Language,Original_Flag,"
                        "Release_Date",
                        ["C200000,Drama Movie #0000,Movie,Drama,2019,7.4,104,English,Licensed,2023-03-09",
                         '"C200001","Kids, Show #0001",TV Show,Kids,2024,6.1,31,Hindi,Netflix Original,2024-01-02']),
    "devices": ("Device_ID,User_ID,Device_Type,OS,Last_Active_Date",
                ["D300000,U100000,Mobile,iOS,2025-12-01", "D300001,U100001,Tablet,Android,2025-11-30"]),
    "watch_history": ("Session_ID,User_ID,Content_ID,Watch_Time,Completion_Rate,Device_Type,Watch_Duration",
                      ["S500000,U100000,C200000,2024-06-01 20:14:00,0.693,Mobile,72.1",
                       "S500001,U100000,C200001,2024-06-02 09:00:00,0.797,Smart TV,24.7",
                       "S500002,U100001,C200001,2024-07-03 23:59:00,0.8,Mobile,24.8"]),
    "reviews": ("Review_ID,Session_ID,User_ID,Content_ID,Rating,Review_Text,Review_Date",
                ["R700000,S500000,U100000,C200000,4,gripping fresh premium,2024-06-01"]),
}


def source_tables(spark, folder):
    """The six tables read from files shaped like the source's: string ids, three decimals, review text, OS."""
    out = {}
    for name, (header, rows) in SOURCE_FILES.items():
        path = os.path.join(folder, f"{name}.csv")
        with open(path, "w") as f:
            f.write("\n".join([header, *rows]) + "\n")
        out[name] = read_canonical(spark, path, name)
    return out


def test_source_shaped_csv_is_read_exactly(spark, scratch):
    t = source_tables(spark, scratch)
    for name, (header, rows) in SOURCE_FILES.items():
        assert t[name].schema == S.CANONICAL[name] and t[name].count() == len(rows), name
    assert [str(r.completion_rate) for r in t["watch_history"].orderBy("session_id").collect()] == [
        "0.693000", "0.797000", "0.800000"]
    assert t["reviews"].first().review_text == "gripping fresh premium"
    assert {r.os for r in t["devices"].collect()} == {"iOS", "Android"}
    assert {r.title for r in t["content_library"].collect()} == {"Drama Movie #0000", "Kids, Show #0001"}


def test_operators_on_source_shaped_csv(spark, scratch):
    t = source_tables(spark, scratch)
    watch, users, content, plans = (t[n] for n in ("watch_history", "users", "content_library", "subscription_plans"))
    row = K.executive_kpis(watch, users, plans).first()
    assert (row.watch_sessions, row.active_users) == (3, 2)
    assert abs(row.avg_completion - (0.693 + 0.797 + 0.8) / 3) < 1e-12
    assert abs(row.revenue_proxy - (2 * 18.99 + 4.99) / 30) < 1e-12
    per_user = {r.user_id: (r.sessions, r.unique_genres) for r in A.churn_features(watch, users, content).collect()}
    assert per_user == {"U100000": (2, 2), "U100001": (1, 1)}
    months = {r.month: r.sessions for r in K.monthly_kpis_direct(watch, users, content, plans).collect()}
    assert months == {"2024-06": 2, "2024-07": 1}
    features = A.user_features_direct(watch, users, content, plans)
    assert {r.user_id: r.total_watch_minutes for r in features.collect()} == {"U100000": 96.8, "U100001": 24.8}
    split = ML.stratified_split(ML.churn_dataset(features)).collect()
    assert {r.user_id for r in split} == {"U100000", "U100001"} and all(r.is_test for r in split)
    # 0.797 is below the retention threshold of 0.8.
    kept = {r.genre: r.completion_retention_rate for r in C.completion_retention_by_genre(watch, content).collect()}
    assert kept == {"Drama": 0.0, "Kids": 0.5}


def test_three_decimals_survive_the_writers(spark, scratch):
    watch = source_tables(spark, scratch)["watch_history"]
    back = read_canonical(spark, sinks.write_csv(watch, os.path.join(scratch, "out")), "watch_history")
    assert same(spark_rows(back), spark_rows(watch))


def test_other_columns_are_refused(spark, scratch):
    import pytest
    path = os.path.join(scratch, "plans.csv")
    with open(path, "w") as f:
        f.write("Plan_ID,Subscription_Type,Price,Max_Streams,Resolution\nP,Basic,1.0,1,HD\n")
    with pytest.raises(ValueError, match="columns"):
        read_canonical(spark, path, "subscription_plans")


def test_filter_feed_leaves_no_cache(spark):
    t = load_star(spark, SF_SMALL)
    spark.catalog.clearCache()
    assert FD.filtered_kpis(FD.filtered_sessions(t.watch, t.users, t.content, t.plans)).count() == 1
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
