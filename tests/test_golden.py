"""Golden figures from the reference's committed outputs (values stated as literal data)."""

import pytest
from pyspark.sql import functions as F

from reelpulse import schema as S
from reelpulse.functions import exprs as X
from reelpulse.operators import forecast as FC
from reelpulse.operators import kpi as K

# Monthly watch hours 2024-01 .. 2025-12 of the reference run.
MONTHLY_HOURS = [
    5980.051666666666, 5733.233333333334, 6079.61, 5747.696666666667, 6025.166666666667, 5775.41,
    5957.545, 6054.671666666666, 5989.6883333333335, 6079.8150000000005, 5837.331666666666,
    6122.608333333334, 5980.996666666668, 5457.804999999999, 6051.8099999999995, 5979.025,
    6023.195000000001, 5802.466666666666, 6100.693333333333, 5832.89, 5850.655000000001,
    5906.306666666667, 5802.443333333333, 5884.036666666667,
]
# Its growth rates for the first four months and its six-month forecast.
GROWTH_HEAD = [0.0, -0.04127361218450998, 0.06041558864398788, -0.05459451072245303]
FORECAST = [
    ("2026-01", 5894.851147342995), ("2026-02", 5892.922066908213), ("2026-03", 5890.99298647343),
    ("2026-04", 5889.0639060386475), ("2026-05", 5887.1348256038655), ("2026-06", 5885.205745169083),
]
# Genre, watch hours, active users, avg completion, engagement score (first five genres).
GENRES = [
    ("Drama", 18616.719999999998, 11516, 0.6844409606044253, 13076.267362115488),
    ("Comedy", 17757.291666666668, 10159, 0.7428693061440679, 12622.62382150424),
    ("Action", 15535.156666666666, 9618, 0.6838568669527897, 11307.919534334764),
    ("Thriller", 12964.201666666666, 8896, 0.685323428388849, 10011.722749360972),
    ("Sports", 2709.2466666666664, 2679, 0.6811084710743802, 4138.840648760331),
]


def _months():
    return [f"{2024 + i // 12}-{i % 12 + 1:02d}" for i in range(24)]


def test_growth_rate(spark):
    monthly = spark.createDataFrame(list(zip(_months(), MONTHLY_HOURS)), "month string, watch_hours double")
    got = K.monthly_growth_mart(monthly).orderBy("month").collect()
    assert [r.watch_growth_rate for r in got[:4]] == pytest.approx(GROWTH_HEAD, rel=1e-12)


def test_forecast(spark):
    monthly = spark.createDataFrame([(m, h * 60.0) for m, h in zip(_months(), MONTHLY_HOURS)],
                                    "month string, minutes double")
    got = FC.watch_time_forecast(monthly).orderBy("month").collect()
    assert [r.month for r in got] == [m for m, _ in FORECAST]
    assert [r.forecast_watch_hours for r in got] == pytest.approx([v for _, v in FORECAST], rel=1e-9)


def test_forecast_single_month(spark):
    monthly = spark.createDataFrame([("2024-12", 600.0)], "month string, minutes double")
    got = FC.watch_time_forecast(monthly, 2).orderBy("month").collect()
    assert [(r.month, r.forecast_watch_hours) for r in got] == [("2025-01", 10.0), ("2025-02", 10.0)]


def test_genre_engagement_score(spark):
    df = spark.createDataFrame([g[:4] for g in GENRES], "genre string, watch_hours double, active_users long, "
                                                        "avg_completion double")
    got = df.select("genre", X.engagement_score("watch_hours", "active_users", "avg_completion",
                                                S.ENGAGEMENT_MART_WEIGHTS).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([g[4] for g in GENRES], rel=1e-12)


def test_conservation_months_equal_genres(spark):
    """Σ over months = Σ over genres for sessions, minutes and revenue."""
    from conftest import SF_MID
    from reelpulse.operators import content as C
    from reelpulse.sources.bindings import load_star
    t = load_star(spark, SF_MID)
    e = K.enriched_sessions(t.watch, t.users, t.content, t.plans)
    m = K.monthly_kpis(e).agg(F.sum("sessions"), F.sum("watch_hours"), F.sum("revenue_usd")).collect()[0]
    g = C.genre_performance(e).agg(F.sum("sessions"), F.sum("watch_hours"), F.sum("revenue_usd")).collect()[0]
    assert m[0] == g[0] == 60000
    assert m[1] == pytest.approx(g[1], rel=1e-12) and m[1] == pytest.approx(1524135.0 / 60, rel=1e-12)
    assert m[2] == pytest.approx(g[2], rel=1e-12) and m[2] == pytest.approx(23229.833333, rel=1e-9)
