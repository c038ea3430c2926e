"""Canonical star schema and the fixed values the analytics depend on.

Ids are strings, as the source files have them; the operators only join, group and
order by ids, so tables bound with integer ids (the test fixture) work alike.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("country", T.StringType()),
    T.StructField("subscription_type", T.StringType()),
    T.StructField("signup_date", T.DateType()),
    T.StructField("watch_hours", T.DoubleType()),
    T.StructField("churn_status", T.StringType()),
])

SUBSCRIPTION_PLANS = T.StructType([
    T.StructField("plan_id", T.StringType()),
    T.StructField("subscription_type", T.StringType()),
    T.StructField("monthly_price_usd", T.DecimalType(6, 2)),
    T.StructField("max_streams", T.IntegerType()),
    T.StructField("resolution", T.StringType()),
])

CONTENT_LIBRARY = T.StructType([
    T.StructField("content_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("genre", T.StringType()),
    T.StructField("release_year", T.IntegerType()),
    T.StructField("imdb_rating", T.DecimalType(3, 1)),
    T.StructField("duration", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("original_flag", T.StringType()),
    T.StructField("release_date", T.DateType()),
])

WATCH_HISTORY = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("content_id", T.StringType()),
    T.StructField("watch_time", T.TimestampNTZType()),
    T.StructField("completion_rate", T.DecimalType(10, 6)),
    T.StructField("device_type", T.StringType()),
    T.StructField("watch_duration", T.DecimalType(18, 2)),
])

REVIEWS = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("content_id", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("review_date", T.DateType()),
])

DEVICES = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("os", T.StringType()),
    T.StructField("last_active_date", T.DateType()),
])

CANONICAL = {
    "users": USERS,
    "subscription_plans": SUBSCRIPTION_PLANS,
    "content_library": CONTENT_LIBRARY,
    "watch_history": WATCH_HISTORY,
    "reviews": REVIEWS,
    "devices": DEVICES,
}

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for the same results)
# ---------------------------------------------------------------------------

# Subscription plans: plan id, type, monthly price USD, max streams, resolution.
PLAN_ROWS = [
    ("P_BASIC", "Basic", Decimal("7.99"), 1, "HD"),
    ("P_STANDARD", "Standard", Decimal("12.99"), 2, "Full HD"),
    ("P_PREMIUM", "Premium", Decimal("18.99"), 4, "4K Ultra HD"),
    ("P_MOBILE", "Mobile", Decimal("4.99"), 1, "Mobile HD"),
]

# Viewer segment names, from the lowest to the highest mean watch minutes.
SEGMENT_NAMES = [
    "At-Risk Low Engagement",
    "Casual Browsers",
    "Genre Explorers",
    "Premium Loyalists",
    "Global Bingers",
]

# Engagement score weights: (hours, viewers or active users, completion, completion scale).
# Query/measure form: .45 hours + .25 viewers + .30 * 1000 * completion.
ENGAGEMENT_QUERY_WEIGHTS = (0.45, 0.25, 0.30, 1000.0)
# Genre mart form: .45 hours + .35 * 10000 * completion + .20 active users.
ENGAGEMENT_MART_WEIGHTS = (0.45, 0.20, 0.35, 10000.0)

# Binge day: at least this many sessions or minutes per user, device and day.
BINGE_MIN_SESSIONS = 3
BINGE_MIN_MINUTES = 180

# Duration buckets (minutes, upper bounds exclusive) and their labels.
DURATION_BUCKETS = [(30, "<30m"), (60, "30-59m"), (100, "60-99m")]
DURATION_TOP_LABEL = "100m+"

# Query thresholds.
LOW_COMPLETION_MIN_SESSIONS = 100
LOW_COMPLETION_MAX_RATE = 0.55
UPGRADE_PLANS = ("Basic", "Standard")
UPGRADE_PERCENTILE = 0.8
ENGAGEMENT_DROP_FACTOR = Decimal("0.4")
RAMP_MAX_DAYS = 60
HIGH_IMDB = Decimal("8.0")
DISCOVERY_PERCENTILE = 0.25
COWATCH_MIN_PAIRS = 20
POSITIVE_RATING = 4
NEGATIVE_RATING = 2
RETENTION_COMPLETION = Decimal("0.8")

# Churn model: random forest and split settings.
RF_TREES = 160
RF_MAX_DEPTH = 10
RF_MIN_LEAF = 12
TEST_FRACTION = 0.25
SEED = 42
KMEANS_K = 5
KMEANS_RESTARTS = 10
KMEANS_MAX_ITER = 300
# Bins per feature of the forest, from quantiles of all training rows.
RF_MAX_BINS = 32
FORECAST_MONTHS = 6

SEGMENT_FEATURES = [
    "total_watch_minutes", "sessions", "avg_completion", "unique_genres",
    "weekend_share", "mobile_share", "revenue",
]
CHURN_FEATURES = SEGMENT_FEATURES + [
    "Age", "Subscription_Type_Mobile", "Subscription_Type_Premium", "Subscription_Type_Standard",
]
