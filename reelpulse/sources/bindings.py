"""Bind the driver's test tables to the canonical star schema.

The expressions follow FIXTURES.md §3-§4.  Everything is lazy DataFrame code:
Catalyst prunes the columns each query needs and pushes filters into the
parquet scans, so a query that reads only ``watch_duration`` never touches
``l_discount``.

Two session bindings exist:

* **S** (:func:`sessions`) - one session per lineitem, joined to its order for the
  viewer and device.  The lineitem/orders join is a sort-merge join on the order
  key at scale (both sides shuffle once; bucketing both tables on the order key
  removes that shuffle).
* **E** (:func:`event_sessions`) - one session per event, with real clock times.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .tables import app_id, read_table

# Fixed value maps of the binding (FIXTURES.md §3-§4).
SEGMENT_TO_PLAN = [
    ("AUTOMOBILE", "Basic"),
    ("BUILDING", "Standard"),
    ("MACHINERY", "Standard"),
    ("FURNITURE", "Premium"),
    ("HOUSEHOLD", "Mobile"),
]
PRIORITY_TO_DEVICE = [
    ("1-URGENT", "Smart TV"),
    ("2-HIGH", "Mobile"),
    ("3-MEDIUM", "Tablet"),
    ("4-NOT SPECIFIED", "Desktop"),
    ("5-LOW", "Game Console"),
]
EVENT_TO_DEVICE = [
    ("view", "Smart TV"),
    ("click", "Mobile"),
    ("purchase", "Tablet"),
    ("signup", "Desktop"),
    ("error", "Game Console"),
]
CHURN_CUTOFF = "2000-08-01 00:00:00"
RELEASE_EPOCH = "1995-01-01"
CHURN_STATES = ("Active", "Churned")              # last order on/after the cutoff, otherwise
CONTENT_TYPES = ("Movie", "TV Show")              # p_size >= 26, otherwise
ORIGINAL_FLAGS = ("Netflix Original", "Licensed")  # p_partkey % 5 < 2, otherwise


def _recode(col: Column, pairs) -> Column:
    expr = None
    for src, dst in pairs:
        expr = F.when(col == src, dst) if expr is None else expr.when(col == src, dst)
    return expr


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer + nation, with first/last order per customer for signup and churn."""
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Partial aggregation per customer before the shuffle: one row per customer leaves each task.
    span = (read_table(spark, sf_dir, "orders")
            .groupBy("o_custkey")
            .agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order")))
    cutoff = F.lit(CHURN_CUTOFF).cast("timestamp_ntz")
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .join(span, cust.c_custkey == span.o_custkey, "left")
            .select(
                F.col("c_custkey").alias("user_id"),
                (F.lit(16) + F.col("c_custkey") % 60).cast("int").alias("age"),
                F.col("n_name").alias("country"),
                _recode(F.col("c_mktsegment"), SEGMENT_TO_PLAN).alias("subscription_type"),
                F.to_date("first_order").alias("signup_date"),
                F.col("c_acctbal").cast("double").alias("watch_hours"),
                F.when(F.col("last_order") >= cutoff, CHURN_STATES[0]).otherwise(CHURN_STATES[1])
                .alias("churn_status"),
            ))


_PLANS: dict[str, DataFrame] = {}


def subscription_plans(spark: SparkSession) -> DataFrame:
    """The four plans (fixed size; safe to broadcast), as a JVM-side literal relation."""
    app = app_id(spark)
    if app not in _PLANS:
        _PLANS[app] = _plans_relation(spark)
    return _PLANS[app]


def _plans_relation(spark: SparkSession) -> DataFrame:
    rows = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, S.SUBSCRIPTION_PLANS.fields)])
            for row in S.PLAN_ROWS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def content_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    return part.select(
        k.alias("content_id"),
        F.concat(F.col("p_name"), F.lit(" #"), k.cast("string")).alias("title"),
        F.when(F.col("p_size") >= 26, CONTENT_TYPES[0]).otherwise(CONTENT_TYPES[1]).alias("content_type"),
        F.col("p_brand").alias("genre"),
        (F.lit(1995) + F.col("p_size") % 32).cast("int").alias("release_year"),
        (F.expr("CAST(3.5 AS DECIMAL(3,1))") + (k % 64).cast("decimal(4,0)") * F.expr("CAST(0.1 AS DECIMAL(2,1))"))
        .cast("decimal(3,1)").alias("imdb_rating"),
        (F.col("p_size") * 3).cast("int").alias("duration"),
        F.col("p_type").alias("language"),
        F.when(k % 5 < 2, ORIGINAL_FLAGS[0]).otherwise(ORIGINAL_FLAGS[1]).alias("original_flag"),
        F.date_add(F.lit(RELEASE_EPOCH).cast("date"), ((k * 13) % 1460).cast("int")).alias("release_date"),
    )


def _lineitem_sessions(spark: SparkSession, sf_dir: str, returned_only: bool = False) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    if returned_only:
        li = li.filter(F.col("l_returnflag") == "R")
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax",
                   "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey)
    session_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                             F.col("l_partkey").cast("string"), F.to_date("l_shipdate").cast("string"))
    return joined.withColumn("session_id", session_id)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding S: watch_history from lineitem x orders."""
    j = _lineitem_sessions(spark, sf_dir)
    return j.select(
        F.col("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("content_id"),
        F.col("l_shipdate").alias("watch_time"),
        (F.col("l_discount").cast("decimal(4,2)") * 10).cast("decimal(4,2)").alias("completion_rate"),
        _recode(F.col("o_orderpriority"), PRIORITY_TO_DEVICE).alias("device_type"),
        F.col("l_quantity").cast("decimal(18,2)").alias("watch_duration"),
    )


def bind_events(ev: DataFrame) -> DataFrame:
    """Map an ``events``-shaped DataFrame (batch or streaming) to watch_history columns."""
    return ev.select(
        F.col("event_id").cast("string").alias("session_id"),
        F.col("user_id"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("content_id"),
        F.col("ts").alias("watch_time"),
        F.lit(None).cast("decimal(4,2)").alias("completion_rate"),
        _recode(F.col("event_type"), EVENT_TO_DEVICE).alias("device_type"),
        F.col("value").cast("decimal(18,2)").alias("watch_duration"),
    )


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding E: watch_history from events (clock times over all 24 hours)."""
    return bind_events(read_table(spark, sf_dir, "events"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews: returned lineitems; rating 1..5 from the tax rate."""
    j = _lineitem_sessions(spark, sf_dir, returned_only=True)
    return j.select(
        F.col("session_id").alias("review_id"),
        F.col("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("content_id"),
        (F.lit(1) + F.floor(F.round(F.col("l_tax") * 100) / 2)).cast("int").alias("rating"),
        F.to_date("l_shipdate").alias("review_date"),
    )


def device_observations(watch: DataFrame) -> DataFrame:
    """Raw device sightings, one per session (input of the device dedup, P18)."""
    return watch.select(
        F.col("session_id").alias("device_id"), "user_id", "device_type",
        F.to_date("watch_time").alias("last_active_date"))


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, device type) with the latest watch date."""
    return (device_observations(sessions(spark, sf_dir))
            .groupBy("user_id", "device_type")
            .agg(F.min("device_id").alias("device_id"), F.max("last_active_date").alias("last_active_date"))
            .select("device_id", "user_id", "device_type", "last_active_date"))


@dataclass
class Star:
    """The canonical tables of one dataset, built lazily on first access."""

    spark: SparkSession
    sf_dir: str
    binding: str = "S"
    _cache: dict = field(default_factory=dict)

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def users(self) -> DataFrame:
        return self._get("users", lambda: users(self.spark, self.sf_dir))

    @property
    def plans(self) -> DataFrame:
        return self._get("plans", lambda: subscription_plans(self.spark))

    @property
    def content(self) -> DataFrame:
        return self._get("content", lambda: content_library(self.spark, self.sf_dir))

    @property
    def watch(self) -> DataFrame:
        build = sessions if self.binding == "S" else event_sessions
        return self._get("watch", lambda: build(self.spark, self.sf_dir))

    @property
    def reviews(self) -> DataFrame:
        return self._get("reviews", lambda: reviews(self.spark, self.sf_dir))

    @property
    def devices(self) -> DataFrame:
        return self._get("devices", lambda: devices(self.spark, self.sf_dir))

    def register_views(self, prefix: str = "") -> list[str]:
        """Expose the canonical tables as temporary views for ``spark.sql``.

        Views are lazy plans over the same bindings, so SQL over them gets the same
        pruning and pushdown as the DataFrame operators.
        """
        names = {"users": self.users, "subscription_plans": self.plans, "content_library": self.content,
                 "watch_history": self.watch, "reviews": self.reviews, "devices": self.devices}
        for name, df in names.items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + n for n in names]


def load_star(spark: SparkSession, sf_dir: str, binding: str = "S") -> Star:
    if binding not in ("S", "E"):
        raise ValueError("binding must be 'S' (lineitem sessions) or 'E' (event sessions)")
    return Star(spark, sf_dir, binding)


def load_star_tables(spark: SparkSession, database: str = "reelpulse") -> Star:
    """A Star over tables written by :func:`reelpulse.sources.sinks.materialize_star`."""
    t = Star(spark, f"catalog:{database}")
    for attr, table in (("users", "users"), ("plans", "subscription_plans"), ("content", "content_library"),
                        ("watch", "watch_history"), ("reviews", "reviews")):
        t._cache[attr] = spark.table(f"{database}.{table}")
    return t
