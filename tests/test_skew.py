"""Hot-key joins, model layouts, quantile bins and viewer sets: exact results and even tasks in a plain session."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelpulse import schema as S
from reelpulse.operators import binning, ml, skew, viewer_sets
from reelpulse.operators.kpi import enriched_sessions


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def plain(spark):
    """The session with adaptive planning and broadcasts off and 16 partitions."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_side(spark, n=6000):
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 == 0 else None if i % 11 == 0 else rng.randrange(500), f"t{i}") for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, k bigint, text string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("mode", ["found", "none", "given"])
def test_hot_key_join_equals_plain_join(plain, how, mode):
    left = hot_side(plain)
    right = plain.createDataFrame([(k, c) for k in [*range(0, 500, 2), 7, None] for c in ("a", "b")][:-1], "k bigint, v string")
    heavy = {"found": None, "none": [], "given": skew.heavy_keys_of(left, ["k", "id"])["k"]}[mode]
    got = skew.hot_key_join(left, right, "k", how, heavy=heavy)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert rows_of(got) == rows_of(want)


def test_heavy_keys_are_few_and_hot(plain):
    left = hot_side(plain)
    assert [k for k, _ in skew.heavy_keys(left, ["k"])] == [7]
    assert skew.heavy_keys_of(left, ["k", "id"])["id"] == []
    assert skew.heavy_keys(left.limit(0), ["k"]) == [] and skew.heavy_keys_of(left.limit(0), ["k"]) == {"k": []}


def test_heavy_keys_of_shuffles_no_counts(plain):
    """The same keys and slices as from exact counts, among more other values than a summary keeps, from one record a
    task: nulls are no key, and a key just at a mean partition is found."""
    n = 40_000
    left = plain.range(n).selectExpr("if(id % 3 = 0, 7, if(id % 11 = 0, null, id)) as k", "concat('U', id % 16 * (id % 5)) as t",
                                     f"if(id < {n // 16}, -5, id) as c").repartition(3).persist()
    got = skew.heavy_keys_of(left, ["k", "t", "c"])
    for key in got:
        assert sorted(got[key]) == sorted((str(k), slices) for k, slices in skew.heavy_keys(left, [key])), key
    assert [k for k, _ in got["k"]] == ["7"] and [k for k, _ in got["c"]] == ["-5"]
    ran = []
    frame = type(left)
    first = frame.first
    try:
        frame.first = lambda self: ran.append(self._jdf.queryExecution().executedPlan().toString()) or first(self)
        skew.heavy_keys_of(left, ["k", "c"])
    finally:
        frame.first = first
    left.unpersist()
    assert len(ran) == 1 and "hashpartitioning" not in ran[0]


def test_hot_key_join_spreads_the_hot_key(plain):
    """A key with a third of the rows: the largest task of a plain join has them all, of a sliced one far fewer."""
    left, right = hot_side(plain), plain.range(500).withColumnRenamed("id", "k")

    def largest(df):
        return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    assert largest(left.join(right.hint("merge"), "k", "left")) >= 2000
    assert largest(skew.hot_key_join(left, right.hint("merge"), "k", "left")) < 1000


def test_session_mart_slices_a_hot_viewer(plain):
    """P02 without adaptive settings, one viewer with a third of the sessions."""
    n = 3000
    watch = plain.createDataFrame([(f"s{i}", 1 if i % 3 == 0 else i % 97, i % 50) for i in range(n)],
                                  "session_id string, user_id bigint, content_id bigint")
    watch = watch.withColumn("watch_time", F.timestamp_ntz_from_unix(F.lit(0)) if hasattr(F, "timestamp_ntz_from_unix")
                             else F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    users = plain.range(1, 97).selectExpr("id as user_id", "'Basic' as subscription_type")
    content = plain.range(50).selectExpr("id as content_id", "'x' as title")
    plans = plain.createDataFrame([("Basic", 7.99)], "subscription_type string, monthly_price_usd double")
    got = enriched_sessions(watch, users, content, plans)
    assert got.count() == watch.join(users, "user_id").count()
    per_task = got.select("session_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < n / 3
    assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_layout_partitions_follow_users_alone(spark):
    counts = [ml.layout_partitions(n, ml.FOREST_USERS) for n in (0, 1, 1_000, 15_000, 1_000_000, 10**9)]
    assert counts == sorted(counts) and counts[0] == 1 and counts[-1] > 10_000
    df = spark.range(3500).withColumnRenamed("id", "user_id")
    want = ml.layout_partitions(3500, ml.FOREST_USERS)
    assert want > 1
    for n in ("4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            laid = ml.fixed_layout(df.repartition(int(n)), ml.FOREST_USERS)
            assert laid.rdd.getNumPartitions() == want
            placed = sorted((r.user_id, r.p) for r in laid.withColumn("p", F.spark_partition_id()).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert placed == sorted((r.user_id, r.p) for r in ml.fixed_layout(df, ml.FOREST_USERS)
                                .withColumn("p", F.spark_partition_id()).collect())


def test_forest_partitions_wait_for_full_ones(spark, monkeypatch):
    """Every partition sends all node statistics of a level: few of them until each has users enough, then by users."""
    def parts(n):
        return ml.layout_partitions(n, ml.FOREST_USERS, ml.FOREST_FEW, ml.FOREST_FULL)

    assert [parts(n) for n in (0, 1_000, 10_000)] == [ml.layout_partitions(n, ml.FOREST_USERS) for n in (0, 1_000, 10_000)]
    assert parts(100_000) == parts(1_000_000) == ml.FOREST_FEW
    assert parts(10**8) == -(-10**8 // ml.FOREST_FULL) < ml.layout_partitions(10**8, ml.FOREST_USERS)
    monkeypatch.setattr(ml, "FOREST_FEW", 2)
    users = spark.range(6000).selectExpr("id as user_id", *[f"cast(id % {7 + i} as double) as {c}"
                                                            for i, c in enumerate(S.SEGMENT_FEATURES)],
                                         "cast(id % 60 as int) as age", "'Basic' as subscription_type",
                                         "if(id % 3 = 0, 'Churned', 'Active') as churn_status")
    monkeypatch.setattr(S, "RF_TREES", 2)
    data, (_, forest), scores = ml.churn_pipeline(users)
    assert data.rdd.getNumPartitions() == 2 and data.count() == 6000 and scores.count() == 1500
    assert forest.getOrDefault("cacheNodeIds")


def test_split_computes_its_input_once(spark):
    """What the split returns reads the checkpointed positions alone, not its input again for the counts."""
    seen = spark.sparkContext.accumulator(0)

    def noted(rows):
        for r in rows:
            seen.add(1)
            yield r

    data = spark.createDataFrame(spark.range(400).selectExpr("id as user_id", "cast(id % 4 = 0 as int) as label")
                                 .rdd.mapPartitions(noted), "user_id bigint, label int").repartition(3, "user_id")
    split = ml.stratified_split(data)
    built = seen.value
    assert split.filter("is_test").count() == 100 and seen.value == built


def test_quantile_edges_equal_for_any_layout_and_merge(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 50), float(rng.randrange(4)), rng.random() ** 6, 5.0) for _ in range(4000)]
    rows += [(None, 0.0, float("nan"), 5.0), (float("inf"), 1.0, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    edges = binning.edges_of(binning.quantile_summary(df, cols), 32)
    for parts in (1, 3, 11):
        assert binning.edges_of(binning.quantile_summary(df.repartition(parts), cols), 32) == edges
    halves = [binning.quantile_summary(df.filter(c), cols) for c in (F.col("b") < 2, F.col("b") >= 2)]
    assert binning.edges_of(binning.merged(*halves), 32) == edges
    assert edges["b"] == [1.0, 2.0, 3.0] and "d" not in edges
    values = np.sort([r[0] for r in rows if r[0] is not None and np.isfinite(r[0])])
    want = [values[-(-i * len(values) // 32)] for i in range(1, 32)]
    assert len(edges["a"]) == 31 and np.allclose(edges["a"], want, rtol=2 / binning.GRID)


def test_bins_are_ordered_numbers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "a double")
    bins = binning.binner({"a": [25.0, 50.0, 75.0]}, ["a"], "_bin")
    got = bins.transform(df)
    assert "ml_attr" not in got.schema["a_bin"].metadata
    assert [r.n for r in got.groupBy("a_bin").agg(F.count("*").alias("n")).orderBy("a_bin").collect()] == [25, 25, 25, 25, 1]
    assert binning.binner({}, ["a"], "_bin").transform(df).select("a_bin").distinct().count() == 2


def test_viewer_sets_answer_any_context(spark):
    rng = random.Random(9)
    watch = [(f"s{i}", None if i % 50 == 0 else f"U{rng.randrange(300)}", rng.randrange(45), f"2024-01-{1 + i % 28:02d} 10:00:00",
              rng.choice(["TV", "Phone", None]), None if i % 17 == 0 else rng.randrange(101), rng.randrange(1, 90)) for i in range(4000)]
    users = [(f"U{i}", rng.choice(["A", "B", None]), rng.choice(["Basic", "Premium"])) for i in range(250)]
    titles = [(i, rng.choice(["g1", "g2"]), rng.choice(["en", "de"])) for i in range(40)]
    w = spark.createDataFrame(watch, "session_id string, user_id string, content_id bigint, t string, device_type string, c int, m int")
    w = w.selectExpr("session_id", "user_id", "content_id", "cast(t as timestamp_ntz) as watch_time", "device_type",
                     "cast(c / 100.0 as decimal(4,2)) as completion_rate", "cast(m as decimal(18,2)) as watch_duration")
    parts = viewer_sets.session_partials(w, spark.createDataFrame(users, "user_id string, country string, subscription_type string"),
                                         spark.createDataFrame(titles, "content_id bigint, genre string, language string")).cache()
    country, genre = {u[0]: u[1] for u in users}, {t[0]: t[1] for t in titles}
    for by, key in ((["country"], lambda r: (country.get(r[1]),)), (["genre", "device_type"], lambda r: (genre.get(r[2]), r[4])), ([], lambda r: ())):
        want = {}
        for r in watch:
            seen, kept = want.setdefault(key(r), (set(), set()))
            seen.add(r[1])
            if r[5] is not None and r[5] / 100 >= S.RETENTION_COMPLETION:
                kept.add(r[1])
        got = {tuple(r[c] for c in by): r for r in viewer_sets.session_measures(parts, by).collect()}
        assert set(got) == set(want)
        for k, (seen, kept) in want.items():
            assert got[k].active_users == len(seen - {None})
            assert got[k].completion_retention_rate == pytest.approx(len(kept - {None}) / len(seen - {None}))
    only = viewer_sets.session_measures(parts, ["device_type"], F.col("genre") == "g1")
    assert sum(r.sessions for r in only.collect()) == sum(genre.get(r[2]) == "g1" for r in watch)
