"""Plan-shape and skew checks: the scale properties the operators promise."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from helpers import same, spark_rows
from reelpulse import schema as S
from reelpulse.operators import audience as A
from reelpulse.operators import content as C
from reelpulse.operators import kpi, ml, ordered
from reelpulse.operators import pairs as PR
from reelpulse.sources.bindings import load_star, subscription_plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF_SMALL)


def test_scans_are_pruned(star):
    p = plan(C.genre_watch(star.watch, star.content))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_discount:double>" in p


def test_no_unpartitioned_window_over_viewers(spark, monkeypatch):
    """NTILE and percentiles are range-partitioned, never one global window.  Checkpoints are left out here, so
    that the whole plan is seen: every single-partition exchange carries per-partition counts, not viewers."""
    import re
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.checkpoint", lambda self, eager=True: self)
    star = load_star(spark, SF_SMALL)
    for df in (A.frequency_quintiles(star.watch), A.upgrade_candidates(star.watch, star.users),
               C.high_rating_low_discovery(star.watch, star.content)):
        text = plan(df)
        assert "rangepartitioning" in text
        for part in re.split("Exchange SinglePartition", text)[1:]:
            below = next(line for line in part.split("\n")[1:] if line.strip())
            assert "HashAggregate" in below or "_pid" in below, below
        assert "ntile(" not in text.lower() and "percentile_cont(" not in text.lower()


def test_percentile_and_filter_share_one_scan(spark):
    """What Q18 and Q31 return reads the checkpointed aggregate, not the session table again."""
    star = load_star(spark, SF_SMALL)
    for df in (A.upgrade_candidates(star.watch, star.users), C.high_rating_low_discovery(star.watch, star.content)):
        assert "l_quantity" not in plan(df) and "l_partkey" not in plan(df)


def test_cowatch_has_no_window_over_a_viewer(star):
    """In a session with default settings, whatever the skew settings are."""
    assert "Window" not in plan(PR.cowatch_pairs(star.watch))


def test_distinct_measures_do_not_expand(spark, star):
    import __spark_entry__ as E
    for name in ("m07_premium_adoption", "m09_completion_retention_rate"):
        assert "Expand" not in plan(E.queries()[name](spark, SF_SMALL))


def test_top_titles_cut_is_defined_for_equal_titles(spark):
    """Titles of equal name and minutes are cut by type and genre."""
    at = dt.datetime(2024, 1, 1)
    w = spark.createDataFrame([(f"s{i}", f"u{i}", f"c{i}", at, D("0.5"), "Mobile", D("10")) for i in range(4)],
                              S.WATCH_HISTORY)
    kinds = [("TV Show", "B"), ("Movie", "Z"), ("TV Show", "A"), ("Movie", "C")]
    c = spark.createDataFrame([(f"c{i}", "Same", kind, genre, 2020, D("7.0"), 60, "English", "Licensed",
                                dt.date(2020, 1, 1)) for i, (kind, genre) in enumerate(kinds)], S.CONTENT_LIBRARY)
    for got in (C.top_titles_ranked(w, c, 3), C.top_titles(w, c, 3)):
        assert sorted((r.content_type, r.genre) for r in got.collect()) == [("Movie", "C"), ("Movie", "Z"), ("TV Show", "A")]


def test_per_viewer_results_are_aggregates_not_windows(star):
    for df in (A.last_genre_before_churn(star.watch, star.users, star.content),
               C.rewatch_rate(star.watch, star.content)):
        p = plan(df)
        assert "Window" not in p and "Aggregate" in p


def test_top_k_per_group_limits_before_the_shuffle(star):
    p = plan(A.top_genres_per_country(star.watch, star.users, star.content))
    assert "WindowGroupLimit" in p


def _skewed_watch(spark, n=3000):
    """Viewer 0 holds a third of all sessions."""
    rows = []
    for i in range(n):
        uid = 0 if i % 3 == 0 else 1 + i % 97
        rows.append((f"s{i}", uid, i % 41, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i),
                     D("0.50"), "Mobile", D(str(10 + i % 7))))
    return spark.createDataFrame(rows, S.WATCH_HISTORY)


def test_cowatch_with_a_hot_viewer(spark):
    w = _skewed_watch(spark)
    a, b = w.alias("a"), w.alias("b")
    plain = (a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.content_id") < F.col("b.content_id")))
             .groupBy(F.col("a.content_id").alias("content_a"), F.col("b.content_id").alias("content_b"))
             .agg(F.count(F.lit(1)).alias("shared_viewers")).filter("shared_viewers >= 5"))
    sliced = PR.cowatch_pairs(w, 5, titles_per_slice=4)        # the hot viewer's 41 titles -> 11 slices
    assert same(spark_rows(sliced), spark_rows(plain))


def test_hot_value_ntile_and_percentile(spark):
    """A third of the rows share one sort value; results equal the SQL definitions."""
    import duckdb
    import pandas as pd
    vals = [5.0] * 400 + [float(i % 50) for i in range(800)]
    pdf = pd.DataFrame({"k": range(len(vals)), "x": vals})
    df = spark.createDataFrame(pdf)
    got = ordered.ntile(df, ["x", "k"], 5, "t", num_partitions=6).toPandas().sort_values("k")
    want = duckdb.sql("SELECT k, NTILE(5) OVER (ORDER BY x, k) AS t FROM pdf ORDER BY k").df()
    assert got["t"].tolist() == want["t"].tolist()
    p = ordered.percentile_cont(df, "x", 0.8, key=["k"], num_partitions=6).collect()[0][0]
    assert p == pytest.approx(duckdb.sql("SELECT quantile_cont(x, 0.8) FROM pdf").fetchall()[0][0])


def test_bucketed_star_joins_without_shuffling_the_fact(spark):
    from helpers import duck, duck_rows
    import __spark_entry__ as E
    from reelpulse.sources import sinks
    from reelpulse.sources.bindings import load_star_tables
    from reelpulse.operators import kpi as K
    sinks.materialize_star(spark, SF_SMALL, database="rp_test", buckets=4)
    t = load_star_tables(spark, "rp_test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # force the sort-merge path
    try:
        df = A.country_engagement(t.watch, t.users)
        p = df._jdf.queryExecution().executedPlan().toString()
        join_part = p[p.index("SortMergeJoin"):]
        assert "Exchange hashpartitioning(user_id" not in join_part
        got = spark_rows(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = duck_rows(duck(SF_SMALL), E.oracle_sql()["q11_country_engagement"])
    assert same(got, want)
    assert same(spark_rows(K.executive_kpis(t.watch, t.users, t.plans)),
                duck_rows(duck(SF_SMALL), E.oracle_sql()["q01_executive_kpis"]))


def test_hot_viewer_join_is_sliced(spark):
    """One viewer owns a third of the sessions.  Viewer aggregates (Q11) meet users as
    one row per viewer; the row-level session join (P02) slices the viewer's sessions
    itself, whatever AQE is set to.  Results are unchanged."""
    import datetime as dt2
    from reelpulse.operators import kpi as K
    from reelpulse.sources.bindings import subscription_plans
    rows = [(f"s{i}", 0 if i % 3 == 0 else i % 500, i % 50, dt2.datetime(2024, 1, 1), D("0.50"), "Mobile",
             D("10.00")) for i in range(30000)]
    w = spark.createDataFrame(rows, S.WATCH_HISTORY).repartition(8)
    u = spark.createDataFrame([(i, 30, f"C{i % 7}", "Basic", dt.date(2024, 1, 1), 1.0, "Active") for i in range(500)],
                              S.USERS)
    c = spark.createDataFrame([(i, f"T{i}", "Movie", f"G{i % 5}", 2024, D("8.0"), 90, "English", "Licensed",
                                dt.date(2024, 1, 1)) for i in range(50)], S.CONTENT_LIBRARY)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {r.country: (r.viewers, r.sessions) for r in A.country_engagement(w, u).collect()}
        mart = K.enriched_sessions(w, u, c, subscription_plans(spark)).groupBy("country").count()
        counts = {r.country: r["count"] for r in mart.collect()}
        p = mart._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # The hot viewer is sliced before the shuffle, so there is nothing left for the adaptive planner to split.
    assert "SortMergeJoin" in p and "_slot" in p and "skew=true" not in p
    want = {}
    for _, uid, *_ in rows:
        want.setdefault(f"C{uid % 7}", set()).add(uid)
    assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert sum(v[1] for v in got.values()) == 30000 == sum(counts.values())
    assert got["C0"][1] == counts["C0"] >= 10000


def _star_with_repeated_viewers(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    watch = table([(f"s{i}", i % 5 if i % 7 else None, i % 4, f"2024-0{1 + i % 3}-1{i % 9} 10:00:00", i, i % 10) for i in range(60)],
                  "session_id string, user_id bigint, content_id bigint, t string, d int, c int").select(
        "session_id", "user_id", "content_id", F.col("t").cast("timestamp_ntz").alias("watch_time"), F.lit("Mobile").alias("device_type"),
        F.col("d").cast("decimal(18,2)").alias("watch_duration"),
        F.when(F.col("c") > 0, F.col("c") / 10).cast("decimal(4,2)").alias("completion_rate"))
    users = table([(0, "Basic"), (1, "Premium"), (1, "Premium"), (1, "Mobile"), (2, "none"), (3, "Standard"), (None, "Basic")],
                  "user_id bigint, subscription_type string")
    content = table([(0, "a", 4.5), (1, "a", None), (1, "b", 3.0), (2, "b", 5.5)], "content_id bigint, genre string, x double").select(
        "content_id", "genre", F.col("x").cast("decimal(3,1)").alias("imdb_rating"))
    return watch, users, content, subscription_plans(spark)


@pytest.mark.parametrize("direct, plain", [(kpi.monthly_kpis_direct, kpi.monthly_kpis),
                                           (C.genre_performance_direct, C.genre_performance)])
def test_rollups_count_viewers_without_a_distinct(spark, direct, plain):
    """One row per viewer at the join: no second and third table of (group, viewer) pairs in a task."""
    star = _star_with_repeated_viewers(spark)
    got, want = direct(*star), plain(kpi.enriched_sessions(*star))
    assert "distinct" not in plan(got)
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    assert rows(got) == rows(want)


def test_segmentation_fits_keep_their_own_vectors(spark, monkeypatch):
    """Over a cached table each step of a fit would decode every row again."""
    levels, fit = [], ml.KMeans.fit
    monkeypatch.setattr(ml.KMeans, "fit", lambda self, data: (levels.append(data.storageLevel), fit(self, data))[1])
    cols = ml.S.SEGMENT_FEATURES
    data = spark.range(40).select(F.col("id").alias("user_id"), *[((F.col("id") * (i + 3)) % 17).cast("double").alias(c)
                                                                  for i, c in enumerate(cols)])
    ml.fit_segmentation(data, restarts=2)
    assert len(levels) == 2 and not any(x.useMemory or x.useDisk for x in levels)


def test_filter_lists_shuffle_sessions_once_less(spark, monkeypatch):
    """The (viewer, title) ids of the sessions nearly all differ: the default lists come without making them distinct."""
    from reelpulse.operators import feeds
    made, join = [], feeds.hot_key_join
    monkeypatch.setattr(feeds, "hot_key_join", lambda left, *a, **kw: made.append(left) or join(left, *a, **kw))
    t = load_star(spark, SF_SMALL)
    feeds.filtered_sessions(t.watch, t.users, t.content, t.plans)
    assert len(made) == 2
    assert "Aggregate" not in made[0]._jdf.queryExecution().optimizedPlan().toString()
