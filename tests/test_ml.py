"""Model-driven operators: invariants (no SQL oracle exists for them)."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from conftest import SF_SMALL
from reelpulse import schema as S
from reelpulse.operators import audience as A
from reelpulse.operators import kpi as K
from reelpulse.operators import ml as ML
from reelpulse.operators import recommend as RC
from reelpulse.sources.bindings import load_star


@pytest.fixture(scope="module")
def star(spark):
    return load_star(spark, SF_SMALL)


@pytest.fixture(scope="module")
def features(spark, star):
    return A.user_features(K.enriched_sessions(star.watch, star.users, star.content, star.plans)).cache()


@pytest.fixture(scope="module")
def segments(features):
    return ML.viewer_segments(features, restarts=3).cache()


def test_five_named_segments_each_user_once(segments, features):
    assert segments.count() == features.count() == segments.select("user_id").distinct().count()
    names = {r.viewer_segment for r in segments.select("viewer_segment").distinct().collect()}
    assert names == set(S.SEGMENT_NAMES)


def test_segment_names_follow_mean_minutes(segments):
    means = segments.groupBy("viewer_segment").agg(F.avg("total_watch_minutes").alias("m")).collect()
    ordered = [r.viewer_segment for r in sorted(means, key=lambda r: r.m)]
    assert ordered == S.SEGMENT_NAMES


def test_standardize_population_sd(features):
    z = ML.standardize(features)
    stats = z.agg(F.avg("sessions_z"), F.stddev_pop("sessions_z")).collect()[0]
    assert stats[0] == pytest.approx(0.0, abs=1e-9) and stats[1] == pytest.approx(1.0, rel=1e-9)


def test_stratified_split_is_deterministic_and_stratified(features):
    data = ML.churn_dataset(features)
    a = ML.stratified_split(data).select("user_id", "is_test")
    b = ML.stratified_split(data).select("user_id", "is_test")
    assert sorted(a.collect()) == sorted(b.collect())
    per = ML.stratified_split(data).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int"))
                                                          .alias("t")).collect()
    for r in per:
        assert r.t == -(-r.n * 25 // 100)


def test_churn_feature_order(features):
    assert ML.churn_dataset(features).columns[1:-1] == S.CHURN_FEATURES


def test_auc_rank_sum_equals_evaluator(spark, features):
    _, _, scores = ML.churn_pipeline(features)
    ours = ML.roc_auc(scores).collect()[0][0]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    theirs = ev.evaluate(scores.withColumn("label", F.col("label").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_auc_on_planted_signal(spark):
    rows = [(i, int(i % 3 == 0), float(i % 3 == 0) + (i % 7) / 10.0) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id long, label int, score double")
    assert ML.roc_auc(df).collect()[0][0] > 0.9


def test_recommendations_shape(star, segments):
    enriched = K.enriched_sessions(star.watch, star.users, star.content, star.plans)
    recs = RC.segment_recommendations(enriched, segments, star.content)
    per = recs.groupBy("viewer_segment").count().collect()
    assert len(per) == 5 and all(r["count"] == 10 for r in per)
    one = RC.recommendations_for(recs, S.SEGMENT_NAMES[0]).orderBy(F.desc("imdb_rating")).collect()
    ratings = [r.imdb_rating for r in one]
    assert ratings == sorted(ratings, reverse=True)


def test_run_metrics_row(star, features):
    data, _, scores = ML.churn_pipeline(features)
    row = ML.run_metrics(ML.roc_auc(scores), data, star.watch, star.users, star.content, star.reviews).collect()[0]
    assert row.sessions == star.watch.count() and row.users == star.users.count()
    assert list(row.model_features) == S.CHURN_FEATURES


def test_models_do_not_depend_on_partitions(spark, features):
    """Equal segments and AUC in two runs and for 4 and 7 shuffle partitions."""
    def results():
        segmented = ML.viewer_segments(features, restarts=2).select("user_id", "viewer_segment").collect()
        auc = ML.roc_auc(ML.churn_pipeline(features)[2]).first()[0]
        return sorted((r.user_id, r.viewer_segment) for r in segmented), auc

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        first = results()
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert results() == first
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert results() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_split_of_string_ids(spark):
    rows = [(f"U{100000 + i}", i % 4 == 0) for i in range(203)]
    data = spark.createDataFrame(rows, "user_id string, churned boolean").selectExpr("user_id", "cast(churned as int) label")
    got = ML.stratified_split(data).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t"))
    assert all(r.t == -(-r.n // 4) for r in got.collect())
