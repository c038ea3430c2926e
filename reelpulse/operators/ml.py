"""Viewer segmentation and churn model (P08-P14, P19, F02, F10) on Spark MLlib.

Training and scoring are distributed MLlib jobs; the driver only sees model
parameters and the k segment means.  Population-sd z-scores are computed with
aggregates (MLlib's StandardScaler uses the sample sd) so the scaled values are
the reference's; the clustering problem is the same either way.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import exprs as X
from ..session import checkpoint_dir
from . import binning, ordered


# MLlib's seeded sampling depends on the layout of its input, so the layout must follow the data alone, not the
# cluster.  A clustering step does little per user, a forest of RF_TREES trees a hundred times more.
CLUSTER_USERS = 20_000
FOREST_USERS = 1_000
#: Partitions grow a little slower than the users, so that very many of them still mean tasks worth starting.
LAYOUT_GROWTH = 0.75
#: In each level of a forest every partition sends the statistics of all its nodes, some 80,000 of 2 to 3 KB for RF_TREES
#: trees of RF_MAX_DEPTH, however few users it has.  So the partitions stop growing at FOREST_FEW until each holds
#: FOREST_FULL users, whose own work is about that of the statistics, and then follow the users.
FOREST_FEW = 24
FOREST_FULL = 65_536


def layout_partitions(users: int, users_each: int, few: int | None = None, full: int | None = None) -> int:
    """Partitions of a model input: (users / users_each) ** LAYOUT_GROWTH, rounded up; with ``few`` and ``full`` no more
    than ``few`` before each holds ``full`` users.  For a billion users that is 3,344 for the clustering (about 300,000
    users each) and 15,259 for the forest (65,536 each)."""
    grown = math.ceil((users / users_each) ** LAYOUT_GROWTH)
    if few and full:
        grown = max(min(grown, few), math.ceil(users / full))
    return max(1, grown)


def fixed_layout(df: DataFrame, users_each: int, few: int | None = None, full: int | None = None) -> DataFrame:
    """``df`` checkpointed in a layout that depends on its rows alone: hashed by user into
    :func:`layout_partitions` partitions and sorted in them, so that seeded fits see the same rows in the same places
    in every run and on every cluster.  The rows are materialized once to be counted and once in their layout."""
    checkpoint_dir(df.sparkSession)
    rows = df.checkpoint(eager=True)
    return (rows.repartition(layout_partitions(rows.count(), users_each, few, full), "user_id")
            .sortWithinPartitions("user_id").checkpoint(eager=True))


def standardize(features: DataFrame, cols=S.SEGMENT_FEATURES, suffix: str = "_z") -> DataFrame:
    """(x - mean) / population sd per column; 0 where the sd is 0.

    Fit/transform, as MLlib's scalers do: the per-user features are laid out by
    :func:`fixed_layout`, one aggregate over that copy gives the 2 x len(cols) statistics (a single row of numbers to the driver), and the transform is a
    projection with those numbers as literals.  The fact table is scanned once.
    """
    base = fixed_layout(features, CLUSTER_USERS)
    st = base.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                  *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    z = []
    for c in cols:
        mean, sd = st[f"m_{c}"], st[f"s_{c}"]
        if mean is None or not sd:
            z.append(F.lit(0.0).alias(c + suffix))
        else:
            z.append(F.coalesce((F.col(c) - F.lit(mean)) / F.lit(sd), F.lit(0.0)).alias(c + suffix))
    return base.select("*", *z)


def fit_segmentation(features: DataFrame, k: int = S.KMEANS_K, restarts: int = S.KMEANS_RESTARTS,
                     seed: int = S.SEED, max_iter: int = S.KMEANS_MAX_ITER, parallelism: int = S.KMEANS_RESTARTS):
    """P09 fit: k-means on the standardized features; the restart with the lowest cost wins.

    Returns ``(model, data)`` where ``data`` is the features with the assembled
    vector.  The features are checkpointed by :func:`standardize`, so the
    restarts and the final assignment read one materialized copy.  It is not
    cached: then each fit keeps its own vectors, ready for the steps, while over
    a cached table it would decode every row again in each step.
    Restarts are independent Spark jobs submitted concurrently, up to ``parallelism``
    at a time, but no more than fill the cluster twice, or two: a step of few users has few tasks,
    and with many users no more than two fits keep their vectors at a time.
    """
    scaled = standardize(features)
    vec = VectorAssembler(inputCols=[c + "_z" for c in S.SEGMENT_FEATURES], outputCol="_features")
    data = vec.transform(scaled).drop(*[c + "_z" for c in S.SEGMENT_FEATURES])
    tasks = data.rdd.getNumPartitions()
    parallelism = min(parallelism, restarts, max(2, math.ceil(2 * data.sparkSession.sparkContext.defaultParallelism / max(1, tasks))))

    def fit(i):
        model = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="_features",
                       predictionCol="viewer_segment_id").fit(data)
        return model.summary.trainingCost, i, model

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fits = list(pool.map(fit, range(restarts)))
    return min(fits, key=lambda x: (x[0], x[1]))[2], data


def cluster_viewers(features: DataFrame, **kw) -> DataFrame:
    """Features with their cluster id."""
    model, data = fit_segmentation(features, **kw)
    return (model.transform(data).drop("_features")
            .withColumn("viewer_segment_id", F.col("viewer_segment_id").cast("int")))


def name_segments(segmented: DataFrame) -> DataFrame:
    """P10: order clusters by mean minutes and give them the fixed names, lowest first."""
    means = segmented.groupBy("viewer_segment_id").agg(F.avg("total_watch_minutes").alias("_m"))
    names = F.array(*[F.lit(n) for n in S.SEGMENT_NAMES])
    order = F.row_number().over(Window.orderBy("_m", "viewer_segment_id"))
    labels = means.select("viewer_segment_id", F.element_at(names, order.cast("int")).alias("viewer_segment"))
    # k rows: a fixed, tiny table.
    return segmented.join(F.broadcast(labels), "viewer_segment_id")


def viewer_segments(features: DataFrame, **kw) -> DataFrame:
    return name_segments(cluster_viewers(features, **kw))


def churn_dataset(features: DataFrame) -> DataFrame:
    """Model features in the reference's order; label 1 = Churned.

    The plan one-hot drops the first level (Basic) and keeps Mobile, Premium, Standard.
    """
    plan = F.col("subscription_type")
    return features.select(
        "user_id",
        *[F.col(c).cast("double").alias(c) for c in S.SEGMENT_FEATURES],
        F.col("age").cast("double").alias("Age"),
        (plan == "Mobile").cast("double").alias("Subscription_Type_Mobile"),
        (plan == "Premium").cast("double").alias("Subscription_Type_Premium"),
        (plan == "Standard").cast("double").alias("Subscription_Type_Standard"),
        (F.col("churn_status") == "Churned").cast("int").alias("label"))


_HASH_MOD = 2147483648          # 2^31
_HASH_MUL = 2654435761          # Knuth's multiplicative constant


def seeded_order(user_id: str, seed: int, integer_ids: bool = True):
    """A seeded shuffle key: ((id mod 2^31) * 2654435761 + seed) mod 2^31.

    Plain integer arithmetic that stays inside BIGINT, so any SQL engine computes
    the same key (the split has an independent SQL oracle).  String ids enter by
    their CRC-32; the order's tail is the id itself, so collisions only tie the key.
    """
    number = F.col(user_id) if integer_ids else F.crc32(F.col(user_id).cast("binary"))
    return F.pmod(F.pmod(number, F.lit(_HASH_MOD)) * F.lit(_HASH_MUL) + F.lit(seed), F.lit(_HASH_MOD))


def stratified_split(data: DataFrame, test_fraction: float = S.TEST_FRACTION, seed: int = S.SEED) -> DataFrame:
    """Deterministic stratified split; adds ``is_test``.

    Within each label rows are ordered by a seeded shuffle key of the user id;
    the first ceil(test_fraction * n_label) of each label are the test rows.  The
    order is a range-partitioned position, not a window per label.
    """
    integer_ids = not isinstance(data.schema["user_id"].dataType, T.StringType)
    keyed = data.withColumn("_h", seeded_order("user_id", seed, integer_ids))
    pos = ordered.with_position(keyed, ["label", "_h", "user_id"], "_pos")
    # Counted over the positions, which are checkpointed: ``data`` is computed once.
    per_label = pos.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    bounds = per_label.select("label", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per label value: a fixed, tiny table.
    out = pos.join(F.broadcast(bounds), "label")
    n_test = F.ceil(F.col("_n") * test_fraction)
    return out.withColumn("is_test", (F.col("_pos") - F.col("_start")) < n_test).drop("_h", "_pos", "_n", "_start")


def train_churn_model(train: DataFrame, seed: int = S.SEED):
    """Random forest, 160 trees, depth 10, at least 12 rows per leaf.

    Split candidates are the quantile edges of all training rows (:mod:`.binning`): the forest sees the bin numbers,
    of which MLlib takes every one as a candidate.  Each row's node in every tree is kept between levels, not sought
    again from the root: the same trees.  Returns (steps from features to the vector of bins, forest).
    """
    edges = binning.edges_of(binning.quantile_summary(train, S.CHURN_FEATURES), S.RF_MAX_BINS)
    bins = binning.binner(edges, S.CHURN_FEATURES, "_bin")
    vec = VectorAssembler(inputCols=[c + "_bin" for c in S.CHURN_FEATURES], outputCol="_features")
    rf = RandomForestClassifier(numTrees=S.RF_TREES, maxDepth=S.RF_MAX_DEPTH,
                                minInstancesPerNode=S.RF_MIN_LEAF, featureSubsetStrategy="sqrt",
                                maxBins=S.RF_MAX_BINS + 1, cacheNodeIds=True,
                                seed=seed, featuresCol="_features", labelCol="label")
    steps = PipelineModel(stages=[bins, vec])
    return steps, rf.fit(steps.transform(train))


def score(vec, model, data: DataFrame) -> DataFrame:
    """Churn probability per user."""
    scored = model.transform(vec.transform(data))
    return scored.select("user_id", "label", vector_to_array("probability")[1].alias("score"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Exact ROC-AUC by the rank-sum formula, tied scores sharing their mean rank.

    Scores are grouped, ordered by a range-partitioned prefix sum of counts; NULL
    when only one class is present.
    """
    g = scored.groupBy("score").agg(F.count(F.lit(1)).alias("cnt"), F.sum("label").alias("pos"))
    g = ordered.exclusive_prefix_sum(g, ["score"], "cnt", "before")
    mean_rank = F.col("before") + (F.col("cnt") + 1) / 2.0
    sums = g.agg(F.sum(F.col("pos") * mean_rank).alias("rank_sum"),
                 F.sum("pos").cast("double").alias("n_pos"),
                 F.sum("cnt").cast("double").alias("n"))
    n_neg = F.col("n") - F.col("n_pos")
    auc = F.try_divide(F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0,
                       F.nullif(F.col("n_pos") * n_neg, F.lit(0.0)))
    return sums.select(auc.alias("roc_auc"))


def churn_pipeline(features: DataFrame, seed: int = S.SEED):
    """Dataset, split, fit and test scores; :func:`roc_auc` of the scores is P14."""
    data = fixed_layout(stratified_split(churn_dataset(features), seed=seed), FOREST_USERS, FOREST_FEW, FOREST_FULL)
    vec, model = train_churn_model(data.filter(~F.col("is_test")), seed)
    return data, (vec, model), score(vec, model, data.filter(F.col("is_test")))


def run_metrics(auc: DataFrame, data: DataFrame, watch: DataFrame, users: DataFrame,
                content: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row of AUC, churn rate of modelled users, table counts and the feature list."""
    return auc.select(
        "roc_auc",
        data.agg(F.avg("label").cast("double")).scalar().alias("churn_rate"),
        watch.agg(F.count(F.lit(1))).scalar().alias("sessions"),
        users.agg(F.count(F.lit(1))).scalar().alias("users"),
        content.agg(F.count(F.lit(1))).scalar().alias("content_titles"),
        reviews.agg(F.count(F.lit(1))).scalar().alias("reviews"),
        F.array(*[F.lit(c) for c in S.CHURN_FEATURES]).alias("model_features"))


def segment_summary(segments: DataFrame) -> DataFrame:
    """users, minutes, mean of users' completion and revenue per segment."""
    return segments.groupBy("viewer_segment").agg(
        F.count("user_id").alias("users"),
        F.sum(F.col("total_watch_minutes").cast(X.PROFILE_DECIMAL)).cast("double").alias("watch_minutes"),
        X.mean(F.col("avg_completion").cast(X.PROFILE_DECIMAL)).alias("avg_completion"),
        F.sum(F.col("revenue").cast(X.PROFILE_DECIMAL)).cast("double").alias("revenue"))


def cluster_points(segments: DataFrame) -> DataFrame:
    """per-user scatter points of the segmentation."""
    return segments.select("user_id", "sessions", "total_watch_minutes", "viewer_segment", "revenue",
                           "subscription_type")
