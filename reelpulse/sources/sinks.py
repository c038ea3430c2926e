"""Sinks (P20, F15): marts as Parquet/CSV, run metrics as JSON, models with MLlib writers.

Every writer is a distributed ``DataFrame.write``; nothing is collected.  The
session mart is partitioned by month so readers prune whole months.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audience as A
from ..operators import content as C
from ..operators import forecast as FC
from ..operators import kpi as K
from ..operators import ml as ML
from ..operators import recommend as RC
from . import versions
from .bindings import load_star


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Headered CSV; timestamps as ``yyyy-MM-dd HH:mm:ss`` like the reference's files."""
    (df.write.mode(mode).option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("dateFormat", "yyyy-MM-dd")
     .csv(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def export_filtered_sessions(filtered: DataFrame, path: str) -> str:
    """the filtered sessions as a headered CSV folder."""
    return write_csv(filtered, path)


def _summaries(enriched: DataFrame, folder: str) -> dict[str, str]:
    """The marts that follow from the session mart alone."""
    monthly = K.monthly_growth_mart(K.monthly_kpis(enriched))
    return {"monthly_kpis": write_parquet(monthly, os.path.join(folder, "monthly_kpis")),
            "genre_performance": write_parquet(C.genre_performance(enriched), os.path.join(folder, "genre_performance")),
            "watch_time_forecast": write_parquet(FC.watch_time_forecast(FC.monthly_minutes(enriched)),
                                                 os.path.join(folder, "watch_time_forecast"))}


_FORMATS = {"recommendation_preview": "csv", "model_metrics": "json", "models": "mllib"}


def build_marts(spark: SparkSession, sf_dir: str, out_dir: str, with_models: bool = True) -> dict[str, str]:
    """P20: write every mart, the forecast, recommendations, run metrics and the models as one new version.

    Everything goes into a folder of this build; the version is published last (:mod:`.versions`), so readers of
    ``out_dir`` see the old version whole until then, also when a build fails midway.
    """
    t = load_star(spark, sf_dir)
    folder = versions.new_build(out_dir)
    enriched = K.enriched_sessions(t.watch, t.users, t.content, t.plans)
    # Written once and read back: the marts below read the materialized sessions,
    # not the lineitem/orders join again.
    enriched_path = write_parquet(enriched, os.path.join(folder, "watch_enriched"), ["month"])
    enriched = spark.read.parquet(enriched_path)
    out = {"watch_enriched": enriched_path} | _summaries(enriched, folder) | {
        "review_sentiment": write_parquet(C.review_sentiment(t.reviews), os.path.join(folder, "review_sentiment"))}
    if with_models:
        # Written once: the clustering and the forest both read it.
        out["user_features"] = write_parquet(A.user_features(enriched), os.path.join(folder, "user_features"))
        features = spark.read.parquet(out["user_features"])
        kmeans, data = ML.fit_segmentation(features)
        segments = ML.name_segments(kmeans.transform(data).drop("_features"))
        out["viewer_segments"] = write_parquet(segments, os.path.join(folder, "viewer_segments"))
        segments = spark.read.parquet(out["viewer_segments"])
        out["recommendation_preview"] = write_csv(
            RC.segment_recommendations(enriched, segments, t.content), os.path.join(folder, "recommendation_preview"))
        data, (steps, rf), scores = ML.churn_pipeline(features)
        out["model_metrics"] = write_json(ML.run_metrics(ML.roc_auc(scores), data, t.watch, t.users, t.content, t.reviews),
                                          os.path.join(folder, "model_metrics"))
        kmeans.write().overwrite().save(os.path.join(folder, "models", "viewer_segmentation_kmeans"))
        rf.write().overwrite().save(os.path.join(folder, "models", "churn_prediction_random_forest"))
        # The forest sees bins: its steps from features to bins belong to it.
        steps.write().overwrite().save(os.path.join(folder, "models", "churn_prediction_steps"))
        out["models"] = os.path.join(folder, "models")
    versions.publish(spark, out_dir, versions.month_entries(spark, "watch_enriched", enriched_path) + [
        (name, None, path, _FORMATS.get(name, "parquet")) for name, path in out.items() if name != "watch_enriched"])
    return out


def refresh_months(spark: SparkSession, sf_dir: str, out_dir: str, months: list[str]) -> int:
    """A new version in which the sessions of some months ('yyyy-MM') come from ``sf_dir`` again, e.g. for late data.

    Only those months are read from the source and written; the other months, the review mart and the models stay
    where they are, and the marts that follow from the sessions are made anew over both.  Returns the version.
    """
    old = versions.manifest(spark, out_dir)
    t = load_star(spark, sf_dir)
    first, last = min(months) + "-01", max(months) + "-01"
    # The bounds reach the scan; the exact months are those of the mart's own column.
    watch = t.watch.filter((F.col("watch_time") >= F.lit(first).cast("timestamp_ntz"))
                           & (F.col("watch_time") < F.add_months(F.lit(last).cast("date"), 1).cast("timestamp_ntz")))
    fresh = K.enriched_sessions(watch, t.users, t.content, t.plans).filter(F.col("month").isin(list(months)))
    folder = versions.new_build(out_dir)
    path = write_parquet(fresh, os.path.join(folder, "watch_enriched"), ["month"])
    kept = [e for e in old if e[0] == "watch_enriched" and e[1] not in months]
    sessions = kept + versions.month_entries(spark, "watch_enriched", path)
    made = _summaries(versions.read_entries(spark, sessions, "watch_enriched"), folder)
    return versions.publish(spark, out_dir, sessions + [(name, None, p, "parquet") for name, p in made.items()]
                            + [e for e in old if e[0] != "watch_enriched" and e[0] not in made])


def materialize_star(spark: SparkSession, sf_dir: str, database: str = "reelpulse", *, buckets: int,
                     binding: str = "S") -> None:
    """Write the bound star schema once as catalog tables for repeated querying.

    The session fact and the users table are bucketed and sorted by ``user_id``
    with the same bucket count, so every viewer join (Q01, Q11, Q15, Q18, Q27,
    Q33, Q35, the marts) reads co-located buckets instead of shuffling the fact
    table again; reviews are bucketed the same way.  Content and plans are
    written plain (joined by title id or broadcast).  Choose ``buckets`` so that
    bucket files have a few hundred MB at the target size.  A viewer with a large
    share of all sessions is one bucket, which no later join splits: for such data
    query the source tables, whose operators reduce sessions per viewer first.
    """
    t = load_star(spark, sf_dir, binding)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def bucketed(df, name):
        (df.write.mode("overwrite").format("parquet").bucketBy(buckets, "user_id").sortBy("user_id")
         .saveAsTable(f"{database}.{name}"))

    bucketed(t.watch, "watch_history")
    bucketed(t.users, "users")
    bucketed(t.reviews, "reviews")
    t.content.write.mode("overwrite").format("parquet").saveAsTable(f"{database}.content_library")
    t.plans.write.mode("overwrite").format("parquet").saveAsTable(f"{database}.subscription_plans")
