"""Segment recommendations.

Per segment: the 3 genres with most minutes, then the 10 best titles of those
genres by imdb desc, release year desc (content id breaks ties).  Both top-k
steps are windows with a rank filter, which Catalyst turns into a
WindowGroupLimit (partial top-k before the shuffle).  The segment/genre table has
at most k x 3 rows, so it is broadcast against the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_genres_per_segment(enriched: DataFrame, segments: DataFrame, k: int = 3) -> DataFrame:
    g = (enriched.select("user_id", "genre", "watch_duration")
         .join(segments.select("user_id", "viewer_segment"), "user_id")
         .groupBy("viewer_segment", "genre").agg(F.sum("watch_duration").alias("minutes")))
    w = Window.partitionBy("viewer_segment").orderBy(F.col("minutes").desc_nulls_last(),
                                                     F.col("genre").asc_nulls_last())
    return g.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def segment_recommendations(enriched: DataFrame, segments: DataFrame, content: DataFrame,
                            genres: int = 3, titles: int = 10) -> DataFrame:
    top = top_genres_per_segment(enriched, segments, genres).select("viewer_segment", "genre")
    cand = content.select("content_id", "title", "genre", "imdb_rating", "release_year").join(
        F.broadcast(top), "genre")
    w = Window.partitionBy("viewer_segment").orderBy(
        F.col("imdb_rating").desc_nulls_last(), F.col("release_year").desc_nulls_last(), "content_id")
    return (cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= titles)
            .select("viewer_segment", F.col("content_id").alias("recommended_content_id"), "title", "genre",
                    F.col("imdb_rating").cast("double").alias("imdb_rating")))


def recommendations_for(recs: DataFrame, segment: str) -> DataFrame:
    """the recommendation rows of one segment."""
    return recs.filter(F.col("viewer_segment") == segment)
