"""Mart versions: a failed build leaves the old one, a month can be refreshed alone."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from reelpulse.sources import sinks, versions
from reelpulse.sources.tables import TEST_TABLES


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("marts"))
    sinks.build_marts(spark, SF_SMALL, root, with_models=False)
    return root


def test_a_failed_build_leaves_the_old_version(spark, built, monkeypatch):
    before = {n: rows_of(versions.read_version(spark, built, n)) for n in ("monthly_kpis", "genre_performance")}
    known = versions.versions(spark, built)

    def fails(*a, **k):
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks.C, "review_sentiment", fails)        # after four marts are written
    with pytest.raises(RuntimeError):
        sinks.build_marts(spark, SF_SMALL, built, with_models=False)
    assert versions.versions(spark, built) == known
    assert {n: rows_of(versions.read_version(spark, built, n)) for n in before} == before


def test_an_uncommitted_manifest_does_not_count(spark, built):
    known = versions.versions(spark, built)
    os.makedirs(os.path.join(built, "manifests", str(known[-1] + 7)))
    assert versions.versions(spark, built) == known
    with pytest.raises(FileNotFoundError):
        versions.manifest(spark, built, 99)
    with pytest.raises(KeyError):
        versions.read_version(spark, built, "no_such_table")


def test_one_month_is_refreshed(spark, built, scratch):
    month = "1996-03"
    old = versions.read_version(spark, built, "watch_enriched")
    was, kept = old.filter(F.col("month") == month).count(), rows_of(old.filter(F.col("month") != month))
    assert was > 3
    # The source loses the longest sessions of every month; only one month is refreshed.
    for name in TEST_TABLES:
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        (df.filter("l_quantity < 40") if name == "lineitem" else df).write.parquet(os.path.join(scratch, f"{name}.parquet"))
    number = sinks.refresh_months(spark, scratch, built, [month])
    assert number == versions.versions(spark, built)[-1]
    new = versions.read_version(spark, built, "watch_enriched")
    assert 0 < new.filter(F.col("month") == month).count() < was
    assert rows_of(new.filter(F.col("month") != month)) == kept
    assert {e[2] for e in versions.manifest(spark, built) if e[1] not in (None, month)} == {
        e[2] for e in versions.manifest(spark, built, number - 1) if e[1] not in (None, month)}
    told = {str(r.month)[:7]: r.sessions for r in versions.read_version(spark, built, "monthly_kpis").collect()}
    counts = {r.month: r["count"] for r in new.groupBy("month").count().collect()}
    assert told == counts
    # The version before is still there.
    assert versions.read_version(spark, built, "watch_enriched", number - 1).filter(F.col("month") == month).count() == was
