"""Malformed source rows: quarantined with counts, or ending the read, in CSV and JSON alike."""

import json
import os

import pytest

from reelpulse import schema as S
from reelpulse.sources.tables import read_canonical, read_with_quarantine

GOOD = {"review_id": "R1", "session_id": "S1", "user_id": "U1", "content_id": "C1", "rating": 4, "review_date": "2024-01-02"}



COLUMNS = [f.name for f in S.CANONICAL["reviews"].fields]


def rows():
    base = {c: GOOD.get(c, "x") for c in COLUMNS}
    return [base, base | {"rating": 5}, base | {"rating": "four"}, base | {"review_date": "02.01.2024"}, base | {"rating": None}]


@pytest.fixture(params=["csv", "json"])
def source(request, scratch):
    folder = os.path.join(scratch, "in")
    os.makedirs(folder)
    with open(os.path.join(folder, f"a.{request.param}"), "w") as f:
        if request.param == "csv":
            f.write(",".join(c.title() for c in COLUMNS) + "\n")
            for r in rows():
                f.write(",".join("" if r[c] is None else str(r[c]) for c in COLUMNS) + "\n")
            f.write(",".join(["R9"] * (len(COLUMNS) - 2)) + "\n")
            f.write(",".join(["R8"] * (len(COLUMNS) + 1)) + "\n")
        else:
            for r in rows():
                f.write(json.dumps(r) + "\n")
            f.write('{"review_id": "R9"\n')
            f.write("R8\n")
    return request.param, folder, os.path.join(scratch, "bad")


def test_bad_rows_are_set_aside_and_counted(spark, source):
    fmt, folder, bad = source
    good, counts = read_with_quarantine(spark, folder, "reviews", bad, fmt)
    assert good.schema == S.CANONICAL["reviews"] or good.columns == COLUMNS
    assert good.count() == good.select("review_id").count() == 3
    assert sorted(((r.review_id, r.rating) for r in good.collect()), key=str) == [("R1", 4), ("R1", 5), ("R1", None)]
    assert [(r.table, os.path.basename(r.file), r.bad_rows) for r in counts.collect()] == [("reviews", f"a.{fmt}", 4)]
    kept = spark.read.parquet(bad).collect()
    assert len(kept) == 4
    by = {next(k for k in ("four", "02.01.2024", "R9", "R8") if k in r.raw): r for r in kept}
    assert set(by) == {"four", "02.01.2024", "R9", "R8"}
    assert by["four"].empty == ["rating"] and by["02.01.2024"].empty == ["review_date"]


def test_a_second_read_appends(spark, source):
    fmt, folder, bad = source
    for _ in range(2):
        _, counts = read_with_quarantine(spark, folder, "reviews", bad, fmt)
        assert counts.first().bad_rows == 4
    assert spark.read.parquet(bad).count() == 8


def test_plain_read_fails_on_bad_rows(spark, source):
    fmt, folder, _ = source
    with pytest.raises(Exception, match="(?i)malformed"):
        read_canonical(spark, folder, "reviews", fmt).collect()


def test_clean_files_have_no_quarantine(spark, scratch):
    path = os.path.join(scratch, "c.json")
    with open(path, "w") as f:
        f.write(json.dumps(rows()[0]) + "\n")
    good, counts = read_with_quarantine(spark, path, "reviews", os.path.join(scratch, "q"), "json")
    assert good.count() == 1 and counts.count() == 0
    with pytest.raises(ValueError):
        read_with_quarantine(spark, path, "reviews", os.path.join(scratch, "q"), "parquet")
