"""The cube store against a full rebuild, and what a refresh reads and writes."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import cube_store, telework

SCHEMA = "YEAR INT, MONTH INT, METFIPS INT, IND INT, TELWRKPAY INT, WTFINL DOUBLE"


def persons(spark, months, weight=1.0):
    rows = [
        (y, m, 10_000 + i % 3, 770 + 500 * (i % 4), i % 3, weight * (i % 5))
        for y, m in months
        for i in range(40)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def table(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def files(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*") if p.is_file()}


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "persons"), str(tmp_path / "store")


def rebuilt(spark, microdata):
    return telework.telework_cube(spark.read.parquet(microdata))


def test_added_corrected_and_removed_months(spark, places):
    microdata, store = places
    cube_store.write_months(persons(spark, [(2023, m) for m in (1, 2, 3)]), microdata)
    assert cube_store.refresh_cube(spark, microdata, store) == [(2023, 1), (2023, 2), (2023, 3)]
    assert table(cube_store.read_cube(spark, store)) == table(rebuilt(spark, microdata))
    before = files(store)
    assert cube_store.refresh_cube(spark, microdata, store) == []
    assert files(store) == before
    cube_store.write_months(persons(spark, [(2023, 2), (2024, 1)], 3.0), microdata)
    assert cube_store.refresh_cube(spark, microdata, store) == [(2023, 2), (2024, 1)]
    assert table(cube_store.read_cube(spark, store)) == table(rebuilt(spark, microdata))
    for path in (Path(microdata) / "YEAR=2023" / "MONTH=3").iterdir():
        path.unlink()
    assert cube_store.refresh_cube(spark, microdata, store) == []
    left = cube_store.read_cube(spark, store)
    assert {(r.YEAR, r.MONTH) for r in left.collect()} == {(2023, 1), (2023, 2), (2024, 1)}


def test_a_new_month_does_not_read_the_others(spark, places):
    microdata, store = places
    cube_store.write_months(persons(spark, [(2023, 1)]), microdata)
    cube_store.refresh_cube(spark, microdata, store)
    want = table(cube_store.read_cube(spark, store))
    for path in (Path(microdata) / "YEAR=2023" / "MONTH=1").glob("*.parquet"):
        # The same name, length and time, but no Parquet: reading it would fail.
        stat = path.stat()
        path.write_bytes(b"x" * stat.st_size)
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    cube_store.write_months(persons(spark, [(2023, 2)]), microdata)
    assert cube_store.refresh_cube(spark, microdata, store) == [(2023, 2)]
    got = cube_store.read_cube(spark, store)
    assert table(got.filter("MONTH = 1")) == want and got.filter("MONTH = 2").count() > 0


def test_a_refresh_that_was_cut_off_shows_the_old_cube(spark, places, monkeypatch):
    microdata, store = places
    cube_store.write_months(persons(spark, [(2023, 1), (2023, 2)]), microdata)
    cube_store.refresh_cube(spark, microdata, store)
    old = table(cube_store.read_cube(spark, store))
    cube_store.write_months(persons(spark, [(2023, 2)], 9.0), microdata)
    with monkeypatch.context() as patched:
        patched.setattr(cube_store, "_MANIFEST", "not a schema at all")
        with pytest.raises(Exception):
            cube_store.refresh_cube(spark, microdata, store)
    assert table(cube_store.read_cube(spark, store)) == old
    assert cube_store.refresh_cube(spark, microdata, store) == [(2023, 2)]
    assert table(cube_store.read_cube(spark, store)) == table(rebuilt(spark, microdata))


def test_a_month_that_loses_all_tallies(spark, places):
    microdata, store = places
    cube_store.write_months(persons(spark, [(2023, 1), (2023, 2)]), microdata)
    cube_store.refresh_cube(spark, microdata, store)
    nobody = persons(spark, [(2023, 2)]).withColumn("TELWRKPAY", F.lit(0))
    cube_store.write_months(nobody, microdata)
    assert cube_store.refresh_cube(spark, microdata, store) == [(2023, 2)]
    assert {r.MONTH for r in cube_store.read_cube(spark, store).collect()} == {1}


def test_no_store_and_no_month(spark, places):
    with pytest.raises(ValueError, match="no cube"):
        cube_store.read_cube(spark, places[1])
    undated = persons(spark, [(2023, 1)]).withColumn("MONTH", F.lit(None).cast("int"))
    with pytest.raises(Exception, match="without a year or month"):
        cube_store.write_months(undated, places[0])
