"""Readers and the writer, on files written by the tests."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.plans import cube_store
from tallyloom.plans.publish import main
from tallyloom.sources import (
    catalogue_from_match,
    read_fixed_width,
    read_trimmed_tsv,
    read_typed_csv,
    schemas,
    write_report,
)


def rows(df):
    return [tuple(r) for r in df.collect()]


def written(tmp_path, text: str) -> str:
    path = tmp_path / "file.txt"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_typed_csv(spark, tmp_path):
    path = written(
        tmp_path,
        'code,name,day,n\n06,"A, ""B"", é",2024-01-31,49\nNA,"",NA,\n00,NA,2024-02-01,0.5\n'
        "01,x,NA,NaN\n",
    )
    table = read_typed_csv(spark, path, "code STRING, name STRING, day DATE, n DOUBLE")
    assert rows(table) == [
        ("06", 'A, "B", é', dt.date(2024, 1, 31), 49.0),
        (None, None, None, None),
        ("00", None, dt.date(2024, 2, 1), 0.5),
        ("01", "x", None, None),
    ]


def test_typed_csv_keeps_unreadable_lines(spark, tmp_path):
    path = written(tmp_path, "a,b\n1,2.5\nx,3.5\n")
    table = read_typed_csv(spark, path, "a INT, b DOUBLE", corrupt_column="bad")
    assert rows(table) == [(1, 2.5, None), (None, 3.5, "x,3.5")]


def test_header_must_match_the_schema(spark, tmp_path):
    path = written(tmp_path, "b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        rows(read_typed_csv(spark, path, "a INT, b INT"))


def test_trimmed_tsv(spark, tmp_path):
    path = written(tmp_path, " code \t  value\tnote\n 06 \t    12.5\t\n00\t  - \tNA\n")
    table = read_trimmed_tsv(spark, path, ["code", "value", "note"])
    assert rows(table) == [("06", "12.5", None), ("00", "-", None)]


def test_fixed_width(spark, tmp_path):
    path = written(tmp_path, "2023 1 06  12.5\n2023 2    oops \n2024\n")
    layout = [("y", 1, 4, "int"), ("m", 5, 6, "int"), ("s", 7, 9, "string"), ("w", 10, 15, "double")]
    assert rows(read_fixed_width(spark, path, layout)) == [
        (2023, 1, "06", 12.5),
        (2023, 2, None, None),
        (2024, None, None, None),
    ]


def test_report_roundtrip(spark, tmp_path):
    data = [("a", 49.0, 1), (None, None, 2), ('q"x, y', 5.7500000000000036, 3), ("", 0.1, 4)]
    table = spark.createDataFrame(data, "name string, `10 Metro Avg.` double, n int")
    path = str(tmp_path / "report")
    write_report(table.coalesce(1), path)
    text = next((tmp_path / "report").glob("part-*.csv")).read_text().splitlines()
    assert text[:3] == ["name,10 Metro Avg.,n", "a,49,1", "NA,NA,2"]
    back = read_typed_csv(spark, path, "name STRING, `10 Metro Avg.` DOUBLE, n INT")
    assert sorted(rows(back), key=lambda r: r[2])[:3] == data[:3]


def test_catalogue_from_match(spark):
    entries = spark.createDataFrame(
        [(3, "c", "May"), (1, "a", "March"), (2, "b", "April"), (4, "d", "April")],
        "i int, name string, description string",
    )
    found = catalogue_from_match(entries, "i", "description", "April")
    assert sorted(r[1] for r in rows(found)) == ["b", "c", "d"]
    with pytest.raises(Exception, match="no catalogue entry"):
        rows(catalogue_from_match(entries, "i", "description", "June"))


class Session:
    """As much of a session as finding the shared folder needs."""

    def __init__(self, **settings):
        self.conf = self
        self.settings = settings
        self.sparkContext = self
        self.applicationId = "app-1"

    def getCheckpointDir(self):
        return None

    def get(self, name, default=None):
        return self.settings.get(name.removeprefix("spark.").replace(".", "_"), default)


def test_tables_are_written_to_the_folder_the_session_names(spark):
    folder = Path(session.shared_folder(spark))
    assert str(folder) == spark.conf.get("spark.checkpoint.dir")
    table = session.materialise(spark.range(3), "three")
    assert sorted(rows(table)) == [(0,), (1,), (2,)]
    assert [p for p in folder.iterdir() if p.name.startswith("three-")]


def test_shared_folder_without_a_setting():
    local = Session(master="local[4]")
    assert session.shared_folder(local) == session.shared_folder(local)
    assert session.shared_folder(Session(master="yarn", checkpoint_dir="s3://b/c/")) == "s3://b/c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session(master="yarn"))


LAYOUT = [["YEAR", 1, 4, "int"], ["MONTH", 5, 6, "int"], ["METFIPS", 7, 11, "int"], ["IND", 12, 15, "int"],
          ["TELWRKPAY", 16, 16, "int"], ["WTFINL", 17, 22, "double", 2]]


@pytest.mark.parametrize("form", ["csv", "parquet", "fixed", "months"])
def test_publish_writes_every_table(spark, tmp_path, form):
    """From every form of the microdata; with fixed-width text the estimates come as pulled."""
    weeks = [dt.date(2022, 12, 7) + dt.timedelta(days=7 * i) for i in range(6)]
    panel = [(w, c, 10.0 * i) for i, w in enumerate(weeks) for c in ("Philadelphia", "Chicago")]
    places = {"37980": "Philadelphia-Camden, PA Metro Area", "16980": "Chicago-Elgin, IL Metro Area"}
    metros = [(g, n, "wfh", 20.0, 2.0, 100.0, 5.0) for g, n in places.items()]
    nation = [("1", "United States", "wfh", 150.0, 2.0, 1000.0, 5.0)]
    counties = [("42101", "Philadelphia County, Pennsylvania", "wfh", 3.0, 1.0, 12.0, 1.0)]
    people = [
        (2023, m, metro, industry, answer, 2.0)
        for m in (1, 2)
        for metro in (37980, 16980, 5)
        for industry in (1070, 6470)
        for answer in (0, 1, 2)
    ]
    series = [
        (f"SMU{state}{area}{sector}00000001", "2023", "M13", f"  {value}", None)
        for state, area in (("42", "37980"), ("17", "16980"))
        for sector, value in (("30", 10), ("40", 30), ("00", 99))
    ]
    inputs = {
        "panel": (panel, schemas.OCCUPANCY),
        "metro-estimates": (metros, schemas.ESTIMATES),
        "nation-estimates": (nation, schemas.ESTIMATES),
        "county-estimates": (counties, schemas.ESTIMATES),
        "persons": (people, schemas.PERSONS),
        "series": (series, schemas.SERIES),
        "supersectors": ([("30", "Manufacturing"), ("40", "Trade")], schemas.SUPERSECTORS),
    }
    arguments = ["--out", str(tmp_path / "out"), "--persons-form", form]
    arguments += ["--cube-store", str(tmp_path / "cube")] if form == "months" else []
    if form == "fixed":
        arguments += ["--pulled", "--persons-layout", json.dumps(LAYOUT)]
        for name in ("metro-estimates", "nation-estimates", "county-estimates"):
            pulled = [
                row
                for g, n, _, estimate, moe, whole, whole_moe in inputs[name][0]
                for row in ((g, n, "B08006_001", whole, whole_moe), (g, n, "B08006_017", estimate, moe))
            ]
            inputs[name] = (pulled, schemas.PULL)
    for name, (data, schema) in inputs.items():
        table = spark.createDataFrame(data, schema)
        path = f"{tmp_path}/{name}"
        if name == "persons" and form == "parquet":
            table.write.parquet(path)
        elif name == "persons" and form == "months":
            cube_store.write_months(table, path)
        elif name == "persons" and form == "fixed":
            widths = {"YEAR": 4, "MONTH": 2, "METFIPS": 5, "IND": 4, "TELWRKPAY": 1}
            fields = [F.lpad(F.col(c).cast("string"), w, " ") for c, w in widths.items()]
            weight = F.lpad((F.col("WTFINL") * 100).cast("int").cast("string"), 6, "0")
            table.select(F.concat(*fields, weight)).write.text(path)
        elif name in ("series", "supersectors"):
            table.write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False)
        else:
            write_report(table, path)
        arguments += [f"--{name}", path]
    main(arguments)

    def lines(name: str) -> list[str]:
        parts = sorted((tmp_path / "out" / name).glob("part-*.csv"))
        texts = [p.read_text().splitlines() for p in parts]
        return texts[0][:1] + [line for text in texts for line in text[1:]]

    assert lines("estimates")[0].startswith("GEOID,NAME,variable,estimate")
    assert [line.split(",")[0] for line in lines("wfh_share_by_metro")[1:]] == ["16980", "37980", "1"]
    assert lines("wfh_share_by_county")[1].endswith(",25")
    assert lines("telework_by_month_all_long") == ["YEAR,MONTH,METFIPS,wfh_pct"] + [
        f"2023,{m},{a},0.5" for a_list in (["16980", "37980"], ["1"]) for m in (1, 2) for a in a_list
    ]
    assert lines("telework_by_month_all_wide") == [
        "date,Chicago,Philadelphia,United States",
        "2023-01-01,50,50,50",
        "2023-02-01,50,50,50",
    ]
    assert lines("telework_by_month_office_wide") == lines("telework_by_month_all_wide")
    assert len(lines("telework_by_month_office_long")) == 7
    assert lines("telework_by_sector") == [
        "supersector_code,supersector_name,philly_wfh_pct,us_wfh_pct",
        "30,Manufacturing,50,50",
        "50,Information,50,50",
    ]
    assert lines("telework_of_office_workers")[0] == "METFIPS,wfh_pct,NAME,msa_short_name"
    assert len(lines("employment_by_sector")) == 7
    assert lines("employment_share_by_sector") == [
        "supersector_name,Chicago,Philadelphia",
        "Trade,75,75",
        "Manufacturing,25,25",
    ]
    assert lines("occupancy_by_week")[1] == "2023-01-11,35,35,35"
    assert lines("occupancy_by_week")[-1] == "2022-12-07,NA,NA,NA"
    assert lines("attendance_and_telework")[1].startswith("Chicago,25,16980,50,")


TEXTS = [' pad ', 'say "hi"', '"', '\\', 'end\\"', 'a, b', '\t tab', 'x  y', 'é 😀', '" quoted "']


def test_written_text_is_read_as_it_was(spark, tmp_path):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    write_report(table, f"{tmp_path}/r")
    back = read_typed_csv(spark, f"{tmp_path}/r", "i INT, t STRING", trim=False)
    assert sorted((r["i"], r["t"]) for r in back.collect()) == list(enumerate(TEXTS))
    trimmed = read_typed_csv(spark, f"{tmp_path}/r", "i INT, t STRING")
    assert sorted((r["i"], r["t"]) for r in trimmed.collect()) == [(i, t.strip(" \t")) for i, t in enumerate(TEXTS)]


@pytest.mark.parametrize("broken", ["a\nb", "a\rb"])
def test_line_breaks_are_not_written(spark, tmp_path, broken):
    table = spark.createDataFrame([(1, broken)], "i int, t string")
    with pytest.raises(Exception, match="line break"):
        write_report(table, f"{tmp_path}/r")


def test_csv_padding_and_line_breaks_of_others(spark, tmp_path):
    (tmp_path / "p.csv").write_text('i,city,n\n 1 , Chicago ,  2.5\n2," New York ", NA \n3,"",\n')
    got = [tuple(r) for r in read_typed_csv(spark, str(tmp_path / "p.csv"), "i INT, city STRING, n DOUBLE").collect()]
    assert got == [(1, "Chicago", 2.5), (2, "New York", None), (3, None, None)]
    (tmp_path / "m.csv").write_text('i,t\n1,"line1\nline2"\n2,b\n')
    rows = read_typed_csv(spark, str(tmp_path / "m.csv"), "i INT, t STRING", multi_line=True).collect()
    assert [tuple(r) for r in rows] == [(1, "line1\nline2"), (2, "b")]


def test_tsv_quotes_and_backslashes(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('a\tb\n"say ""hi"" x"\t1\n"end\\"\t2\n  pad \t 3 \n')
    got = [tuple(r) for r in read_trimmed_tsv(spark, str(tmp_path / "q.tsv"), ["a", "b"]).collect()]
    assert got == [('say "hi" x', "1"), ("end\\", "2"), ("pad", "3")]
