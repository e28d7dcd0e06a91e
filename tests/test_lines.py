"""Lines, quoted records and catalogue slices: the same for any size of the splits."""

from __future__ import annotations

import csv
import io
import random

import pytest

from tallyloom import operators as op
from tallyloom import sources as src


@pytest.fixture(params=[40, 300, None])
def splits(spark, request):
    """Sizes of the splits that files are read in: a line or less, a few lines, whole files."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    if request.param:
        spark.conf.set(names[0], str(request.param))
        spark.conf.set(names[1], "0")
    yield request.param
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def records(seed, n):
    rng = random.Random(seed)
    texts = ["plain", "two\nlines", 'a "quoted" word', "", "NA", "with, comma", "\n\n\n", "é\r\nwindows", "x" * 90, '"\n"']
    return [(i, rng.choice(texts), rng.randrange(100) / 4) for i in range(n)]


def write(path, rows, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "text", "x"])
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


SCHEMA = "id INT, text STRING, x DOUBLE"


def test_lines_have_their_numbers(spark, tmp_path, splits):
    files = {f"f{k}.txt": [f"line {k} {i} " + "y" * (i % 50) if i % 7 else "" for i in range(20 * k)] for k in range(4)}
    for name, lines in files.items():
        (tmp_path / name).write_text("".join(f"{line}\n" for line in lines))
    got = src.read_lines(spark, str(tmp_path)).orderBy("position").collect()
    want = [(name, i + 1, line) for name, lines in files.items() for i, line in enumerate(lines)]
    assert [(r.file.rsplit("/", 1)[1], r.line, r.value) for r in got] == want
    assert [r.position for r in got] == list(range(1, len(want) + 1))
    if splits == 40:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50


def missing(text):
    return None if text in ("", "NA") else text


def test_quoted_records_are_read_in_splits(spark, tmp_path, splits):
    rows = [records(k, 25) for k in range(3)]
    for k, part in enumerate(rows):
        write(tmp_path / f"p{k}.csv", part, "\r\n" if k == 1 else "\n")
    table = src.read_quoted_csv(spark, str(tmp_path), SCHEMA, trim=False, position="at")
    got = table.orderBy("at").collect()
    assert [tuple(r)[1:] for r in got] == [(i, missing(t), x) for part in rows for i, t, x in part]


def test_trimmed_like_the_plain_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text,x\n 1 ," a ", 2.5\n2,NA,\n3,"",oops\n')
    plain = src.read_typed_csv(spark, str(tmp_path), SCHEMA).collect()
    assert sorted(map(tuple, src.read_quoted_csv(spark, str(tmp_path), SCHEMA).collect())) == sorted(map(tuple, plain))


def test_broken_files_fail(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('id,text,x\n1,"open,2\n')
    with pytest.raises(ValueError, match="inside quotes"):
        src.read_quoted_csv(spark, str(tmp_path), SCHEMA).collect()
    (tmp_path / "a.csv").write_text("id,other,x\n1,b,2\n")
    with pytest.raises(Exception, match="does not name the columns"):
        src.read_quoted_csv(spark, str(tmp_path), SCHEMA).collect()
    monkeypatch.setattr("tallyloom.sources.lines.MAX_LINES", 3)
    (tmp_path / "a.csv").write_text('id,text,x\n1,"a\nb\nc\nd\n",2\n')
    with pytest.raises(Exception, match="more than 3 lines"):
        src.read_quoted_csv(spark, str(tmp_path), SCHEMA).collect()


def test_the_plain_reader_refuses_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,x\n1,"line1\n2,line2",3\n')
    with pytest.raises(Exception, match="line break inside quotes"):
        src.read_typed_csv(spark, str(tmp_path), SCHEMA).collect()
    assert len(src.read_typed_csv(spark, str(tmp_path), SCHEMA, multi_line=True).collect()) == 1
    assert len(src.read_typed_csv(spark, str(tmp_path), SCHEMA, check_quotes=False).collect()) == 2


def test_a_catalogue_without_ordinal(spark, tmp_path, splits):
    rows = [(i, "start here" if i in (31, 70) else f"entry\n{i}", 0.0) for i in range(100)]
    for k in range(4):
        write(tmp_path / f"c{k}.csv", rows[25 * k : 25 * k + 25])
    catalogue = src.read_quoted_csv(spark, str(tmp_path), SCHEMA, position="at")
    part = src.catalogue_from_match(catalogue, "at", "text", "start here")
    got = op.with_positions(part, ["at"], "entry").select("id", "entry").collect()
    assert sorted((r.entry, r.id) for r in got) == [(i - 30, i) for i in range(31, 100)]


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert src.read_lines(spark, str(tmp_path)).collect() == []
    assert src.read_quoted_csv(spark, str(tmp_path), SCHEMA).collect() == []
