"""Lines of text files with their places, and records that span lines, read in parallel.

A large file is read in splits, and no split knows how many lines, or open quotes, come before it.
Both are prefix counts at two levels: a line counts inside its split, and a table of one row for each
split carries what all earlier splits hold. So every line gets its number, and a line break is known to
be inside quotes, without reading a file in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.positions import block_carries, with_positions
from ..session import materialise
from .delimited import MISSING, _one_missing_value, _without_padding

# A record of more lines is an error: an open quote would swallow the rest of its file.
MAX_LINES = 100_000


def _split_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All lines, written once with their split, and a row for each split with what comes before it."""
    raw = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = materialise(
        raw.select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("number"),
            (quotes % 2).cast("long").alias("odd"),
        ),
        "lines",
    )
    splits = lines.groupBy("file", "__block").agg(
        F.min("number").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("odd").alias("odd")
    )
    splits = materialise(with_positions(splits, ["file", "__block"], "split"), "splits")
    carries = block_carries(splits, "split", {"before": "n", "odd_before": "odd"})
    placed = splits.select("file", "__block", "first", "split").join(carries, "split")
    files = placed.groupBy("file").agg(
        F.min("before").alias("file_before"), F.min("odd_before").alias("file_odd_before")
    )
    return lines, placed.join(files, "file").drop("split")


def _placed(lines: DataFrame, splits: DataFrame) -> DataFrame:
    position = F.col("before") + F.col("number") - F.col("first") + 1
    return (
        lines.join(splits, ["file", "__block"])
        .withColumn("position", position)
        .withColumn("line", F.col("position") - F.col("file_before"))
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of text files: file, line (1, 2, ... in its file), position and value.

    ``position`` counts over all files, in order of their paths. Both are the same for any size of the
    splits. Lines end with a line feed; a carriage return before it is part of the value.
    """
    lines, splits = _split_lines(spark, path)
    return _placed(lines, splits).select("file", "line", "position", "value")


def read_quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of files whose quoted fields may hold line breaks: file, line, position, record.

    A line break inside quotes is part of its record; ``line`` and ``position`` are those of the
    record's first line. Large files are read in splits like others. A file that ends inside quotes
    is an error, and so is a record of more than 100,000 lines.
    """
    lines, splits = _split_lines(spark, path)
    sums = lines.groupBy("file").agg(F.sum("odd").alias("odd"))
    open_file = sums.filter(F.col("odd") % 2 == 1).first()
    if open_file:
        raise ValueError(f"{open_file['file']} ends inside quotes")
    # Quotes are open behind an odd number of lines with an odd number of quotes.
    in_split = Window.partitionBy("file", "__block").orderBy("number")
    running = F.sum("odd").over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = _placed(lines.withColumn("run", running), splits).withColumn(
        "odd_to", F.col("odd_before") - F.col("file_odd_before") + F.col("run")
    )
    inside = (F.col("odd_to") - F.col("odd")) % 2 == 1
    broken = inside | (F.col("odd") == 1)
    names = ("file", "line", "position")
    whole = counted.filter(~broken).select(*names, F.col("value").alias("record"))
    too_long = F.raise_error(F.lit(f"a quoted record of more than {MAX_LINES} lines")).cast("string")
    parts = F.array_sort(F.collect_list(F.struct("position", "value")))
    text = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    # Lines with an odd count open and close records in turn.
    joined = (
        counted.filter(broken)
        .withColumn("of", F.floor((F.col("odd_to") - 1) / 2))
        .groupBy("file", "of")
        .agg(
            F.min("line").alias("line"),
            F.min("position").alias("position"),
            F.when(F.count(F.lit(1)) > MAX_LINES, too_long).otherwise(text).alias("record"),
        )
    )
    return whole.unionByName(joined.select(*names, "record"))


def _header_matches(record: Column, names: list[str], sep: str) -> Column:
    fields = F.transform(F.split(record, _literal(sep)), lambda f: F.trim(F.replace(f, F.lit('"'), F.lit(""))))
    return fields == F.array(*(F.lit(n) for n in names))


def _literal(sep: str) -> str:
    return f"\\Q{sep}\\E"


def read_quoted_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    sep: str = ",",
    trim: bool = True,
    position: str | None = None,
) -> DataFrame:
    """``read_typed_csv`` for files with line breaks inside quotes, none of them read by one task.

    ``position`` names a column for the place of each record's first line over all files, with which
    tables keep the order of their files. The first line of each file must name the columns of the
    schema in order. A field that does not fit its type is missing.
    """
    fields = T.StructType.fromDDL(schema)
    records = read_quoted_records(spark, path)
    wrong = F.raise_error(F.concat(F.lit("the header does not name the columns of the schema: "), F.col("record")))
    bare = F.regexp_replace("record", "\r$", "")
    is_data = F.when(
        F.col("line") == 1,
        F.when(_header_matches(bare, fields.names, sep), False).otherwise(wrong.cast("boolean")),
    ).otherwise(F.length(bare) > 0)
    options = {
        "sep": sep,
        "quote": '"',
        "escape": '"',
        "nullValue": MISSING,
        "ignoreLeadingWhiteSpace": str(trim),
        "ignoreTrailingWhiteSpace": str(trim),
        "multiLine": "true",
    }
    parsed = F.from_csv(bare, fields.simpleString()[len("struct<") : -1].replace(":", " "), options)
    table = records.filter(is_data).select("position", parsed.alias("row")).select("position", "row.*")
    place = [F.col("position").alias(position)] if position else []
    table = table.select(*place, *(F.col(f"`{n}`") for n in fields.names))
    return _one_missing_value(_without_padding(table, position) if trim else table)
