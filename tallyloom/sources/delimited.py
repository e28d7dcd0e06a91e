"""Comma- and tab-separated files.

Quotes are doubled to escape them, and a backslash is a character like others. Without
``multi_line`` no file may hold line breaks inside quotes, so that Spark can split large files
between tasks: the writer refuses to make such files, and the reader to read them.
``lines.read_quoted_csv`` reads them in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blank_to_null, plain_number

MISSING = "NA"


def _one_missing_value(df: DataFrame) -> DataFrame:
    """Quoted empty fields, read as empty strings, and NaN become NULL like other gaps."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    texts = [n for n, t in kinds.items() if isinstance(t, T.StringType)]
    floats = [n for n, t in kinds.items() if isinstance(t, T.DoubleType)]
    return df.withColumns(
        {n: blank_to_null(F.col(f"`{n}`")) for n in texts}
        | {n: F.when(~F.isnan(f"`{n}`"), F.col(f"`{n}`")) for n in floats}
    )


def _without_padding(df: DataFrame, but: str | None = None) -> DataFrame:
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != but]
    padding = F.lit(" \t")
    trimmed = {n: F.trim(F.col(f"`{n}`"), padding) for n in texts}
    # Padding around a mark of a missing value, or around nothing, is none of the value.
    return df.withColumns({n: F.when(~c.isin(MISSING, ""), c) for n, c in trimmed.items()})


def _closed_quotes(spark: SparkSession, path: str) -> Column:
    """True if every line closes the quotes it opens; raises otherwise. A scalar subquery."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = spark.read.text(path).agg(F.count_if(quotes % 2 == 1)).scalar()
    message = F.lit("a line break inside quotes, or an open quote: read with multi_line or read_quoted_csv")
    return F.when(broken == 0, True).otherwise(F.raise_error(message).cast("boolean"))


def read_typed_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    corrupt_column: str | None = None,
    trim: bool = True,
    multi_line: bool = False,
    check_quotes: bool = True,
) -> DataFrame:
    """CSV with a header and a declared schema; empty fields and ``NA`` are missing.

    Blanks around a field are removed, also inside quotes, unless ``trim`` is off. With
    ``multi_line`` quoted fields may hold line breaks; each file is then read by one task. Without it
    a line that opens quotes and does not close them fails the query, since its record would come apart
    in silence. Looking for such lines reads the text once more; turn ``check_quotes`` off for files
    known to have none.

    The header must name the columns of the schema in order; otherwise reading fails, since
    values would land in the wrong columns.

    A field that does not fit its type is missing, and with ``corrupt_column`` the line it
    came from is kept there as text. Spark parses the selected columns only, so keep the
    columns to be checked in the query.
    """
    reader = (
        spark.read.option("header", True)
        .option("nullValue", MISSING)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", trim)
        .option("ignoreTrailingWhiteSpace", trim)
        .option("multiLine", multi_line)
    )
    if corrupt_column:
        schema = f"{schema}, `{corrupt_column}` STRING"
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    table = reader.schema(schema).csv(path)
    if check_quotes and not multi_line:
        table = table.filter(_closed_quotes(spark, path))
    return _one_missing_value(_without_padding(table, corrupt_column) if trim else table)


def read_trimmed_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated UTF-8 text with a header: every column a string, padding removed."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    table = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("enforceSchema", False)
        .option("nullValue", MISSING)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    return _one_missing_value(_without_padding(table))


def write_report(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header and ``NA`` for missing values, replacing ``path``.

    Whole numbers are written without ``.0``, text as it stands; text with a line break fails
    the query, since no reader that splits files could read it. Sorted input stays sorted from
    file to file; the table is not squeezed into one file, since that would put it through
    one task.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    broken = F.raise_error(F.lit("a text with a line break cannot be written as one line"))

    def written(name: str, kind: T.DataType):
        value = F.col(f"`{name}`")
        if isinstance(kind, T.DoubleType):
            return plain_number(value)
        return F.when(value.rlike("[\r\n]"), broken).otherwise(value)

    texts = (T.DoubleType, T.StringType)
    text = df.withColumns({n: written(n, k) for n, k in kinds.items() if isinstance(k, texts)})
    (
        text.write.mode("overwrite")
        .option("header", True)
        .option("nullValue", MISSING)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
