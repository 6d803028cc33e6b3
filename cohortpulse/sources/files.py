"""CSV and Parquet files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortpulse.sources.schemas import BRONZE, GOLD, SILVER
from cohortpulse.sources.tables import Tables


# The texts that pandas reads as missing.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
_SURPLUS = "fields beyond the header"
_ODD = "row of another number of fields"


def encoded_lines(c: Column) -> Column:
    """Backslashes and line ends as ``\\\\``, ``\\n``, ``\\r``: one record stays one line, so files can be split."""
    text = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def decoded_lines(c: Column) -> Column:
    """The text that :func:`encoded_lines` was given."""
    parts = F.transform(
        F.split(c, r"\\\\"),
        lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")),
    )
    return F.when(F.contains(c, F.lit("\\")), F.array_join(parts, "\\")).otherwise(c)


def read_bronze_csv(
    spark: SparkSession,
    path: str,
    table: str,
    multiline: bool = False,
    na_values: Sequence[str] = NA_VALUES,
    encoded: bool = False,
) -> DataFrame:
    """One raw CSV with a header, all columns as strings and taken by name; blank fields are null.

    ``na_values`` lists the texts that stand for missing. A row with more fields than the header ends the query, a row
    with fewer is filled with nulls. ``multiline`` allows line ends inside quotes; such files cannot be split, so give it
    only where the data needs it and keep the files small. ``encoded`` is for files of :func:`write_csv`.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8").option("multiLine", multiline)
    raw = reader.csv(path)
    missing = set(BRONZE[table]) - set(raw.columns)
    if missing:
        raise ValueError(f"{path}: no column {sorted(missing)}; found {raw.columns}")
    fields = StructType([StructField(c, StringType()) for c in (*raw.columns, _SURPLUS)])
    wide = reader.schema(fields).csv(path)
    refused = F.raise_error(F.concat(F.lit(f"{path}: a row has more fields than the header; the first too many: "), F.col(_SURPLUS)))
    wide = wide.where(F.when(F.col(_SURPLUS).isNotNull(), refused).otherwise(F.lit(True)))
    return _bronze_columns(wide, table, na_values, encoded)


def _bronze_columns(
    df: DataFrame, table: str, na_values: Sequence[str] = NA_VALUES, encoded: bool = False
) -> DataFrame:
    columns = [F.col(f"`{name}`") for name in BRONZE[table]]
    if na_values:
        columns = [F.when(~c.isin(list(na_values)), c) for c in columns]
    if encoded:
        columns = [decoded_lines(c) for c in columns]
    return df.select(*[c.alias(n) for c, n in zip(columns, BRONZE[table])])


def split_bronze_csv(spark: SparkSession, path: str, table: str, **options) -> tuple[DataFrame, DataFrame]:
    """The readable rows of a raw CSV, as :func:`read_bronze_csv` gives them, and the others: ``file, key, text``.

    A row is unreadable when it has more fields than the header: its values cannot be told to columns. Only rows whose
    number of fields differs at all are looked at again. Neither part ends the query; counting the second says how much of
    the first is missing. For files without line ends inside quotes.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8")
    header = reader.csv(path).columns
    missing = set(BRONZE[table]) - set(header)
    if missing:
        raise ValueError(f"{path}: no column {sorted(missing)}; found {header}")
    fields = [StructField(c, StringType()) for c in header]
    # Rows are told by their number of fields, so all of each is parsed, whatever columns are asked for.
    whole = reader.option("columnPruning", False).option("columnNameOfCorruptRecord", _ODD)
    marked = whole.schema(StructType([*fields, StructField(_ODD, StringType())])).csv(path)
    names = ", ".join(f"`{c}` string" for c in (*header, _SURPLUS))
    again = F.from_csv(F.col(f"`{_ODD}`"), names, {"escape": '"'})
    # Spark refuses queries of such rows that look at no column of the file.
    seen = F.concat_ws("", F.col(f"`{header[0]}`"), F.col(f"`{_ODD}`")) != ""
    surplus = F.col(f"`{_ODD}`").isNotNull() & seen & again[_SURPLUS].isNotNull()
    readable = _bronze_columns(marked.where(~surplus), table, **options)
    unreadable = marked.where(surplus).select(
        F.col("_metadata.file_path").alias("file"), F.col(f"`{header[0]}`").alias("key"), F.col(f"`{_ODD}`").alias("text")
    )
    return readable, unreadable


def bronze_tables(spark: SparkSession, root: str, **options) -> Tables:
    """The five raw CSVs under ``root``, named ``<table>.csv``."""
    return Tables(lambda name: read_bronze_csv(spark, f"{root}/{name}.csv", name, **options))


def read_clean_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A CSV written by :func:`write_csv`, with the types of the clean table."""
    found = spark.read.schema((SILVER | GOLD)[table]).option("header", True).option("escape", '"').csv(path)
    return found.select(*[decoded_lines(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in found.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts, values kept as they are (the writer would trim them by default) but for line ends and
    backslashes, see :func:`encoded_lines`."""
    lines = [encoded_lines(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    (
        df.select(*lines)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str, most: float = 4.0) -> None:
    """A catalog table over Parquet files below ``path``, one file for each of ``buckets`` ranges of hashes of ``key``.

    Tables with the same key and number of buckets are summed by the key and joined on it without a shuffle. If one key
    holds more rows than ``most`` buckets do on average, the table is stored without buckets.
    """
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    largest, rows = per_key.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    if largest > most * max(1.0, rows / buckets):
        df.write.mode("overwrite").option("path", path).saveAsTable(name)
        return
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """A Parquet folder; ``partition_by`` columns become folders and prune later scans.

    Rows are first brought together by partition value, in as many tasks as their volume needs, so that
    each folder holds a few large files: ``rebalance`` splits a value that holds much of the data.
    """
    names = list(partition_by)
    if names:
        df.hint("rebalance", *names).write.mode("overwrite").partitionBy(*names).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
