"""CSV and Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.sources.csv_records import DIALECT, column_count, csv_records, field_array, fields_of


def read_csv_text(spark: SparkSession, path: str | list[str], quoted_newlines: bool = True) -> DataFrame:
    """A CSV with a header, every column text, quoted newlines and doubled quotes allowed; large files are split.

    Blank lines are dropped; bad UTF-8 becomes replacement characters. Several files share the header of the first. Pass
    ``quoted_newlines=False`` for files without line ends in fields: they need no counting of quotes.
    """
    if not quoted_newlines:
        return spark.read.csv(path, header=True, inferSchema=False, **DIALECT)
    names = spark.read.csv(path, header=True, multiLine=True, inferSchema=False, **DIALECT).columns  # reads the first record only
    if not names:
        return spark.read.csv(path, header=True, multiLine=True, inferSchema=False, **DIALECT)
    rows = csv_records(spark, path).where("not head").select(fields_of(F.col("record"), len(names)).alias("_f"))
    return rows.select(*[F.col(f"_f.f{i}").alias(n) for i, n in enumerate(names)])


def csv_profile(df: DataFrame) -> DataFrame:
    """One row: the column names and the number of data rows."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(names.alias("columns"), "row_count")


def widest(records: DataFrame) -> int:
    """The largest number of columns that a file's header names; one number comes to the driver."""
    return records.where("head").agg(F.max(column_count(F.col("record")))).first()[0] or 1


def texts_of(records: DataFrame, columns: int) -> DataFrame:
    """Records as path, row (false for the header) and text, all fields joined by blanks."""
    return records.select("path", (~F.col("head")).alias("row"), F.array_join(field_array(F.col("record"), columns), " ").alias("text"))


def csv_profiles(records: DataFrame, columns: int) -> DataFrame:
    """One row per file of records: path, its column names, and the number of its data rows."""
    header = F.filter(field_array(F.col("record"), columns), lambda c: c.isNotNull())
    return records.groupBy("path").agg(
        F.max(F.when(F.col("head"), header)).alias("columns"), F.count_if(~F.col("head")).alias("row_count"))


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Every decimal column as double."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """A stored register with its money columns as double."""
    return decimals_to_double(spark.read.parquet(path))
