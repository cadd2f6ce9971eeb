"""File listings: names and sizes only, the content is never read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions.text import infer_format


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """All files below a folder: path, size_bytes, format."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(root).select(one_slash(F.col("path")).alias("path"), F.col("length").alias("size_bytes"))
    return listed.withColumn("format", infer_format(F.col("path")))


def one_slash(path: Column) -> Column:
    """A path whose scheme is followed by a single slash, as some readers give it and others do not."""
    return F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*:)/+(?=[^/])", "$1/")


def scanned_path() -> Column:
    """The path of the file that a row was read from, as a listing gives it: decoded once."""
    return one_slash(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def existing(spark: SparkSession, root: str, names: Iterable[str]) -> list[str]:
    """Paths below the folder of those wanted file names that exist; missing ones are skipped.

    A name may exist in several folders; one row per such file reaches the driver.
    """
    wanted = list_files(spark, root).where(base_name(F.col("path")).isin(*names))
    return sorted(row.path for row in wanted.select("path").collect())
