"""Writers for candidates, reconciled rows, reports and catalog tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.operators.extraction import CANDIDATE_SCHEMA


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in its order and types; missing ones are NULL."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def write_candidates(df: DataFrame, path: str, probe: DataFrame | None = None) -> bool:
    """Writes the fixed candidate layout; nothing at all when there are no rows.

    ``probe`` is a cheaper frame that is empty exactly when ``df`` is (the rows before
    duplicates are removed), so the test needs no shuffle.
    """
    if (df if probe is None else probe).isEmpty():
        return False
    to_schema(df, CANDIDATE_SCHEMA).write.mode("errorifexists").parquet(path, compression="snappy")
    return True


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path, compression="snappy")


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """A report as one folder per section, each with JSON lines.

    Sections such as the near matches grow with the data, so they are written by the tasks
    and never gathered into one document.
    """
    for name, rows in sections.items():
        rows.write.mode("errorifexists").json(f"{path}/{name}", ignoreNullFields=False)


def register_table(spark: SparkSession, name: str, path: str) -> None:
    """An external catalog table over stored Parquet. A table of that name must not exist yet."""
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} USING PARQUET LOCATION '{place}'")


def register_bucketed(rows: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """An external catalog table in buckets by its keys: joins by all of them read it without a shuffle."""
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)


def write_clustered(rows: DataFrame, path: str, key: str = "flight_id", group_rows: int = 100_000) -> None:
    """Rows in the order of a key, in row groups of bounded size: a bound on the key leaves out whole files and groups."""
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    ordered.write.mode("errorifexists").option("parquet.block.row.count.limit", group_rows).parquet(path)
