"""CSV files as records, read by many tasks also where quoted fields hold line ends.

A split of a file cannot tell by itself whether it begins inside a quoted field. But every quote character flips that
state, doubled quotes flip it twice, and so the number of quotes before a line decides it:

1. Every split numbers its lines and counts their quotes.
2. The splits of a file, one short row each, are summed in order: a split begins inside a field if the number of quotes
   before it is odd. The same rows carry how many records start in a split and which record runs into it.
3. A line that begins outside a field starts a record. Records of one line are done; the lines of the others are joined,
   also over several splits.

All files of a call are read by the same two scans, one for the quotes and one for the records. A file with an odd number of quotes has its last record run to its end, as for any reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.functions.text import strip
from tripledger.sources.files import scanned_path

#: How fields are read: quotes inside a quoted field are doubled.
DIALECT = {"quote": '"', "escape": '"'}


def csv_records(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """One row per record that is not blank: path, head (the first of its file), at (its place: split, number), record (its text).

    ``pattern`` picks files by name anywhere below the paths, without listing them first.
    """
    reader = spark.read.option("lineSep", "\n")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    lines = reader.text(paths).select(
        scanned_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    split = Window.partitionBy("path", "block")
    ordered = split.orderBy("line")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("quotes", quotes).withColumn("odd", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)

    pieces = counted.groupBy("path", "block").agg(
        F.sum("quotes").alias("total"), F.count_if(F.col("odd") == 0).alias("even"), F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("inside", F.coalesce(F.sum("total").over(before), F.lit(0)) % 2)
    starts = F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("lines") - F.col("even"))
    pieces = pieces.withColumn("starts", starts).withColumn(
        "owner", F.last(F.when(F.col("starts") > 0, F.struct("block", "starts")), ignorenulls=True).over(before))

    begins = (F.col("odd") + F.col("inside")) % 2 == 0
    marked = counted.join(pieces.select("path", "block", "inside", "owner"), ["path", "block"]).withColumn("begins", begins)
    marked = marked.withColumn("number", F.sum(F.col("begins").cast("long")).over(ordered))
    named = F.col("begins") & (strip(F.col("value")) != "") & (F.col("block") == 0)
    own = F.col("number") > 0
    marked = marked.select(
        "path", "block", "line", "value", "begins",
        F.struct(F.when(own, F.col("block")).otherwise(F.col("owner.block")).alias("block"), F.when(own, F.col("number")).otherwise(F.col("owner.starts")).alias("number")).alias("at"),
        (own & (F.col("number") == F.min(F.when(named, F.col("number"))).over(split))).alias("head"),
        (F.col("begins") & F.lead("begins").over(ordered)).alias("alone"))
    alone = F.coalesce("alone", F.lit(False))  # the last line of a split may run on
    single = marked.where(alone).select("path", "head", "at", F.col("value").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    joined = marked.where(~alone).groupBy("path", "at").agg(F.max("head").alias("head"), parts.alias("parts")).select(
        "path", "head", "at", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    ended = F.regexp_replace("record", r"\r\z", "")
    return single.unionByName(joined).withColumns({"head": F.coalesce("head", F.lit(False)), "record": ended}).where(strip(F.col("record")) != "")


def column_count(record: Column) -> Column:
    """Fields of a record: commas outside quotes, and one more."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def fields_of(record: Column, n: int) -> Column:
    """The first ``n`` fields of a record as a struct of texts f0, f1, ...; an empty field is NULL."""
    return F.from_csv(record, ", ".join(f"f{i} string" for i in range(n)), DIALECT)


def field_array(record: Column, n: int) -> Column:
    """The first ``n`` fields of a record as an array."""
    return F.transform(F.array(fields_of(record, n)), lambda f: F.array(*[f[f"f{i}"] for i in range(n)]))[0]
