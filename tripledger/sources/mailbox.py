"""Mailbox files, read by the splittable text source with one row per message."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions.mail import header
from tripledger.functions.mime import body_of
from tripledger.sources.files import base_name, scanned_path

# Envelope line, header block, then (after the first blank line) the body.
_HEADERS = r"(?s)\A[^\n]*(?:\n(.*?))??(?:\r?\n\r?\n|\z)"
_BODY = r"(?s)\A[^\n]*(?:\n.*?)??\r?\n\r?\n(.*)\z"


ANY_MAILBOX = "*.[mM][bB][oO][xX]"


def named(names: Iterable[str]) -> str:
    """A file pattern for exactly these names; names without a file are skipped by the scan."""
    return "{" + ",".join(re.sub(r"([\\{}\[\],*?])", r"\\\1", n) for n in names) + "}"


def _records(spark: SparkSession, paths: str | list[str], pattern: str | None) -> DataFrame:
    """Raw records. Every line that starts with ``From `` begins a message, as the format says."""
    reader = spark.read.option("lineSep", "\nFrom ")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    lines = reader.text(paths)
    path = scanned_path()
    source = F.col("source_file") if "source_file" in lines.columns else base_name(path)
    first = F.col("value").startswith("From ")
    record = F.when(first, F.expr("substr(value, 6)")).otherwise(F.col("value"))
    return lines.select(source.alias("source_file"), path.alias("source_path"), record.alias("record")).where("record <> ''")


def scan_headers(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """source_file, source_path, headers, from_hdr, subject, date_hdr of every message; no body.

    ``pattern`` picks files by name anywhere below the paths, without listing them first.
    """
    found = _records(spark, paths, pattern).select(
        "source_file", "source_path", F.regexp_extract("record", _HEADERS, 1).alias("headers")
    )
    return _with_names(found)


def scan_messages(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """As ``scan_headers`` plus ``body_raw`` (text) and ``message`` (bytes from the headers on)."""
    block = F.regexp_extract("record", _HEADERS, 1)
    body = F.regexp_extract("record", _BODY, 1)
    start = F.locate("\n", F.col("record"))
    raw = F.expr("substr(record, locate('\\n', record) + 1)").cast("binary")
    found = _records(spark, paths, pattern).select(
        "source_file",
        "source_path",
        block.alias("headers"),
        body.alias("body_raw"),
        F.when(start > 0, raw).alias("message"),
    )
    return _with_names(found)


def _with_names(found: DataFrame) -> DataFrame:
    block = F.col("headers")
    return found.select(
        *found.columns,
        header(block, "From").alias("from_hdr"),
        header(block, "Subject").alias("subject"),
        header(block, "Date").alias("date_hdr"),
    )


def with_bodies(messages: DataFrame) -> DataFrame:
    """Adds ``body`` and ``error`` to scanned messages. Filter on headers before this stage."""
    read = body_of(F.col("headers"), F.col("body_raw"), F.col("message"))
    staged = messages.withColumn("_read", read)
    return staged.select(
        *[c for c in messages.columns if c not in ("body_raw", "message")],
        F.col("_read.body").alias("body"),
        F.col("_read.error").alias("error"),
    )
