"""What the text operators share: tables, shared scratch, word hashes and row numbers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import importlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
#: The characters between words.
BLANKS = r"[\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}
BLANK_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a temporary one, removed when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "own" not in _LOCAL:
        _LOCAL["own"] = tempfile.mkdtemp(prefix="tripledger-")
        atexit.register(shutil.rmtree, _LOCAL["own"], ignore_errors=True)
    return _LOCAL["own"]


def held(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, with their lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: remainder 2 of the id's checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the position of each row (from 0) in ``order``, by a range sort and offsets per sorted part.

    ``order`` must identify a row. No task sees more than its range.
    """
    from pyspark.sql import Window

    part = f"{name}_part"
    spread = held(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in spread.groupBy(part).count().collect())  # one row per part of the sort
    starts, seen = [], 0
    for p, n in counts:
        starts.append((p, seen))
        seen += n
    first = dict(starts)
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col(part)) if first else F.lit(0)
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return spread.withColumn(name, (offset + inside).cast("long")).drop(part)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit values (public domain constants of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: for results with many rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a row key that tell rows of one file apart.
ROW_BITS = 30


def with_rows(docs: DataFrame) -> DataFrame:
    """The rows with ``_row``: a number of each row, so that a decision holds for a row and not for an id.

    Rows of a Parquet scan are numbered by their file and their place in it, which costs no copy: files get numbers by a
    hash of their path under a seed that keeps them apart. Other rows are stored once.
    """
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        files = docs.select(path.alias("path")).distinct()  # one row per file
        numbered_ = docs.select("*", path.alias("_path"), place.alias("_place"))
    except AnalysisException:
        return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    paths = held(files)
    count = paths.count()
    bits = min(62 - ROW_BITS, max(1, 2 * count.bit_length() + 4))
    number = lambda c, seed: F.xxhash64(c, F.lit(seed)).bitwiseAND((1 << bits) - 1)
    for seed in range(64):
        if paths.select(number(F.col("path"), seed)).distinct().count() == count:
            key = F.shiftleft(number(F.col("_path"), seed), ROW_BITS) + F.col("_place")
            return numbered_.withColumn("_row", key).drop("_path", "_place")
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose ``_row`` is not among those of ``gone``.

    Rows that a filter of bounded size clears pass straight through; only those that may be gone are shuffled.
    """
    gone = held(gone.select("_row"))
    listed = id_filter(gone)
    marked = rows.withColumn("_maybe", listed(F.col("_row")))
    checked = marked.where("_maybe").join(gone, "_row", "left_anti")
    return marked.where("not _maybe").unionByName(checked).drop("_maybe")


#: Bits of a filter of ids: at least, per id, and at most (2**27 bits are 16 MB). Beyond that it lets more rows pass.
FILTER_BITS = (1 << 16, 8, 1 << 27)


def id_filter(ids: DataFrame) -> Callable[[Column], Column]:
    """A condition that holds for every id of the one column of ``ids``, and for few others.

    It is broadcast as bits, whose number is bounded: it only spares rows that a join would drop a shuffle.
    """
    spark, column = ids.sparkSession, ids.columns[0]
    least, per_row, most = FILTER_BITS
    bits = least
    while bits < min(most, per_row * ids.count()):
        bits *= 2
    spots = ids.select(F.pmod(F.xxhash64(F.col(column)), F.lit(bits)).alias("spot"))
    words = spots.groupBy(F.expr("spot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot % 64 as int)))").alias("bits"))
    table = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():  # at most FILTER_BITS bits
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def listed(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return lambda c: listed(F.pmod(F.xxhash64(c), F.lit(bits)))


#: What workers drop when a task ends, as idle ones stay for the next task.
AT_END: list[Callable[[], None]] = []


def tidied(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that gives its memory back when it ends, as idle Python workers stay for the next task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            for drop in importlib.import_module(__name__).AT_END:  # those of the worker, not a copy sent with the task
                drop()
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
            if trim is not None:
                trim(0)

    return run


def tagged(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with ``tag``: 0, or a hash of the text if the id may be repeated.

    With the id it tells texts apart that share an id; equal texts of one id have the same places anyway.
    """
    repeated = held(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return rows.withColumn("tag", F.lit(0).cast("long"))
    listed = id_filter(repeated)
    return rows.withColumn("tag", F.when(F.col("doc_id").isNotNull() & listed(F.col("doc_id")), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))


#: Sent rows of one key from which it is split, and the bytes and least share of the text in which they are counted.
HOT_ROWS = 50_000
COUNTED_BYTES, COUNTED_SHARE = 16_000_000, 1 / 1000


def hot_keys(rows: DataFrame, total: int, counted: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> np.ndarray:
    """Sorted keys (unsigned) of which about HOT_ROWS or more rows would be sent, by the counts (key, n) that ``counted``
    gives for a sample of the rows. It only decides how rows are dealt: results do not depend on it. As a key counts
    from a fixed number of rows on, at most so many come back as the total holds of it."""
    share = max(COUNTED_SHARE, min(1.0, COUNTED_BYTES / max(1, total)))
    found = (
        (rows if share == 1 else rows.sample(fraction=share, seed=1)).mapInArrow(tidied(counted), "key long, n long")
        .groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2.0, HOT_ROWS * share)).select("key").toArrow()
    )
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def among(keys: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which ``keys`` are in the sorted ``listed``."""
    if not len(listed):
        return np.zeros(len(keys), bool)
    return listed[np.minimum(np.searchsorted(listed, keys), len(listed) - 1)] == keys


def key_counts(keys: np.ndarray) -> pa.RecordBatch:
    keys, n = np.unique(keys, return_counts=True)
    return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])
