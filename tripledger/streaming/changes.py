"""Register changes as they arrive, applied by Structured Streaming to a store of buckets.

Layout: extendible hashing. A bucket holds the keys whose hash ends in its bits; its label spells them (``b`` is the
bucket of all keys, ``b01`` that of hashes ending in 01). The directory names the buckets, the folders in which each has
rows, and how many. A batch reads the buckets of its keys only and adds the new images of the rows that it changed. A
bucket whose rows, old images included, pass the store's limit is folded to its current rows, which go to the
same bucket or, if they still fill more than half of it, to buckets with more bits. So the number of buckets, and of the tasks
that read and write them, follows the data.

Commit: rows and rejects of an attempt go to folders of their own. The directory of the batch is written last, in one
file, and names them; readers start from the last directory and see a batch whole or not at all. A batch that runs again
after it was committed does nothing; one that broke off before leaves folders that no directory names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tripledger.operators.keep import keep_last
from tripledger.operators.register import REGISTER_SCHEMA, checked, decide

#: Rows of a bucket, old images included, above which it is folded and, if need be, split.
BUCKET_ROWS = 1_000_000
#: Hash bits that labels may spell; keys that agree in all of them stay in one bucket.
MAX_BITS = 24
_ROWS = T.StructType([
    *REGISTER_SCHEMA.fields, T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType()), T.StructField("bucket", T.StringType())])
_ENTRY = "label string, rows long, folders array<string>, rejects string, bucket_rows long, batch long"


@dataclass
class Directory:
    """What a store holds after ``batch``: rows and folders of each bucket. Its size is that of a list of files."""

    batch: int
    bucket_rows: int
    rows: dict[str, int]
    folders: dict[str, list[str]]

    @property
    def bits(self) -> int:
        return max(map(len, self.rows)) - 1


def bucket_of(labels: Iterable[str]) -> Column:
    """The label of a key's bucket, which is the one that its hash ends in."""
    bits = max(map(len, labels)) - 1
    slots = {}
    for label in labels:
        for rest in range(1 << bits - len(label) + 1):
            slots[rest << len(label) - 1 | int(label[1:] or "0", 2)] = label
    names = F.split(F.lit(" ".join(slots[k] for k in range(1 << bits))), " ")
    return F.get(names, F.xxhash64("flight_id").bitwiseAND((1 << bits) - 1).cast("int"))


def _refined(label: str, more: int) -> list[str]:
    """The labels that have so many more bits; together they hold the same keys."""
    return [f"b{k:0{more}b}{label[1:]}" for k in range(1 << more)] if more else [label]


def _bits_for(rows: int, bucket_rows: int) -> int:
    """Bits that cut so many rows in buckets of at most half the limit."""
    more = 0
    while rows >> more > bucket_rows // 2:
        more += 1
    return more


def _write(rows: DataFrame, labels: Iterable[str], store: str, batch: int, attempt: str) -> str:
    """Rows in bucket folders of a new attempt; a bucket's rows meet in one task, which its size allows."""
    folder = f"batch={batch}/attempt={attempt}"
    placed = rows.select(*REGISTER_SCHEMA.names, bucket_of(labels).alias("bucket"))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{store}/data/{folder}")
    return folder


def _counts(spark: SparkSession, store: str, folder: str) -> dict[str, int]:
    """Rows per bucket of a written folder, from the file footers; one row per bucket."""
    rows = spark.read.schema(_ROWS).option("basePath", f"{store}/data").parquet(f"{store}/data/{folder}")
    return {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}


def _commit(spark: SparkSession, store: str, directory: Directory, rejects: str | None) -> None:
    """Writes the directory of a batch, in one file."""
    entries = [(k, n, directory.folders[k], rejects, directory.bucket_rows) for k, n in directory.rows.items()]
    schema = _ENTRY.removesuffix(", batch long")
    spark.createDataFrame(entries, schema).coalesce(1).write.mode("overwrite").json(f"{store}/directory/batch={directory.batch}", ignoreNullFields=False)


def _entries(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(_ENTRY).json(f"{store}/directory")


def read_directory(spark: SparkSession, store: str, before: int | None = None) -> Directory:
    """The last committed directory, or the last before a batch."""
    entries = _entries(spark, store)
    entries = entries if before is None else entries.where(F.col("batch") < before)
    found = entries.where(F.col("batch") == (entries.agg(F.max("batch")).first()[0])).collect()
    return Directory(found[0]["batch"], found[0]["bucket_rows"], {r["label"]: r["rows"] for r in found}, {r["label"]: r["folders"] for r in found})


def start_store(register: DataFrame, store: str, bucket_rows: int = BUCKET_ROWS) -> None:
    """Writes the register in as many buckets as its size asks for, and the first directory (batch -1)."""
    spark = register.sparkSession
    labels = _refined("b", min(MAX_BITS, _bits_for(register.count(), bucket_rows)))
    folder = _write(register, labels, store, -1, uuid.uuid4().hex)
    counts = _counts(spark, store, folder)
    first = Directory(-1, bucket_rows, {k: counts.get(k, 0) for k in labels}, {k: [folder] if counts.get(k) else [] for k in labels})
    _commit(spark, store, first, None)


def stored_images(spark: SparkSession, store: str, directory: Directory, labels: Iterable[str] | None = None) -> DataFrame:
    """All images of the rows in some or all buckets of a directory; no other file is listed or read."""
    paths = [f"{store}/data/{folder}/bucket={k}" for k in (directory.rows if labels is None else labels) for folder in directory.folders[k]]
    if not paths:
        return spark.createDataFrame([], _ROWS)
    return spark.read.schema(_ROWS).option("basePath", f"{store}/data").parquet(*paths)


def _current(images: DataFrame) -> DataFrame:
    return keep_last(images, ["flight_id"], ["batch"]).select(*REGISTER_SCHEMA.names)


def current_register(spark: SparkSession, store: str) -> DataFrame:
    """The register after the last committed batch."""
    return _current(stored_images(spark, store, read_directory(spark, store)))


def compact(spark: SparkSession, store: str, into: str, bucket_rows: int = BUCKET_ROWS) -> str:
    """Starts a new store from the current rows of one; the old one stays as it is."""
    start_store(current_register(spark, store), into, bucket_rows)
    return into


def rejected_changes(spark: SparkSession, store: str) -> DataFrame:
    """What all committed batches refused."""
    folders = [r["rejects"] for r in _entries(spark, store).where("rejects is not null").select("rejects").distinct().collect()]  # one per batch
    schema = "ord long, op string, flight_id string, code string, message string"
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{store}/{f}" for f in folders])


def _is_committed(spark: SparkSession, store: str, batch: int) -> bool:
    return not _entries(spark, store).where(F.col("batch") == batch).isEmpty()


def apply_batch(batch: DataFrame, number: int, store: str) -> None:
    """Applies one batch of change rows to the store."""
    spark = batch.sparkSession
    if _is_committed(spark, store, number):
        return
    attempt, before = uuid.uuid4().hex, read_directory(spark, store, number)
    rows = checked(batch).persist()
    decided = None
    try:
        label = bucket_of(before.rows)
        keys = rows.where("code IS NULL").select(F.col("key").alias("flight_id"))
        touched = [r["label"] for r in keys.select(label.alias("label")).distinct().collect()]  # at most one per bucket
        outcome = decide(_current(stored_images(spark, store, before, touched)), rows, narrowed=True)
        decided = outcome.decided = outcome.decided.persist()  # images and rejects follow from the same verdicts
        folder = _write(outcome.changed, before.rows, store, number, attempt)
        rejects = f"rejects/batch={number}/attempt={attempt}"
        outcome.rejects.write.parquet(f"{store}/{rejects}")
    finally:
        rows.unpersist()
        if decided is not None:
            decided.unpersist()
    after = Directory(number, before.bucket_rows, dict(before.rows), {k: list(f) for k, f in before.folders.items()})
    for k, n in _counts(spark, store, folder).items():
        after.rows[k] += n
        after.folders[k].append(folder)
    _commit(spark, store, _folded_buckets(spark, store, after, attempt), rejects)


def _folded_buckets(spark: SparkSession, store: str, directory: Directory, attempt: str) -> Directory:
    """The directory after buckets above the limit were folded and split."""
    full = [k for k, n in directory.rows.items() if n > directory.bucket_rows]
    if not full:
        return directory
    current = _current(stored_images(spark, store, directory, full))
    live = {r["label"]: r["count"] for r in current.groupBy(bucket_of(directory.rows).alias("label")).count().collect()}  # one row per bucket
    rows = {k: n for k, n in directory.rows.items() if k not in full}
    split = [label for k in full for label in _refined(k, min(MAX_BITS + 1 - len(k), _bits_for(live.get(k, 0), directory.bucket_rows)))]
    folder = _write(current, [*rows, *split], store, directory.batch, f"{attempt}-folded")
    counts = _counts(spark, store, folder)
    folders = {k: f for k, f in directory.folders.items() if k in rows} | {k: [folder] if counts.get(k) else [] for k in split}
    return Directory(directory.batch, directory.bucket_rows, rows | {k: counts.get(k, 0) for k in split}, folders)


def delivered_once(changes: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """A stream of change rows without repeated deliveries.

    A change whose ``key`` came before is dropped if it comes again ``within`` that time of event time (column ``at``).
    The state holds the keys of that time only, so it does not grow with the stream.
    """
    timed = changes.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", within)
    return timed.dropDuplicatesWithinWatermark([key]).drop("_at")


def apply_change_stream(changes: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over a change source and stops when what is there has been applied."""
    return (
        changes.writeStream.foreachBatch(lambda batch, number: apply_batch(batch, number, store))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
