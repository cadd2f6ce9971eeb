"""Exact copies by a two-pass Bloom filter.

Pass one sets the slots of every text hash and keeps the slots that were set more than once. A hash all of whose slots
are in that filter may be repeated; any other hash is certainly alone. Pass two sends only the rows with possibly
repeated hashes through a shuffle, where the full digest decides; the rest pass straight through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import BLANKS, held, with_rows, without_rows

#: Filter slots per row, and the largest filter: 2**27 bits are 16 MB. Beyond it more rows shuffle; results stay exact.
SLOTS_PER_ROW = 16
MAX_SLOTS = 1 << 27
PAGE_BITS = 13


def normalised(text: Column) -> Column:
    """The text without blanks, tabs and line ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def slot_columns(digest: Column, slots: int) -> list[Column]:
    return [(F.xxhash64(digest, F.lit(seed)).bitwiseAND(slots - 1)).cast("int") for seed in (1, 2)]


def repeated_slots(rows: DataFrame, digest: str, slots: int) -> np.ndarray:
    """The filter: one bit per slot, set where more than one row falls. At most MAX_SLOTS bits come back."""
    twice = (
        rows.select(F.explode(F.array(*slot_columns(F.col(digest), slots))).alias("slot"))
        .groupBy("slot").count().where("count > 1")
        .groupBy(F.shiftright("slot", PAGE_BITS).alias("page"))
        .agg(F.collect_list(F.col("slot").bitwiseAND((1 << PAGE_BITS) - 1).cast("short")).alias("at"))
    )

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = []
            for at in batch["at"]:
                page = np.zeros(1 << PAGE_BITS, np.uint8)
                page[np.asarray(at, np.int64)] = 1
                bits.append(np.packbits(page, bitorder="little").tobytes())
            yield pd.DataFrame({"page": batch["page"], "bits": bits})

    whole = np.zeros(max(slots, 1 << PAGE_BITS) // 8, np.uint8)
    for row in twice.mapInPandas(pages, "page int, bits binary").collect():
        at = row["page"] << (PAGE_BITS - 3)
        whole[at:at + (1 << PAGE_BITS - 3)] = np.frombuffer(row["bits"], np.uint8)
    return whole


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest id, stays. Null text is empty text, and all
    empty texts are one group. Rows that repeat an id share its decision and each count in the group. A null id loses
    every tie. Other columns are not read, so their names cannot clash; an empty table gives an empty table.
    """
    alone, shared = _split(docs, doc_id, text)
    alone = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    # summed before the shuffle, so that a hot text sends one row per task
    groups = shared.groupBy("text_sha256").agg(
        F.count("*").alias("group_size"), F.max(F.struct("points", (-F.col("doc_id")).alias("less"))).alias("best"),
        F.max("dense").alias("dense"))
    # the second key makes both sides shuffle for the join alone, so that adaptive execution can split a hot text
    joined = shared.join(groups.select("text_sha256", "dense", "group_size", (-F.col("best.less")).alias("keep_id")),
                         ["text_sha256", "dense"])
    return alone.unionByName(joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def _split(docs: DataFrame, doc_id: str, text: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """The facts of rows whose text is certainly alone, and of all others; columns ``more`` come along."""
    spark = docs.sparkSession
    body = normalised(F.col(text))
    facts = held(docs.select(
        *more, F.col(doc_id).alias("doc_id"), F.sha2(body.cast("binary"), 256).alias("text_sha256"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"), F.length(body).alias("dense"),
    ))
    slots = 1 << PAGE_BITS
    wanted = facts.count() * SLOTS_PER_ROW
    while slots < min(wanted, MAX_SLOTS):
        slots *= 2
    filter_bits = spark.sparkContext.broadcast(repeated_slots(facts, "text_sha256", slots))

    @F.pandas_udf("boolean")
    def maybe_repeated(first: pd.Series, second: pd.Series) -> pd.Series:
        bits, found = filter_bits.value, np.ones(len(first), bool)
        for column in (first, second):
            at = column.to_numpy(np.int64)
            found &= (bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return pd.Series(found)

    marked = facts.withColumn("maybe", maybe_repeated(*slot_columns(F.col("text_sha256"), slots)))
    return marked.where("not maybe").drop("maybe"), marked.where("maybe").drop("maybe")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each equal text; all columns as they came.

    Rows are judged one by one: of equal texts the row with the most code points stays, then the smallest id, null last,
    then the first row, so that of rows that repeat an id and a text one stays too.
    """
    rows = with_rows(docs)
    _, shared = _split(rows, "doc_id", "text", "_row")
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("less"), (-F.col("_row")).alias("first")))
    stay = shared.groupBy("text_sha256").agg(best.alias("best")).select((-F.col("best.first")).alias("_row"))
    return without_rows(rows, shared.select("_row").join(stay, "_row", "left_anti")).select(*docs.columns)
