"""Keep one row per key, number the rows of a key, join hot keys, compute columns once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    They pass through a generator of one row. The optimiser moves filters on plain columns
    below their projection and so computes costly expressions twice; not through a generator.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def join_once(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a right side that has one row per key, while a left key may be hot.

    Adaptive execution splits a hot partition only when both sides come straight from a
    shuffle made for this join. A side that was just aggregated by the same keys does not, so
    the join is keyed by a hash column as well: both sides shuffle, and an aggregate by the
    plain keys afterwards combines the hot key per task and shuffles again.
    """
    hashed = F.xxhash64(*[F.col(k) for k in keys])
    joined = left.withColumn("_h", hashed).join(right.withColumn("_h", hashed), ["_h", *keys], how)
    return joined.drop("_h")


#: Bits of the filter of ``possible``: 2**24 bits are 2**18 words, a table of 4 MB whatever the input.
FILTER_BITS = 1 << 24


def possible(rows: DataFrame, keys: Sequence[str], listed: DataFrame) -> DataFrame:
    """The rows whose keys are among those of ``listed``, and a few others: a Bloom filter of one hash.

    It spares rows that a later join would drop their shuffle. The filter is a table of 64-bit words of bounded size, so
    it may be broadcast; with very many listed keys it lets more rows pass. Rows and ``listed`` share the key names.
    """
    spot = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)).alias("_spot")
    word = F.expr("_spot div 64").alias("_word")
    words = listed.select(spot).groupBy(word).agg(F.expr("bit_or(shiftleft(1L, cast(_spot % 64 as int)))").alias("_bits"))
    seen = rows.select("*", spot).select("*", word).join(F.broadcast(words), "_word")
    return seen.where("shiftright(_bits, cast(_spot % 64 as int)) & 1 = 1").select(*rows.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in the given order.

    Spark turns this filter into a group limit that runs before the shuffle as well, so a
    key that holds much of the data sends at most one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def keep_best(df: DataFrame, key: str, score: str, ties: Sequence[str]) -> DataFrame:
    """Highest score per key; equal scores by the tie columns ascending."""
    return keep_first(df, [key], [F.desc(score), *[F.asc(t) for t in ties]])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key."""
    return keep_first(df, keys, [F.desc(o) for o in order])


def row_index(df: DataFrame, keys: Sequence[str], ord_col: str, name: str, block: int = 1 << 20) -> DataFrame:
    """0-based position of a row among the rows of its key, by a whole-number order column.

    Rows are numbered inside blocks of the order column, and the blocks of a key are shifted
    by the counts before them. So no task sorts more than one block of a hot key, and the
    second window runs on one row per key and block.
    """
    at = [*keys, "_block"]
    blocked = df.withColumn("_block", F.floor(F.col(ord_col) / block))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        blocked.groupBy(*at)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(ord_col))
    numbered = blocked.withColumn("_inside", inside)
    return numbered.join(shifts, at, "left").select(
        *df.columns, (F.col("_before") + F.col("_inside") - 1).cast("long").alias(name)
    )
