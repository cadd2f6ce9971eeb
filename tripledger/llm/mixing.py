"""Sources mixed to target weights along a curriculum that changes over training.

A source's share at training time t (0 to 1) is its weight times 1 + tilt * (2t - 1), so that its integral over the run is
its weight. The words demanded of it up to t are target * (t + tilt * (t * t - t)); the inverse of that curve assigns
every word of the source, in the order of passes over its shuffled documents, a training position. A range sort by
position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import WORD, held, numbered, with_rows

#: Contract of the registered query: weights in the order of the sources, repeating; words taken in all as a share of
#: all words; passes over a source at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
#: Tilts of the schedules, repeating in the order of the sources: early sources fade, late ones grow.
TILTS = (-0.5, 0.5, 0.0)
#: Documents of a block in which running sums are taken.
BLOCK_ROWS = 2000


def _repeating(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % len(values) + 1).cast("int"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, tilts: tuple = TILTS) -> DataFrame:
    """source, source_size, weight, tilt, target from source, source_size.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all words by weight; a target stops
    at ``passes`` times its source, and the excess is shared again by weight until none is above. Each turn is one
    aggregate over the sources that brings two sums back.
    """
    ordered = numbered(sources.withColumn("_none", F.col("source").isNull()), ["_none", "source"], "rank")
    table = held(ordered.select("source", "source_size", _repeating(weights, F.col("rank")).alias("weight"),
                                _repeating(tilts, F.col("rank")).alias("tilt")))
    most = F.col("source_size") * F.lit(passes)
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= most
        row = table.agg(F.sum(F.when(full, most).otherwise(0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
                        F.sum(full.cast("int")).alias("n")).first()
        if not row["open"] or row["n"] == capped:
            break
        level, capped = (total - row["taken"]) / row["open"], row["n"]
    return table.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(level)) if row["open"] else most.cast("double"))


def walked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None, **how) -> DataFrame:
    """One row per input row: _row, doc_id, size, source_size, target, taken, first, tilt.

    Size counts words (null text: 0). A source's documents are walked in the order of a checksum of the id, as often as
    its target asks; in the last pass the document where the target is reached gives only the words that are left, so
    ``taken`` is at most ``passes`` times the size and each source's sum is its target to a word. ``first`` counts the words
    of the source before the document in a pass. Empty sources have target 0; rows that repeat an id have equal rows
    where their order does not matter, and are walked one after the other otherwise. A column ``row`` that tells rows
    apart comes along as ``_row`` and orders what the checksum and the size do not; without one, rows are numbered as they
    are stored. Other columns are not read.
    """
    passes = how.get("passes", PASSES)
    sized = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = held(sized.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    # blocks of the sorted marks of each source, so that a source with a third of all rows is many blocks
    rows = rows.withColumn("block", F.floor(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * F.lit(blocks) / F.lit(1 << 32)).cast("long"))
    parts = held(rows.groupBy("source", "block").agg(F.sum("size").alias("words")))
    plan = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), **how)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("_source"), F.col("block").alias("_block"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "block").orderBy("mark", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = (
        counted.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
        .join(plan.select(F.col("source").alias("_own"), "source_size", "tilt", "target"), F.col("source").eqNullSafe(F.col("_own")))
        .withColumn("first", F.col("start") + F.col("ahead"))
    )
    words = F.floor(F.col("target"))
    laps = F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0)
    rest = words - laps * F.col("source_size")
    taken = laps * F.col("size") + F.least(F.greatest(rest - F.col("first"), F.lit(0)), F.col("size"))
    return placed.withColumn("taken", F.least(taken, F.col("size") * passes).cast("long")).select(
        "_row", "doc_id", "size", "source_size", "target", "taken", "first", "tilt")


def repetitions(walk: DataFrame) -> DataFrame:
    """The rows of ``walked`` once per repetition that the mix takes: words (taken in this one), position (when demanded).

    Only the last repetition of a document may have fewer words than the document. A document of which nothing is taken
    has one row without words and position.
    """
    turns = F.greatest(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int"), F.lit(1))
    lapped = walk.withColumn("lap", F.explode(F.sequence(F.lit(0), turns - 1)))
    at = when_demanded(F.col("first") + F.col("lap") * F.col("source_size"), F.col("target"), F.col("tilt"))
    return lapped.withColumn("words", F.least("size", F.col("taken") - F.col("lap") * F.col("size"))).withColumn(
        "position", F.when(F.col("words") > 0, at))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None, **how) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, position (null if nothing is taken), positions, first, tilt.

    All repetitions of all documents are put in training order by a range sort and numbered. From that order follow the words
    ``taken`` of a document, the training time ``position`` of its first word and the ``positions`` of all its repetitions.
    The other columns, nulls and repeated ids are those of ``walked``; a column ``row`` comes along.
    """
    named = ["_row", "doc_id", "size", "source_size", "target", "first", "tilt"]
    placed = numbered(repetitions(walked(docs, doc_id, text, source, row, **how)), ["position", "_row", "lap"], "place")
    turns = F.transform(F.sort_array(F.collect_list(F.when(F.col("words") > 0, F.struct("place", "position")))), lambda t: t["position"])
    return placed.groupBy(*named).agg(F.sum("words").alias("taken"), turns.alias("positions")).select(
        "doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), "positions", "first", "tilt",
        *([F.col("_row").alias(row)] if row else []))


def when_demanded(words: Column, target: Column, tilt: Column) -> Column:
    """The time at which a source's demand reaches ``words``: the inverse of t + tilt * (t * t - t) at words / target."""
    x = F.least(words / target, F.lit(1.0))
    square = (1 - tilt) * (1 - tilt) + 4 * tilt * x
    return F.when(tilt == 0, x).otherwise(2 * x / ((1 - tilt) + F.sqrt(square)))


def training_order(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes from them, range-sorted by position; all columns as they came.

    A document of which the mix takes less than a whole repetition comes whole in it, as texts are not cut. Each row,
    also one with a null or a repeated id, comes as often as the mix takes from that row.
    """
    rows = with_rows(docs)
    took = repetitions(walked(rows, row="_row").where("taken > 0")).select("_row", F.col("position").alias("_at"))
    copies = rows.join(took, "_row")
    order = ["_at", "doc_id", "_row"]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
