"""Lines that many documents share, dropped by DataFrame functions alone.

1. Every text is split at line ends. A line's key is the line without blanks at its ends, A-Z in lower case; only keys of
   ``points`` code points or more count. The distinct keys of a document are exploded and hashed, and one aggregate,
   combined before its shuffle, counts the documents of each hash and finds the largest id.
2. Keys of enough documents are stored. Lines are hashed again with their position and joined with them; Spark broadcasts
   the stored keys if their size allows it, else both sides shuffle for this join alone, so that a hot line can be split.
   What a document loses is a sorted list of positions.
3. Texts that lose nothing pass straight through: a filter of bounded size tells them. The others are joined with their
   positions, and the runs of lines between lost ones are put together again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import stored
from tripledger.operators.keep import computed

#: Least code points of a key that counts, and documents from which on it is shared.
POINTS, DOCS = 40, 5
BLANK_ENDS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of the filter: per text that loses lines, at least and at most (2**24 bits are 2 MB). Fuller, it lets more texts shuffle.
FILTER_BITS = (16, 1 << 12, 1 << 24)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK_ENDS))


def lowered(line: Column) -> Column:
    """A-Z in lower case and nothing else; of plain ASCII text that is what ``lower`` gives."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, UPPER.lower()))


def digest(text: Column) -> Column:
    """The first 16 bytes of SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def shared_lines(docs: DataFrame, points: int = POINTS, least_docs: int = DOCS) -> DataFrame:
    """Stored rows (line, last) from rows (doc_id, text): digests of keys of enough documents and their largest doc_id."""
    trimmed = F.filter(F.transform(lines_of(F.col("text")), bare), lambda line: F.char_length(line) >= points)
    keys = docs.select("doc_id", F.explode(F.array_distinct(F.transform(trimmed, lowered))).alias("key"))
    counted = keys.select("doc_id", digest(F.col("key")).alias("line")).groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    return stored(counted.where(F.col("n") >= least_docs).select("line", "last"), "lines")


def lost_positions(docs: DataFrame, shared: DataFrame, points: int = POINTS) -> DataFrame:
    """Stored rows (doc_id, mark, lost): sorted positions of the lines that the rows (doc_id, mark, text) lose.

    They follow from id and text alone, so rows that repeat both share a list.
    """
    lines = docs.select("doc_id", "mark", F.posexplode(lines_of(F.col("text"))).alias("at", "whole"))
    lines = lines.select("doc_id", "mark", "at", bare(F.col("whole")).alias("key")).where(F.char_length("key") >= points)
    lines = lines.select("doc_id", "mark", "at", digest(lowered(F.col("key"))).alias("line"))
    lost = lines.join(shared, "line").where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return stored(lost.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("at")).alias("lost")), "lost-lines")


def split_by(rows: DataFrame, listed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys are certainly not among those of ``listed``, and all others.

    The filter is a small table of 64-bit words, at most FILTER_BITS bits, so it may be broadcast whatever the input.
    """
    per_row, bits, most = FILTER_BITS
    while bits < min(most, per_row * listed.count()):
        bits *= 2
    spot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = listed.select(spot.alias("_spot")).groupBy(F.expr("_spot div 64").alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(_spot % 64 as int)))").alias("_bits"))
    seen = rows.withColumn("_spot", spot).withColumn("_word", F.expr("_spot div 64")).join(F.broadcast(words), "_word", "left")
    held = F.expr("coalesce(shiftright(_bits, cast(_spot % 64 as int)) & 1, 0) = 1")
    return seen.where(~held).select(*rows.columns), seen.where(held).select(*rows.columns)


def without_shared_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", points: int = POINTS, least_docs: int = DOCS, with_text: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept (the text that stays).

    Lines whose key many documents hold go everywhere but in the document with the largest id, where all of them stay.
    Null text is empty text: one empty line. Each row counts as a document, also one that repeats an id; rows that
    repeat the largest id all keep its lines. A null id is smaller than any other: rows with one lose a shared line unless
    they alone hold it. Other columns are not read, so their names cannot clash; an empty table gives an empty table.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text")).withColumn("mark", digest(F.col("text")))
    lost = lost_positions(rows, shared_lines(rows, points, least_docs), points)
    clear, touched = split_by(rows, lost, ["doc_id", "mark"])
    clear = clear.select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"),
        F.col("text").alias("kept"))
    theirs = lost.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "lost")
    met = touched.join(theirs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    # computed once per row, since the function below would split the text again for each run
    cut = computed(met.select("doc_id", "text", F.coalesce("lost", F.array().cast("array<int>")).alias("lost")), lines=lines_of(F.col("text")))
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), "lost"), F.concat("lost", F.array(F.size("lines"))),
        lambda before, after: F.slice("lines", before + 2, after - before - 1))
    cut = cut.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"),
        F.array_join(F.flatten(runs), "\n").alias("kept"))
    both = clear.unionByName(cut)
    digested = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return both.select("doc_id", "n_lines", "n_dropped", digested, *(["kept"] if with_text else []))
