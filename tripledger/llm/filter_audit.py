"""How five text filters interact: what each removes in every order in which they may be applied.

1. One pass over the texts gives the flags of the filters that look at one text, and the SHA-256 of the text; these short
   rows are stored, and no text is read again.
2. Counting Bloom prepass: tasks count their digests in two slots each and send the touched counters by pages of slots;
   pages are added up, and slots counted twice or more stay as bits. A text with a slot that was counted once is unique.
3. Only the digests of the other rows shuffle: the smallest id of each whole text tells which of them repeat an earlier one.
4. Each row's flags make one of 32 masks. The counts of the masks per part, with those of labelled rows, add up to every
   figure of every order, so the orders are never applied to rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import stored, tidied
from tripledger.operators.keep import join_once

#: The filters; filter k has bit 2**k of a mask. E is the one that compares texts.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bytes of a text that are split into words at a time.
PIECE = 4_000_000
#: Counters of a page, counters per row, and at most (2**28 bits are 32 MB). Fuller, the sketch lets more digests shuffle.
PAGE, SLOTS_PER_ROW, MAX_SLOTS = 1 << 16, 8, 1 << 28
#: Digests that a task counts before it sends their pages.
COUNTED = 1 << 20
DIGEST = ["d0", "d1", "d2", "d3"]
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_ODD = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(65, 91))


def word_counts(data: bytes) -> tuple[int, int]:
    """Words and distinct words, of a long text in pieces that end at a blank."""
    n, seen, lo = 0, set(), 0
    while lo < len(data):
        cut = _BLANK.search(data, lo + PIECE)
        hi = cut.start() if cut else len(data)
        words = data[lo:hi].split()  # on bytes: blank, tab, line feed, vertical tab, form feed, return
        n += len(words)
        seen.update(words)
        lo = hi
    return n, len(seen)


def own_flags(data: bytes, points: int) -> int:
    """Bits of the filters that look at one text of so many code points."""
    words, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, _UPPER))
    return (words < 100) + 2 * (100 * distinct < 80 * words) + 4 * (100 * capitals > 10 * points) + 8 * (_ODD.search(data) is not None)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per input row: doc_id, part, flags (bits of A to D) and the SHA-256 of the text as four whole numbers."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False)
            texts = batch.column(2).cast(pa.binary())
            flags, digests = np.empty(len(texts), np.int32), bytearray()
            for i, n in enumerate(points):
                data = texts[i].as_py()
                flags[i] = own_flags(data, int(n))
                digests += hashlib.sha256(data).digest()
            parts = np.frombuffer(bytes(digests), "<i8").reshape(-1, 4)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(flags), *[pa.array(parts[:, k].copy()) for k in range(4)]],
                                  names=["doc_id", "part", "flags", *DIGEST])

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    return kept.mapInArrow(rows, "doc_id long, part string, flags int, " + ", ".join(f"{d} long" for d in DIGEST))


def _slots(first: np.ndarray, second: np.ndarray, slots: int) -> np.ndarray:
    """The two slots of each digest, by two of its four numbers; one slot is never counted twice for a row."""
    a, b = first & (slots - 1), second & (slots - 1)
    return np.concatenate([a, np.where(a == b, (b + 1) & (slots - 1), b)])


def repeated_slots(facts: DataFrame, slots: int) -> np.ndarray:
    """The merged sketch as bits: slots that were counted twice or more. At most MAX_SLOTS bits come back."""

    def pages(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slot, times = np.unique(np.concatenate(found), return_counts=True)
        page, at = slot // PAGE, (slot % PAGE).astype("<u2")
        times = np.minimum(times, 255).astype(np.uint8)
        cuts = np.flatnonzero(np.diff(page, prepend=-1))
        ends = [*cuts[1:], len(page)]
        yield pa.record_batch([
            pa.array(page[cuts].astype(np.int32)), pa.array([at[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
            pa.array([times[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["page", "at", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                found.append(_slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), slots))
            if sum(map(len, found)) >= 2 * COUNTED:
                yield from pages(found)
                found = []
        if found:
            yield from pages(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}  # pages of this task: a share of the slots, whose number is bounded
        for batch in batches:
            for page, at, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = counters.setdefault(page, np.zeros(PAGE, np.uint8))
                spots = np.frombuffer(at, "<u2")
                own[spots] = np.minimum(own[spots].astype(np.int32) + np.frombuffer(times, np.uint8), 255)
        for page, own in counters.items():
            yield pa.record_batch([pa.array([page], pa.int32()), pa.array([np.packbits(own >= 2, bitorder="little").tobytes()], pa.binary())],
                                  names=["page", "bits"])

    sent = facts.select("d0", "d1").mapInArrow(count, "page int, at binary, times binary").repartition("page")
    whole = np.zeros(slots // 8, np.uint8)
    for page, bits in zip(*sent.mapInArrow(tidied(merge), "page int, bits binary").toArrow().to_pydict().values(), strict=True):
        whole[page * PAGE // 8:(page + 1) * PAGE // 8] = np.frombuffer(bits, np.uint8)[:slots // 8]
    return whole


def flagged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per input row: doc_id, part and mask, the bits of all filters that the row fails."""
    facts = stored(features(docs, doc_id, text, part), "audit")
    slots = PAGE
    wanted = SLOTS_PER_ROW * facts.count()
    while slots < min(wanted, MAX_SLOTS):
        slots *= 2
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_slots(facts, slots))

    @F.pandas_udf("boolean")
    def maybe_repeated(first: pd.Series, second: pd.Series) -> pd.Series:
        at = _slots(first.to_numpy(np.int64), second.to_numpy(np.int64), slots)
        hit = (sketch.value[at >> 3] >> (at & 7) & 1).astype(bool)
        return pd.Series(hit[:len(first)] & hit[len(first):])

    marked = facts.withColumn("maybe", maybe_repeated("d0", "d1"))
    shared = marked.where("maybe").select("doc_id", "part", "flags", *DIGEST)
    firsts = shared.groupBy(*DIGEST).agg(F.min("doc_id").alias("first"))
    again = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    alone = marked.where("not maybe").select("doc_id", "part", F.col("flags").alias("mask"))
    return alone.unionByName(
        join_once(shared, firsts, DIGEST).select("doc_id", "part", (F.col("flags") + F.when(again, 16).otherwise(0)).cast("int").alias("mask")))


def mask_counts(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows per part and mask: n, and of them good and toxic ones by the labels of their id."""
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = join_once(rows.where("doc_id is not null"), marks, ["doc_id"], "left").unionByName(
        rows.where("doc_id is null"), allowMissingColumns=True)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def _bits(letters: Column) -> Column:
    return sum((F.when(letters.contains(f), 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))


def orders_of(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from the counts of the masks alone."""
    steps = counts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("own", _bits(F.expr("substr(filter_order, step, 1)"))).withColumn("before", _bits(F.expr("substr(filter_order, 1, step - 1)")))
    fails, passed = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0

    def total(test: Column, what: Column | str, name: str) -> Column:
        return F.sum(F.when(test, what if isinstance(what, Column) else F.col(what)).otherwise(0)).cast("long").alias(name)

    # a filter that a row fails together with others removes it in an equal share of the orders
    share = F.col("n") * F.expr(f"{len(ORDERS)} div greatest(bit_count(mask), 1)")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(passed & ~fails, "n", "kept"), total(passed & fails, "n", "removed"), total(~passed & fails, "n", "redundant"),
        total(F.col("mask") == F.col("own"), "n", "unique_fails"), total(passed & fails, "good", "good_lost"),
        total(passed & fails, "toxic", "toxic_lost"), total(fails, share, "shapley"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A row fails A with under 100 words, B if fewer than 80 % of its words are distinct, C if more than 10 % of its code
    points are A-Z, D if it holds one of ``#$%&*|``, E if a row with a smaller id has the same text. Null text is empty
    text, a null part the empty one. Each row counts, also rows that repeat an id, which are not copies of each other. A
    row with a null id is later than all others and has no label. Labels may repeat an id: one that says 1 is enough.
    Other columns are not read, so their names cannot clash; an empty table gives an empty table.
    """
    return orders_of(mask_counts(flagged(docs, doc_id, text, part), labels))
