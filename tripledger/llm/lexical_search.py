"""Ranked lexical search over an inverted index with per-term geometric blocks.

1. Forward rows: one pass over the texts counts the terms that the searches hold; the number of all terms of a document
   is kept with them. Terms that no search holds cannot add to a score and are not indexed. Statistics follow from these rows.
2. Index: tasks cut the documents in shards of bounded size, so that no posting list is ever whole in one task. In a
   shard each term's posting list is clustered by the similarity of its documents (random projections of their weighted
   term vectors, nearest of centres drawn from the list) into blocks of at most BLOCK documents. A block's summary holds
   the largest impact of every term among its documents, rounded up to UNIT. Lists of at most SHORT documents are one
   block without a summary.
3. Search: a task keeps the best documents of each search so far. In a shard it opens the lists of a search by falling
   weight, until the terms that are left cannot lift an unseen document over the worst of the best; it skips a block only
   if the summary proves the same for all its documents, and scores the others exactly from the forward rows. The
   best of all tasks are ranked by Spark. All sums are whole numbers, so no bound is ever rounded below a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripledger.llm.common import stored, tidied

TOP = 10
#: A shard ends at so many documents or postings. One is a row of some megabytes, read and written one at a time.
SHARD_DOCS, SHARD_POSTINGS = 8192, 200_000
#: Documents of a block at most, of a list without summaries, and the step to which summaries are rounded up.
BLOCK, SHORT, UNIT = 128, 64, 4096
#: Terms of searches (each search's own ones counted) that are broadcast at a time: one pass over the documents per block.
PAIRS = 1 << 20
#: Bytes of a text that are cut into terms at a time.
PIECE = 4_000_000
PROJECTIONS = 32
_TERM_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_FORWARD = "doc_id long, n long, terms array<int>, times array<int>"
_INDEX = ", ".join(["docs int", *(f"{c} binary" for c in (
    "ids", "absent", "first", "term", "impact", "most", "list_first", "block_first", "member", "summary_first", "summary_term", "summary_most"))])


def term_counts(data: bytes, known: dict[bytes, int] | None = None) -> tuple[int, Counter]:
    """The number of terms of a text, and how often it holds each (``known`` ones only, if given)."""
    n, counts, lo = 0, Counter(), 0
    data = data.translate(_TERM_BYTES)
    while lo < len(data):
        hi = data.find(b" ", lo + PIECE)
        hi = len(data) if hi < 0 else hi
        words = data[lo:hi].split()
        n += len(words)
        counts.update(words if known is None else filter(known.__contains__, words))
        lo = hi
    return n, counts


@dataclass
class Searches:
    """A block of searches: their item ids, and of each the terms (numbers in ``terms``) and how often it holds them."""

    items: list[int | None]
    terms: list[bytes]
    own: list[tuple[np.ndarray, np.ndarray]]


def search_blocks(items: DataFrame, item_id: str, text: str, pairs: int) -> Iterator[Searches]:
    """The searches in blocks of about ``pairs`` terms: distinct rows (item_id, text) with a term."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [term_counts((x.as_py() or "").encode())[1] for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                                   pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], names=["item_id", "terms", "times"])

    kept = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    found = stored(kept.mapInArrow(rows, "item_id long, terms array<binary>, times array<long>").where("size(terms) > 0"), "searches")
    at: dict[bytes, int] = {}
    block = Searches([], [], [])
    for row in found.toLocalIterator():  # a partition at a time; the driver holds one block
        block.items.append(row["item_id"])
        block.own.append((np.array([at.setdefault(bytes(t), len(at)) for t in row["terms"]], np.int64), np.array(row["times"], np.int64)))
        if sum(len(t) for t, _ in block.own) >= pairs:
            block.terms = list(at)
            yield block
            at, block = {}, Searches([], [], [])
    if block.items:
        block.terms = list(at)
        yield block


def forward_rows(docs: DataFrame, terms: list[bytes], doc_id: str, text: str) -> DataFrame:
    """One row per document with a term: doc_id, n (its terms), and the numbers and counts of the ``terms`` it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # at most PAIRS terms

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            n, held = np.zeros(len(texts), np.int64), []
            for i in range(len(texts)):
                n[i], counts = term_counts(texts[i].as_py() or b"", known)
                held.append(sorted((known[t], k) for t, k in counts.items()))
            some = pa.array(n > 0)
            lists = [pa.array([[x[k] for x in own] for own in held], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.record_batch([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "times"]).filter(some)

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(rows, _FORWARD)


@dataclass
class Statistics:
    """Documents with a term, all terms of all documents, and the weight of each term of a block."""

    docs: int
    length: int
    weight: np.ndarray


def statistics(forward: DataFrame, terms: int) -> Statistics:
    docs, length = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = forward.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most one row per term
    weight = np.zeros(terms, np.int64)
    for term, df in zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True):
        weight[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
    return Statistics(docs, length, weight)


def _spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the given rows of a ragged table, and where each row begins among them."""
    sizes = first[rows + 1] - first[rows]
    starts = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(starts - first[rows], sizes), starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs that begin at ``starts`` (an empty run has 0)."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([starts, [len(values)]])])


class Shard:
    """Forward rows and blocked posting lists of some documents."""

    NAMES = [c.split()[0] for c in _INDEX.split(", ")][1:]
    TYPES = {"ids": np.int64, "absent": np.uint8, "impact": np.int32, "most": np.int32, "summary_most": np.uint8}

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name, a in arrays.items():
            setattr(self, name, a)

    @classmethod
    def _type(cls, name: str, terms: int) -> type:
        if name in ("term", "summary_term") and terms <= 1 << 16:
            return np.uint16
        return cls.TYPES.get(name, np.int32)

    @classmethod
    def read(cls, row: dict[str, bytes]) -> Shard:
        arrays = {n: zstandard.decompress(row[n]) for n in cls.NAMES}
        return cls({n: np.frombuffer(a, cls._type(n, len(arrays["most"]) // 4)) for n, a in arrays.items()})

    def written(self) -> pa.RecordBatch:
        blobs = [zstandard.compress(getattr(self, n).astype(self._type(n, len(self.most)), copy=False).tobytes(), 1) for n in self.NAMES]
        return pa.record_batch([pa.array([len(self.ids)], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], names=["docs", *self.NAMES])

    @classmethod
    def built(cls, ids: pa.Array, n: np.ndarray, first: np.ndarray, term: np.ndarray, times: np.ndarray, stats: Statistics) -> Shard:
        m = np.array([25 + 75 * int(x) * stats.docs // stats.length for x in n], np.int64)
        times = times.astype(np.int64)
        impact = 1_000_000_000 * times // (1000 * times + 8 * np.repeat(m, np.diff(first)))
        doc = np.repeat(np.arange(len(n)), np.diff(first))
        near = _projected(len(n), doc, term, impact * stats.weight[term])
        order = np.argsort(term, kind="stable")
        lists, list_first = np.flatnonzero(np.diff(term[order], prepend=-1)), np.zeros(len(stats.weight) + 1, np.int64)
        most = np.zeros(len(stats.weight), np.int64)
        if len(order):
            most[term[order][lists]] = np.maximum.reduceat(impact[order], lists)
        member, block_first, summaries = [], [0], []
        narrow = np.uint16 if len(stats.weight) <= 1 << 16 else np.int32
        counts = np.zeros(len(stats.weight), np.int64)
        for a, b in zip(lists, [*lists[1:], len(order)][:len(lists)], strict=True):
            posted = doc[order[a:b]]
            cuts = [len(posted)]
            if len(posted) > SHORT:
                posted, cuts = _clustered(posted, near)
            counts[term[order[a]]] = len(cuts)
            for lo, hi in zip([0, *cuts], cuts, strict=False):
                block_first.append(block_first[-1] + hi - lo)
                held, top = _summary(posted[lo:hi], first, term, impact, len(stats.weight)) if b - a > SHORT else (posted[:0],) * 2
                summaries.append((held.astype(narrow), top.astype(np.uint8)))
            member.append(posted)
        np.cumsum(counts, out=list_first[1:])
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return cls({
            "ids": np.asarray(ids.fill_null(0)), "absent": np.asarray(ids.is_null()).astype(np.uint8), "first": first, "term": term, "impact": impact, "most": most,
            "list_first": list_first, "block_first": np.array(block_first), "member": joined(member),
            "summary_first": np.concatenate([[0], np.cumsum([len(s) for s, _ in summaries], dtype=np.int64)]) if summaries else np.zeros(1, np.int64),
            "summary_term": joined([s for s, _ in summaries]), "summary_most": joined([m for _, m in summaries])})

    def scores(self, docs: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Exact scores of documents under a search with such a value of each term."""
        at, starts = _spread(self.first, docs)
        return _sums(value[self.term[at]] * self.impact[at], starts)

    def bounds(self, lo: int, hi: int, value: np.ndarray) -> np.ndarray:
        """What no document of the blocks can pass."""
        a, b = self.summary_first[lo], self.summary_first[hi]
        return _sums(value[self.summary_term[a:b]] * (self.summary_most[a:b].astype(np.int64) * UNIT), self.summary_first[lo:hi] - a)


def _projected(docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Unit vectors that stand for the documents' weighted term vectors: each term adds to a few fixed coordinates with a sign."""
    out = np.zeros((docs, PROJECTIONS), np.float32)
    for seed in (0x9E3779B1, 0x85EBCA77):
        mixed = term.astype(np.uint64) * np.uint64(seed) >> np.uint64(7)
        spot, sign = (mixed >> np.uint64(1)) % np.uint64(PROJECTIONS), 1 - 2 * (mixed & np.uint64(1)).astype(np.int64)
        out += np.bincount(doc * PROJECTIONS + spot.astype(np.int64), sign * value, docs * PROJECTIONS).reshape(docs, PROJECTIONS).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _clustered(posted: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The list's documents in the order of their clusters, and where blocks end."""
    n = -(-len(posted) // BLOCK)
    centres = near[posted[np.arange(n) * len(posted) // n]]
    label = (near[posted] @ centres.T).argmax(axis=1)
    order = np.argsort(label, kind="stable")
    cuts = []
    for size in np.bincount(label):
        done = cuts[-1] if cuts else 0
        cuts += [done + min(size, k + BLOCK) for k in range(0, size, BLOCK)]
    return posted[order], cuts


def _summary(docs: np.ndarray, first: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    at, _ = _spread(first, docs)
    most = np.zeros(terms, np.int64)
    np.maximum.at(most, term[at], impact[at])
    held = np.flatnonzero(most)
    return held, -(-most[held] // UNIT)


def index_rows(forward: DataFrame, stats: Statistics) -> DataFrame:
    """The index: one row per shard, its arrays as compressed bytes."""
    shared = forward.sparkSession.sparkContext.broadcast(stats)  # one weight per term

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        docs = postings = 0

        def shard() -> pa.RecordBatch:
            t = pa.Table.from_batches(waiting).combine_chunks()
            terms, times = (t.column(c).combine_chunks() for c in ("terms", "times"))
            sizes = np.asarray(terms.value_lengths().fill_null(0), np.int64)
            return Shard.built(t.column("doc_id").combine_chunks(), t.column("n").to_numpy(), np.concatenate([[0], np.cumsum(sizes)]),
                               terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy(), shared.value).written()

        for batch in batches:
            sizes, lo = np.asarray(batch.column("terms").value_lengths(), np.int64), 0
            for i, size in enumerate(sizes.tolist()):
                docs, postings = docs + 1, postings + size
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    waiting.append(batch.slice(lo, i + 1 - lo))
                    yield shard()
                    waiting, lo, docs, postings = [], i + 1, 0, 0
            if lo < len(sizes):
                waiting.append(batch.slice(lo))
        if waiting:
            yield shard()

    return forward.mapInArrow(rows, _INDEX)


class Best:
    """The best documents of one search so far."""

    def __init__(self, top: int):
        self.top, self.score, self.absent, self.ids = top, *(np.zeros(0, np.int64) for _ in range(3))

    @property
    def needed(self) -> int:
        """The least score that can still change the list."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.needed
        if good.any():
            score, absent, ids = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.absent, absent), (self.ids, ids)))
            order = np.lexsort((ids, absent, -score))[:self.top]
            self.score, self.absent, self.ids = score[order], absent[order], ids[order]


def search_shard(shard: Shard, terms: np.ndarray, value: np.ndarray, best: Best) -> tuple[int, int]:
    """Adds the shard's best documents for one search: its terms, and the value of every term. Returns blocks opened and met."""
    reach = value[terms] * shard.most[terms]
    order = np.argsort(-reach, kind="stable")
    left = np.cumsum(reach[order][::-1])[::-1]
    seen = np.zeros(len(shard.ids), bool)
    # A document not yet seen holds no term of an earlier list, or was in a block there that it could not lift over the
    # least score needed. So those terms add nothing to the bounds of later blocks.
    ahead = value.copy()
    opened = met = 0
    for t, rest in zip(terms[order].tolist(), left.tolist(), strict=True):
        if rest < best.needed:  # also where nothing is left
            break
        lo, hi = int(shard.list_first[t]), int(shard.list_first[t + 1])
        short = hi == lo + 1 and shard.summary_first[lo] == shard.summary_first[hi]
        bound = np.array([rest]) if short else shard.bounds(lo, hi, ahead)
        ahead[t] = 0
        met += hi - lo
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < best.needed:
                break
            opened += 1
            docs = shard.member[shard.block_first[lo + k]:shard.block_first[lo + k + 1]]
            docs = docs[~seen[docs]]
            seen[docs] = True
            best.add(shard.scores(docs, value), shard.absent[docs].astype(np.int64), shard.ids[docs])
    return opened, met


def search_index(index: DataFrame, searches: Searches, stats: Statistics, top: int = TOP) -> DataFrame:
    """The best documents of each search (item: its number) among those of each task."""
    shared = index.sparkSession.sparkContext.broadcast((searches.own, stats.weight))  # at most PAIRS terms

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        best = [Best(top) for _ in own]
        value = np.zeros(len(weight), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard.read({n: batch.column(n)[i].as_py() for n in Shard.NAMES})
                for (terms, times), found in zip(own, best, strict=True):
                    value[terms] = weight[terms] * times
                    search_shard(shard, terms, value, found)
                    value[terms] = 0
        out = [(k, None if a else int(d), int(s)) for k, f in enumerate(best) for s, a, d in zip(f.score, f.absent, f.ids, strict=True)]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                  names=["item", "doc_id", "score"])

    return index.mapInArrow(rows, "item int, doc_id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The ``top`` documents with the highest score above 0 for each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of digits, letters A-Z (in lower case) and characters beyond ASCII. Equal scores go by ascending
    doc_id, null last. Each row of ``docs`` is a document, also one that repeats an id; null or empty text has no term
    and counts nowhere. Rows of ``items`` that repeat id and text are one search; other rows of an id are searches of
    their own. An item without a term, or one whose terms no document holds, gives no row. Other columns are not read,
    so their names cannot clash; empty tables give an empty table.
    """
    spark, out = docs.sparkSession, []
    for block in search_blocks(items, item_id, item_text, PAIRS):
        forward = stored(forward_rows(docs, block.terms, doc_id, text), "forward")
        stats = statistics(forward, len(block.terms))
        index = stored(index_rows(forward, stats), "index", {"compression": "uncompressed", "parquet.block.size": str(4 << 20)})
        window = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = search_index(index, block, stats, top).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.items)), "item int, item_id long")
        out.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
