"""Repeated word windows by super-k-mers.

A window is WINDOW consecutive words; its minimiser is the smallest hash of its runs of MINIMISER words. Consecutive
windows that share a minimiser are one super-k-mer: they are sent as one packed string to the bucket of the minimiser, so
that equal windows meet in one bucket. There the windows are sorted by two independent hashes, neighbours are compared word
by word, and the smallest document of each window is known; every later document loses the words of the window.

Before that, windows are combined where they are: of equal windows in one piece of the input only the first one
of the smallest document is sent, and later documents of the piece already know that they lose it. A passage that very
many documents share is thus sent once per piece, not once per document. A minimiser that very many super-k-mers have is
split: its windows go to the buckets of their own hashes.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import BLANKS, WORD, among, hot_keys, id_filter, key_counts, mixed, stored, tagged, tidied
from tripledger.llm.words import Words, pieces, runs_of, sliced_words_of

WINDOW = 13
MINIMISER = 3
#: Bytes of text that are combined and packed together, and bytes of text per bucket.
PIECE_BYTES = 4_000_000
BUCKET_BYTES = 1_000_000
#: Of steps that are used alone; a run of ``without_repeats`` draws its own.
SEED = 6


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, text number and two hashes of each window that lies inside one text."""
    counts = np.maximum(words.counts - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + words.first[owner]
    return first, owner, runs_of(words.value, WINDOW)[first], runs_of(words.other, WINDOW)[first]


def _groups(one: np.ndarray, two: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by window (both hashes), document and place, and the start of each window's rows."""
    order = np.argsort(one)
    equal = one[order[1:]] == one[order[:-1]]
    tied = np.zeros(len(order), bool)
    tied[1:] |= equal
    tied[:-1] |= equal
    tied = np.flatnonzero(tied)  # only these need the other keys
    rows = order[tied]
    order[tied] = rows[np.lexsort((at[rows], doc[rows], two[rows], one[rows]))]
    new = np.ones(len(order), bool)
    new[tied[1:]] = (one[order[tied[1:]]] != one[order[tied[1:] - 1]]) | (two[order[tied[1:]]] != two[order[tied[1:] - 1]])
    return order, np.flatnonzero(new)


def _verified(words: Words, first: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The starts of groups of windows (by their first words, in order), with a cut wherever neighbours differ in a word's bytes."""
    new = np.zeros(len(first), bool)
    new[cut] = True
    later = np.flatnonzero(~new)  # neighbours of one group
    here, there, size = first[later], first[later - 1], words.end - words.start
    differ = np.zeros(len(later), bool)
    for k in range(WINDOW):
        for part in (*words.exact, size):
            differ |= part[here + k] != part[there + k]
    new[later[differ]] = True
    return np.flatnonzero(new)


def _runs(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of documents as runs (document, tag, first place, number of places), each place once."""
    order = np.lexsort((at, tag, doc))
    doc, tag, at = doc[order], tag[order], at[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    once = other.copy()
    once[1:] |= at[1:] != at[:-1]
    doc, tag, at, new = doc[once], tag[once], at[once], other[once]
    new[1:] |= at[1:] != at[:-1] + 1
    cut = np.flatnonzero(new)
    return doc[cut], tag[cut], at[cut], np.diff(np.append(cut, len(doc)))


_SENT = pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def _sent_runs(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, buckets: int) -> pa.RecordBatch:
    doc, tag, at, n = _runs(doc, tag, at)
    home = (mixed(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    return pa.record_batch([pa.array(home), pa.nulls(len(doc), pa.binary()), pa.array(doc), pa.array(tag), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], schema=_SENT)


def hot_minimisers(docs: DataFrame, total: int, seed: int = SEED) -> np.ndarray:
    """Minimisers of very many super-k-mers, counted in a sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in gathered(batches, PIECE_BYTES):
            words = sliced_words_of(texts, seed)
            first, owner, _, _ = _windows(words)
            if len(first):
                least = _window_min(runs_of(words.value, MINIMISER), WINDOW - MINIMISER + 1)[first]
                yield key_counts(least[np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])])])

    return hot_keys(docs, total, counted)


def packed_runs(docs: DataFrame, buckets: int, hot: np.ndarray, seed: int = SEED) -> DataFrame:
    """Super-k-mers packed per piece and bucket, and runs of windows that are already known to be lost.

    The values of words follow from ``seed``, the same in all steps of a run. Windows of a ``hot`` minimiser go one by one to the bucket of their own hash, which equal windows share.
    """
    listed = docs.sparkSession.sparkContext.broadcast(hot)

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)

        def piece(ids: np.ndarray, tags: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            words = sliced_words_of(texts, seed)
            first, owner, one, two = _windows(words)
            if not len(first):
                return
            doc = ids[owner]
            order, cut = _groups(one, two, doc, first)
            cut = _verified(words, first[order], cut)
            sizes = np.diff(np.append(cut, len(order)))
            lead = order[cut]
            lost = doc[order] != np.repeat(doc[lead], sizes)
            if lost.any():
                gone = order[lost]
                yield _sent_runs(doc[gone], tags[owner[gone]], first[gone] - words.first[owner[gone]], buckets)
            sent = np.sort(lead)
            least = _window_min(runs_of(words.value, MINIMISER), WINDOW - MINIMISER + 1)[first[sent]]
            split = among(least, listed.value)
            least[split] = one[sent][split]
            new = np.ones(len(sent), bool)
            new[1:] = (first[sent][1:] != first[sent][:-1] + 1) | (owner[sent][1:] != owner[sent][:-1]) | (least[1:] != least[:-1])
            new |= split
            begin = np.flatnonzero(new)
            length = np.diff(np.append(begin, len(sent)))
            w0 = first[sent][begin]
            w1 = w0 + length + WINDOW - 2
            bucket = (mixed(least[begin]) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((w0, bucket))
            # one blank after each word, so that a super-k-mer is a slice
            sizes = words.end - words.start
            place = np.concatenate([[0], np.cumsum(sizes + 1)])
            slim = np.full(place[-1], 32, np.uint8)
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            slim[np.repeat(place[:-1], sizes) + inside] = words.body[np.repeat(words.start, sizes) + inside]
            body = slim.tobytes()
            lo, hi = place[w0[by]].tolist(), (place[w1[by] + 1] - 1).tolist()
            strings = [body[a:b] for a, b in zip(lo, hi, strict=True)]
            text_no = owner[sent][begin[by]]
            of, tag, at = ids[text_no], tags[text_no], (w0[by] - words.first[text_no]).astype(np.int32)
            turns = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            names, blobs = bucket[by][turns], []
            for a, b in zip(turns, np.append(turns[1:], len(by)), strict=True):
                head = np.array([b - a], np.int64).tobytes() + np.diff(of[a:b], prepend=0).tobytes() + tag[a:b].tobytes() + at[a:b].tobytes()
                blobs.append(squeeze.compress(head + b"\n".join(strings[a:b])))
            n = len(blobs)
            yield pa.record_batch([pa.array(names), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], schema=_SENT)

        for ids, tags, texts in gathered(batches, PIECE_BYTES):
            yield from piece(np.array(ids, np.int64), np.array(tags, np.int64), texts)

    return docs.mapInArrow(pack, "bucket long, packed binary, doc_id long, tag long, start int, n int")


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Documents (id, tag, UTF-8 text) in pieces of about ``size`` bytes."""
    ids, tags, texts, filled = [], [], [], 0
    for batch in batches:
        for doc_id, text, tag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            body = (text.as_py() or "").encode("utf-8")
            ids.append(doc_id)
            tags.append(tag)
            texts.append(body)
            filled += len(body)
            if filled >= size:
                yield ids, tags, texts
                ids, tags, texts, filled = [], [], [], 0
    if ids:
        yield ids, tags, texts


def lost_windows(packed: DataFrame, seed: int = SEED) -> DataFrame:
    """Runs of windows (doc_id, tag, start, n) that also start in a document with a smaller id."""

    def bucket_runs(blobs: list[bytes]) -> pa.RecordBatch | None:
        grow, docs, tags, starts, texts = zstandard.ZstdDecompressor(), [], [], [], []
        for blob in blobs:
            raw = grow.decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            docs.append(np.cumsum(np.frombuffer(raw, np.int64, n, 8)))
            tags.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
            starts.append(np.frombuffer(raw, np.int32, n, 8 + 16 * n))
            texts.append(raw[8 + 20 * n:])
        words = sliced_words_of(b"\n".join(texts).split(b"\n"), seed)
        first, owner, one, two = _windows(words)
        doc = np.concatenate(docs)[owner]
        at = np.concatenate(starts).astype(np.int64)[owner] + first - words.first[owner]
        order, cut = _groups(one, two, doc, at)
        cut = _verified(words, first[order], cut)
        sizes = np.diff(np.append(cut, len(order)))
        gone = order[doc[order] != np.repeat(doc[order[cut]], sizes)]
        if not len(gone):
            return None
        d, t, s, n = _runs(doc[gone], np.concatenate(tags)[owner[gone]], at[gone])
        return pa.record_batch([pa.array(d), pa.array(t), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "tag", "start", "n"])

    @tidied
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column(2)))
            if known.num_rows:
                yield known.select(["doc_id", "tag", "start", "n"])
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not blob.is_valid:
                    continue
                if bucket != current:
                    if blobs and (out := bucket_runs(blobs)) is not None:
                        yield out
                    current, blobs = bucket, []
                blobs.append(blob.as_py())
        if blobs and (out := bucket_runs(blobs)) is not None:
            yield out

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(unpack, "doc_id long, tag long, start int, n int")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256; with ``with_text`` also kept (the words left).

    Words are runs other than blanks and line ends, unchanged. Every word inside a window that also starts in a document
    with a smaller id goes; windows are judged on the input. Texts of fewer than WINDOW words, null and empty texts
    lose nothing. Rows that repeat an id lose nothing to each other, and each its own words to smaller ids; a null id is
    neither smaller nor larger than another, so its row is returned whole. Ids are whole numbers. Other columns are not
    read; an empty table gives an empty table.
    """
    rows = tagged(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.where("doc_id is not null")
    seed = secrets.randbits(128)  # so that no texts can be made whose words share values
    hot = hot_minimisers(some, total, seed)
    runs = stored(lost_windows(packed_runs(some, max(4 * parts, total // BUCKET_BYTES), hot, seed), seed), "lost")
    listed = id_filter(runs.select("doc_id").distinct())
    lost = runs.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "n")).alias("lost"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]

    @tidied
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode("utf-8") for x in batch.column(1)]
            flat = batch.column(2)
            for lo, hi in pieces(texts):
                words = sliced_words_of(texts[lo:hi], seed)
                runs = flat.slice(lo, hi - lo)
                counts = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
                pairs = runs.flatten()
                owner = np.repeat(np.arange(hi - lo), counts)
                start = words.first[owner] + pairs.field("start").to_numpy(zero_copy_only=False)
                n = pairs.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                gone = np.zeros(len(words.start) + 1, np.int64)
                if len(start):
                    first, own, one, two = _windows(words)
                    marked = np.zeros(len(words.start) + 1, bool)
                    marked[np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = True
                    # a window that a document holds several times was sent once: its other places follow
                    order, cut = _groups(one, two, own, first)
                    same = np.ones(len(order), bool)
                    same[1:] = own[order][1:] != own[order][:-1]
                    same[cut] = True
                    heads = np.flatnonzero(same)
                    hit = np.logical_or.reduceat(marked[first[order]], heads) if len(heads) else np.zeros(0, bool)
                    hits = first[order][np.repeat(hit, np.diff(np.append(heads, len(order))))]
                    np.add.at(gone, hits, 1)
                    np.add.at(gone, hits + WINDOW, -1)
                stays = np.cumsum(gone)[:-1] == 0
                out = {"n_words": words.counts, "n_removed": [], "kept_sha256": [], "kept": []}
                body = words.body.tobytes()
                for i in range(hi - lo):
                    a, b = words.first[i], words.first[i + 1]
                    left = stays[a:b]
                    kept = b" ".join([body[s:e] for s, e in zip(words.start[a:b][left].tolist(), words.end[a:b][left].tolist(), strict=True)])
                    out["n_removed"].append(int(b - a - left.sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        out["kept"].append(kept.decode("utf-8"))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *(pa.array(out[c], k) for c, k in zip(names[1:], kinds, strict=False))], names=names)

    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    # only documents that may lose something are shuffled
    hit = rows.withColumn("hit", F.col("doc_id").isNotNull() & F.coalesce(listed(F.col("doc_id")), F.lit(False)))
    cut = hit.where("hit").join(lost, ["doc_id", "tag"], "left").select("doc_id", "text", "lost").mapInArrow(apply, fields)
    text_ = F.coalesce("text", F.lit(""))
    kept = F.trim(F.regexp_replace(text_, BLANKS, " "))
    whole = {"n_words": F.regexp_count(text_, F.lit(WORD)).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_sha256": F.sha2(kept.cast("binary"), 256)}
    if with_text:
        whole["kept"] = kept
    return cut.union(hit.where("not hit").select("doc_id", *[c.alias(n) for n, c in whole.items()]))
