"""Repeated byte strings by suffix arrays of the difference-cover kind, one per bucket of the cluster.

1. The starts of STRING bytes in a document are cut in pieces: neighbouring starts whose strings share their smallest
   hash of GRAM bytes, the mark. Equal strings share their mark. Documents, places and hashes of the pieces go to the
   bucket of the mark, no text. The starts of a mark that very many pieces have go by the hash of their whole string.
2. A mark that only one document has is let go: no string there can repeat elsewhere. Of equal pieces the smallest
   document keeps its own, the others lose all starts. Pieces of a mark with several contents stay open.
3. The bytes of open pieces are cut from their documents and sent to buckets by mark. There they are laid end to end,
   each ended by a sign, and their suffixes are sorted: triples at the positions 1 and 2 modulo 3 are sorted
   and named, the names are sorted by recursion until they differ, the remaining suffixes follow from them, and both
   are merged.
4. Neighbours in that order are compared over STRING bytes; the smallest document of equal neighbours keeps them.

Sorting all suffixes of a corpus in one order would shuffle each byte many times over. Here the text that cannot repeat
is never sent, and the buckets hold every pair of equal strings.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import among, hot_keys, id_filter, key_counts, mixed, stored, tagged, tidied
from tripledger.llm.superkmer_dedup import _window_min, gathered

STRING = 50
GRAM = 16
#: Bytes of text that are cut and packed together, and bytes of text per bucket.
PIECE_BYTES = 2_000_000
BUCKET_BYTES = 1_000_000
#: Different marks of a bucket, and open pieces of a bucket of suffixes.
MARKS = 1 << 24
BUCKET_PIECES = 4000


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers from 0 on: sorted together with their places, or, if both do not fit, by counting over digits."""
    bits, places = int(key.max(initial=0)).bit_length(), len(key).bit_length()
    if bits + places <= 63:
        return np.sort(key.astype(np.int64) << places | np.arange(len(key))) & ((1 << places) - 1)
    order = np.argsort(key.astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        order = order[np.argsort((key[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of ``text`` (whole numbers from 1 on) in the order of their suffixes, by difference cover modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    # a suffix that ends at a sampled position needs a name too: one more position if the length asks for it
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names, different = _named(s[sample], s[sample + 1], s[sample + 2])
    if different < len(sample):
        order = suffix_order(names)
        rank = np.empty(len(sample), np.int64)
        rank[order] = np.arange(1, len(sample) + 1)
    else:
        rank = names
    of = np.zeros(n + 3, np.int64)
    of[sample] = rank
    sampled = sample[_order(rank)]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[_argsort(s[rest], of[rest + 1])]
    # merge: a remaining suffix meets position 1 modulo 3 by (sign, rank) and 2 modulo 3 by (sign, sign, rank)
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    top = int(of.max()) + 1
    low = _pairs(s[rest], of[rest + 1], top), _pairs(s[one], of[one + 1], top)
    before_one = np.searchsorted(low[1], low[0])
    width = int(s.max()) + 1
    if width * width * top < 2**62:
        a, b = ((s[x] * width + s[x + 1]) * top + of[x + 2] for x in (rest, two))
        before_two = np.searchsorted(b, a)
    else:
        both, _ = _named(np.concatenate([s[rest], s[two]]), np.concatenate([s[rest + 1], s[two + 1]]), np.concatenate([of[rest + 2], of[two + 2]]))
        before_two = np.searchsorted(both[len(rest):], both[:len(rest)])
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before_one + before_two
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = sampled
    return out


def _pairs(high: np.ndarray, low: np.ndarray, top: int) -> np.ndarray:
    return high * top + low


def _argsort(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return _order(high * (int(low.max(initial=0)) + 1) + low)


def _named(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of triples, equal for equal triples, and how many differ."""
    wide = int(max(a.max(), b.max(), c.max())) + 1
    if wide**3 < 2**62:
        key = (a * wide + b) * wide + c
    else:
        key = _named_pairs(_named_pairs(a, b), c)
    order = _order(key)
    in_order = key[order]
    new = np.ones(len(key), np.int64)
    new[1:] = in_order[1:] != in_order[:-1]
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def _named_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    order = np.lexsort((b, a))
    new = np.ones(len(a), np.int64)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    names = np.empty(len(a), np.int64)
    names[order] = np.cumsum(new)
    return names


def repeated_starts(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of the starts of STRING bytes that also start in a string of a smaller document."""
    sizes = np.array([len(x) for x in strings], np.int64)
    m = len(strings)
    ends = np.cumsum(sizes + 1) - 1
    body = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    # one sign ends every string: a suffix that reaches over an end is sorted with what follows, but has too few bytes to count
    signs = body.astype(np.int64) + 2
    signs[ends] = 1
    owner = np.repeat(np.arange(m), sizes + 1)
    order = suffix_order(signs)
    order = order[ends[owner[order]] - order >= STRING]  # suffixes that hold a whole string
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    longs = np.zeros(len(body) + 8, np.uint64)
    for k in range(8):
        longs[:len(body)] |= np.append(body[k:], np.zeros(k, np.uint8)).astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(len(order) - 1, bool)
    for at in [*range(0, STRING - 8, 8), STRING - 8]:
        part = longs[order + at]
        same &= part[1:] == part[:-1]
    cut = np.flatnonzero(np.concatenate([[True], ~same]))
    doc = docs[owner[order]]
    least = np.repeat(np.minimum.reduceat(doc, cut), np.diff(np.append(cut, len(order))))
    lost = order[doc != least]
    return owner[lost], lost - (ends[owner[lost]] - sizes[owner[lost]])


_ROW = pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_ROW_DDL = "bucket long, packed binary, doc_id long, tag long, start long, n long"


def _merged(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts (document, tag, start, number), each once, with those that continue each other joined."""
    order = np.lexsort((n, start, tag, doc))
    doc, tag, start, n = doc[order], tag[order], start[order], n[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    once = other.copy()
    once[1:] |= (start[1:] != start[:-1]) | (n[1:] != n[:-1])
    doc, tag, start, n, new = doc[once], tag[once], start[once], n[once], other[once]
    new[1:] |= start[1:] != start[:-1] + n[:-1]
    cut = np.flatnonzero(new)
    return doc[cut], tag[cut], start[cut], np.add.reduceat(n, cut) if len(cut) else n


def _pieces(texts: list[bytes], hot: np.ndarray, base: int | None = None) -> tuple[np.ndarray, ...] | None:
    """Text number, first start, number of starts, gram hash and content hash of each piece, and where each text begins.

    The mark of the starts of a ``hot`` mark is the hash of their whole string. Without a ``base`` modulo PRIME the content
    hash is not safe.
    """
    size = np.array([len(t) for t in texts], np.int64)
    body = np.frombuffer(b"\0".join(texts) + b"\0" * (STRING + 14), np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    count = np.maximum(size - STRING + 1, 0)
    if not count.sum():
        return None
    sums = np.zeros(len(body) + 1, np.uint64)
    value = body.astype(np.uint64)
    value += np.uint64(1)
    value *= _powers("up", _BASE, len(body))
    np.cumsum(value, out=sums[1:])
    del value
    back = _powers("down", _BACK, len(body))
    grams = sums[GRAM:] - sums[:-GRAM]
    grams *= back[:len(grams)]
    least = _window_min(mixed(grams), STRING - GRAM + 1)
    del grams
    # places where a string fits in its text, and of these the ones at which a piece begins
    fits = np.zeros(len(least) + 1, np.int8)
    np.add.at(fits, begin[count > 0], 1)
    np.add.at(fits, (begin + count)[count > 0], -1)
    fits = np.cumsum(fits[:-1], dtype=np.int8) > 0
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[begin[count > 0]] = True
    first = np.flatnonzero(new & fits)
    at = np.flatnonzero(among(least[first], hot))
    if len(at):
        stop = np.minimum(np.append(first[1:], len(least))[at], len(least))
        spots = np.repeat(first[at] - (np.cumsum(stop - first[at]) - (stop - first[at])), stop - first[at]) + np.arange((stop - first[at]).sum())
        spots = spots[fits[spots]]
        least[spots] = mixed((sums[spots + STRING] - sums[spots]) * back[spots])
        new[1:] = least[1:] != least[:-1]  # neighbouring starts of one string stay a piece
        new[begin[count > 0]] = True
        first = np.flatnonzero(new & fits)
    owner = np.searchsorted(begin, first, side="right") - 1
    n = np.minimum(np.append(first[1:], len(body)), (begin + count)[owner]) - first
    gram = least[first]
    content = (sums[first + n + STRING - 1] - sums[first]) * back[first] + n.astype(np.uint64)
    if base is not None:
        content = mixed(content) + prime_hashes(prime_sums(body.astype(np.uint64) + np.uint64(1), base), first, first + n + STRING - 1, base) * _BASE
    content = mixed(content)
    return owner, first, n, gram, content, begin


#: Marks are a polynomial of odd base modulo 2**64, cheap at every byte; they only say which pieces meet.
_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Contents are told apart by a polynomial modulo this prime as well, with a base drawn for each run: two different pieces of n
#: bytes agree for at most n of the 2**61 bases, whatever they are.
PRIME = (1 << 61) - 1
_P, _LOW, _HALF = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_POWERS: dict[tuple, np.ndarray] = {}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if (kind,) not in _POWERS or len(_POWERS[kind,]) < n:
        steps = np.full(max(n, PIECE_BYTES + 8192), base, np.uint64)
        steps[0] = 1
        _POWERS[kind,] = np.cumprod(steps)
    return _POWERS[kind,][:n]


def reduced(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo PRIME."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of values below it, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _HALF, b >> np.uint64(31), b & _HALF
    middle = a1 * b0 + a0 * b1
    return reduced(reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW) << np.uint64(31))) + reduced(a0 * b0))


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo PRIME, by doubling; the last tables are kept."""
    have = _POWERS.get(("prime", base))
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < max(n, PIECE_BYTES + 8192):
            step = np.uint64(pow(base, len(have), PRIME))
            have = np.concatenate([have, product(have, np.full(len(have), step))])
        for key in [k for k in _POWERS if k[0] == "prime" and k[1:] not in ((base,), (pow(base, -1, PRIME),))]:
            del _POWERS[key]
        _POWERS["prime", base] = have
    return have[:n]


def prime_sums(value: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value * base**place before each place (one more at the end), for the high and the low 32 bits of the powers.

    Values are at most 256. The sums are below 2**62 and stand for their remainders.
    """
    power, out = prime_powers(base, len(value)), []
    for part in (power >> np.uint64(32), power & np.uint64((1 << 32) - 1)):
        sums, carry = np.zeros(len(value) + 1, np.uint64), 0
        part *= value
        for lo in range(0, len(value), 1 << 16):  # a block adds less than 2**57
            block = sums[lo + 1:lo + 1 + (1 << 16)]
            np.cumsum(part[lo:lo + (1 << 16)], out=block)
            block += np.uint64(carry)
            carry = int(block[-1]) % PRIME
        out.append(sums)
    return out[0], out[1]


def prime_hashes(sums: tuple[np.ndarray, np.ndarray], first: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of the values from ``first`` to ``stop`` of each piece, whatever its place."""
    high, low = (reduced(reduced(s[stop]) + _P - reduced(s[first])) for s in sums)
    back = prime_powers(pow(base, -1, PRIME), len(sums[0]))
    return product(reduced(product(high, np.full(len(high), 1 << 32, np.uint64)) + low), back[first])


def hot_marks(docs: DataFrame, total: int) -> np.ndarray:
    """Marks of very many pieces, counted in a sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in gathered(batches, PIECE_BYTES):
            found = _pieces(texts, np.zeros(0, np.uint64))
            if found is not None:
                yield key_counts(found[3])

    return hot_keys(docs, total, counted)


def hashed_pieces(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Hashes of pieces packed by bucket, and starts that equal bytes of a smaller document in the same part of the input lose."""
    listed = docs.sparkSession.sparkContext.broadcast(hot)
    base = 2 + secrets.randbelow(PRIME - 2)  # one for all tasks of a run; results do not depend on it

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for id_list, tag_list, texts in gathered(batches, PIECE_BYTES):
            ids, tags = np.array(id_list, np.int64), np.array(tag_list, np.int64)
            found = _pieces(texts, listed.value, base)
            if found is None:
                continue
            owner, first, n, gram, content, begin = found
            doc = ids[owner]
            order = np.lexsort((doc, content, gram))
            new = np.ones(len(order), bool)
            new[1:] = (content[order][1:] != content[order][:-1]) | (gram[order][1:] != gram[order][:-1])
            cut = np.flatnonzero(new)
            lost = np.zeros(len(order), bool)
            lost[order] = doc[order] != np.repeat(doc[order[cut]], np.diff(np.append(cut, len(order))))
            if lost.any():
                d, t, s, k = _merged(doc[lost], tags[owner[lost]], first[lost] - begin[owner[lost]], n[lost])
                home = (mixed(d.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                yield pa.record_batch([pa.array(home), pa.nulls(len(d), pa.binary()), pa.array(d), pa.array(t), pa.array(s), pa.array(k)], schema=_ROW)
            sent = np.flatnonzero(~lost)
            bucket = (gram[sent] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            sent, bucket = sent[by], bucket[by]
            turns = np.flatnonzero(np.diff(bucket, prepend=-1))
            mark = ((gram[sent] // np.uint64(buckets)) & np.uint64(MARKS - 1)).astype(np.uint32)
            columns = doc[sent], tags[owner[sent]], first[sent] - begin[owner[sent]], n[sent].astype(np.int32), mark, content[sent]
            blobs = []
            for a, b in zip(turns.tolist(), [*turns[1:].tolist(), len(sent)], strict=True):
                of, t, at, k, m, c = (x[a:b] for x in columns)
                blobs.append(squeeze.compress(np.array([b - a], np.int64).tobytes() + np.diff(of, prepend=0).tobytes() + t.tobytes() + at.tobytes() + c.tobytes() + k.tobytes() + m.tobytes()))
            m = len(blobs)
            yield pa.record_batch([pa.array(bucket[turns]), pa.array(blobs, pa.binary()), *(pa.nulls(m, pa.int64()) for _ in range(4))], schema=_ROW)

    return docs.mapInArrow(pack, _ROW_DDL)


def _by_bucket(packed: DataFrame, solve: Callable[[int, list[bytes]], pa.RecordBatch | None], ddl: str) -> DataFrame:
    """``solve`` over the packed rows of each bucket; rows that are not packed pass."""

    @tidied
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blobs = None, []
        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column(2)))
            if known.num_rows:
                rest = [pa.nulls(known.num_rows, pa.int64())] * (ddl.count(",") - 3)
                yield pa.record_batch([*known.select([2, 3, 4, 5]).columns, *rest], names=[x.split()[0] for x in ddl.split(", ")])
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not blob.is_valid:
                    continue
                if bucket != current:
                    if blobs and (out := solve(current, blobs)) is not None:
                        yield out
                    current, blobs = bucket, []
                blobs.append(blob.as_py())
        if blobs and (out := solve(current, blobs)) is not None:
            yield out

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(unpack, ddl)


def sifted(packed: DataFrame) -> DataFrame:
    """Runs of starts: with a null mark they are lost, with a mark their suffixes have to be sorted; others are gone.

    A mark that only one document has cannot repeat elsewhere. Of equal pieces (mark and 64-bit content hash) the smallest
    document keeps its own, and the others lose all starts. Kept pieces of a mark with several contents are open.
    """

    def solve(bucket: int, blobs: list[bytes]) -> pa.RecordBatch | None:
        grow, parts = zstandard.ZstdDecompressor(), []
        for blob in blobs:
            raw = grow.decompress(blob)
            m = int(np.frombuffer(raw, np.int64, 1)[0])
            parts.append((np.cumsum(np.frombuffer(raw, np.int64, m, 8)), np.frombuffer(raw, np.int64, m, 8 + 8 * m), np.frombuffer(raw, np.int64, m, 8 + 16 * m),
                          np.frombuffer(raw, np.uint64, m, 8 + 24 * m), np.frombuffer(raw, np.int32, m, 8 + 32 * m).astype(np.int64),
                          np.frombuffer(raw, np.uint32, m, 8 + 36 * m).astype(np.int64)))
        doc, tag, at, content, n, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(mark, kind="stable")
        cut = np.flatnonzero(np.diff(mark[order], prepend=-1))
        several = np.minimum.reduceat(doc[order], cut) != np.maximum.reduceat(doc[order], cut)
        rows = order[np.repeat(several, np.diff(np.append(cut, len(order))))]
        if not len(rows):
            return None
        rows = rows[np.lexsort((doc[rows], content[rows], mark[rows]))]
        d, m, c = doc[rows], mark[rows], content[rows]
        new_mark = np.concatenate([[True], m[1:] != m[:-1]])
        new = new_mark.copy()
        new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new)
        lost = d != np.repeat(d[cut], np.diff(np.append(cut, len(d))))
        heads = np.flatnonzero(new_mark)
        contents = np.add.reduceat(new.astype(np.int64), heads)
        open_ = ~lost & np.repeat(contents > 1, np.diff(np.append(heads, len(d))))
        a, b = rows[lost], rows[open_]
        gone, sort = _merged(doc[a], tag[a], at[a], n[a]), (doc[b], tag[b], at[b], n[b])
        if not len(gone[0]) + len(b):
            return None
        marks = pa.concat_arrays([pa.nulls(len(gone[0]), pa.int64()), pa.array(bucket * MARKS + mark[b])])
        return pa.record_batch([*(pa.array(np.concatenate(x)) for x in zip(gone, sort, strict=True)), marks], names=["doc_id", "tag", "start", "n", "mark"])

    return _by_bucket(packed, solve, "doc_id long, tag long, start long, n long, mark long")


def cut_pieces(docs: DataFrame, buckets: int) -> DataFrame:
    """Bytes of the open pieces, packed by bucket, from rows (doc_id, text, open: start, n and mark of each, tag)."""

    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            lists, pairs = batch.column(2), batch.column(2).flatten()
            start, n, mark = (pairs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "mark"))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            texts = [(x.as_py() or "").encode("utf-8") for x in batch.column(1)]
            doc, tag = batch.column(0).to_numpy()[row], batch.column(3).to_numpy()[row]
            bucket = (mixed(mark.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            cut = [texts[r][s:s + k + STRING - 1] for r, s, k in zip(row[by].tolist(), start[by].tolist(), n[by].tolist(), strict=True)]
            turns = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            blobs = []
            for a, b in zip(turns.tolist(), [*turns[1:].tolist(), len(by)], strict=True):
                at = by[a:b]
                blobs.append(squeeze.compress(np.array([b - a], np.int64).tobytes() + doc[at].tobytes() + tag[at].tobytes() + start[at].tobytes() + n[at].tobytes() + b"".join(cut[a:b])))
            m = len(blobs)
            yield pa.record_batch([pa.array(bucket[by][turns]), pa.array(blobs, pa.binary()), *(pa.nulls(m, pa.int64()) for _ in range(4))], schema=_ROW)

    return docs.mapInArrow(pack, _ROW_DDL)


def sorted_pieces(packed: DataFrame) -> DataFrame:
    """Runs of starts (doc_id, tag, start, n) that neighbours in the suffix order of their bucket lose to smaller documents."""

    def solve(bucket: int, blobs: list[bytes]) -> pa.RecordBatch | None:
        grow, strings, docs, tags, starts = zstandard.ZstdDecompressor(), [], [], [], []
        for blob in blobs:
            raw = grow.decompress(blob)
            m = int(np.frombuffer(raw, np.int64, 1)[0])
            docs.append(np.frombuffer(raw, np.int64, m, 8))
            tags.append(np.frombuffer(raw, np.int64, m, 8 + 8 * m))
            starts.append(np.frombuffer(raw, np.int64, m, 8 + 16 * m))
            ends = 8 + 32 * m + np.cumsum(np.frombuffer(raw, np.int64, m, 8 + 24 * m) + STRING - 1)
            strings += [raw[a:b] for a, b in zip([8 + 32 * m, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        doc, start = np.concatenate(docs), np.concatenate(starts)
        which, at = repeated_starts(strings, doc)
        if not len(which):
            return None
        d, t, s, n = _merged(doc[which], np.concatenate(tags)[which], start[which] + at, np.ones(len(which), np.int64))
        return pa.record_batch([pa.array(d), pa.array(t), pa.array(s), pa.array(n)], names=["doc_id", "tag", "start", "n"])

    return _by_bucket(packed, solve, "doc_id long, tag long, start long, n long")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_spans: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_spans`` also spans and kept.

    Texts are their UTF-8 bytes; null is empty. Every byte inside a STRING that also starts in a document with a smaller
    id goes, judged on the input; strings never cross documents and repeats inside one document stay. Texts shorter
    than STRING lose nothing. Rows that repeat an id lose nothing to each other, and each its own bytes to smaller ids; a
    null id is neither smaller nor larger than another, so its row is returned whole. Ids are whole numbers. ``spans`` are the maximal removed runs (from, to). Other columns are not read; an empty table gives none.
    """
    rows = tagged(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.where("doc_id is not null")
    sifts = stored(sifted(hashed_pieces(some, max(4 * parts, total // BUCKET_BYTES), hot_marks(some, total))), "sifted")
    open_ = sifts.where("mark is not null")
    asked = open_.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "n", "mark")).alias("open"))
    listed = id_filter(open_.select("doc_id").distinct())
    strings = cut_pieces(rows.where(F.col("doc_id").isNotNull() & listed(F.col("doc_id"))).join(asked, ["doc_id", "tag"]).select("doc_id", "text", "open", "tag"), max(4 * parts, open_.count() // BUCKET_PIECES))
    late = stored(sorted_pieces(strings), "sorted")
    runs = sifts.where("mark is null").select("doc_id", "tag", "start", "n").union(late)
    listed = id_filter(runs.select("doc_id").distinct())
    lost = runs.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "n")).alias("lost"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if with_spans else [])]

    @tidied
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in names[1:]}
            for text, runs in zip(batch.column(1), batch.column(2), strict=True):
                body = (text.as_py() or "").encode("utf-8")
                spans = np.zeros((0, 2), np.int64)
                if runs.is_valid and len(runs.values):
                    start, n = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate((start + n + STRING - 1)[order])
                    new = np.concatenate([[True], start[1:] > reach[:-1]])
                    spans = np.column_stack([start[new], np.append(reach[:-1][new[1:]], reach[-1])])
                kept, at = [], 0
                for a, b in spans.tolist():
                    kept.append(body[at:a])
                    at = b
                kept = b"".join([*kept, body[at:]])
                out["n_bytes"].append(len(body))
                out["n_removed"].append(len(body) - len(kept))
                out["n_spans"].append(len(spans))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_spans:
                    out["spans"].append([{"from": a, "to": b} for a, b in spans.tolist()])
                    out["kept"].append(kept)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.binary()]
            yield pa.record_batch([batch.column(0), *(pa.array(out[c], k) for c, k in zip(names[1:], kinds, strict=False))], names=names)

    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    # only documents that may lose something are shuffled
    hit = rows.withColumn("hit", F.col("doc_id").isNotNull() & F.coalesce(listed(F.col("doc_id")), F.lit(False)))
    cut = hit.where("hit").join(lost, ["doc_id", "tag"], "left").select("doc_id", "text", "lost").mapInArrow(apply, fields + (", spans array<struct<from: long, to: long>>, kept binary" if with_spans else ""))
    body, zero = F.coalesce("text", F.lit("")).cast("binary"), F.lit(0).cast("long")
    whole = {"n_bytes": F.octet_length(body).cast("long"), "n_removed": zero, "n_spans": zero, "kept_sha256": F.sha2(body, 256)}
    if with_spans:
        whole |= {"spans": F.array().cast("array<struct<from: long, to: long>>"), "kept": body}
    return cut.union(hit.where("not hit").select("doc_id", *[c.alias(n) for n, c in whole.items()]))
