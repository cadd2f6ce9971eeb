"""Byte-level BPE by Spark higher-order functions: ranked merges folded over the bytes of distinct words.

Documents are split by the tokenizer's pattern in blocks of neighbouring documents. A block sends its distinct words, each
once, as one character per byte with the ascending ranks of all tokens inside the word, and then its documents as
numbers of words. The fold replaces, rank after rank, the pair that the literal rank map holds for the rank by the
character of the merged token. Words are followed by the documents of their block in the same task, so nothing is
shuffled, no dictionary grows with the input, and a lost task repeats alone.

Applying merges in the order of their ranks, leftmost first, is what the reference encoders do one merge at a time: a
token is made of the one pair into which the lower ranks leave its own bytes, so no merge can call for a lower rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tripledger.llm.common import tidied

#: Characters of a block of documents that share one list of distinct words.
BLOCK_CHARS = 8_000_000
#: Words and documents per Arrow batch, and tokens of a batch that carries them.
BATCH = 8192
DOCUMENT_BATCH = 512
MOST_TOKENS = 200_000
#: The character of token k is FIRST_CHAR + k: every rank below 54,016 stays under the surrogates.
FIRST_CHAR = 0x100
MOST_RANKS = 0xD800 - FIRST_CHAR
OWN = 1 << 16


@dataclass
class Ranks:
    """A rank file: the bytes of every token, and the pair that makes each token of two or more bytes."""

    tokens: list[bytes]
    pairs: dict[int, tuple[int, int]]

    @cached_property
    def by_bytes(self) -> dict[bytes, int]:
        return {t: r for r, t in enumerate(self.tokens) if t}

    @cached_property
    def by_word(self) -> dict[str, int]:
        """Tokens that are whole characters."""
        found = {}
        for token, rank in self.by_bytes.items():
            try:
                found[token.decode("utf-8")] = rank
            except UnicodeDecodeError:
                pass
        return found

    @cached_property
    def inside(self) -> Inside:
        return Inside(self)


def read_ranks(path: str) -> Ranks:
    """Reads a rank file (base64 bytes and rank a line). Ranks must be below 54,016."""
    with open(path, "rb") as lines:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    if max(found) >= MOST_RANKS:
        raise ValueError(f"ranks must be below {MOST_RANKS}")
    tokens = [found.get(r, b"") for r in range(max(found) + 1)]
    by, pairs = {t: r for r, t in found.items()}, {}
    for rank in sorted(found):
        parts = [by[tokens[rank][i:i + 1]] for i in range(len(tokens[rank]))]
        while len(parts) > 2:
            made = [by.get(tokens[a] + tokens[b], rank) for a, b in zip(parts[:-1], parts[1:], strict=True)]
            low = min(made)
            if low >= rank:
                break  # no merge order reaches this token; only a word that is the token itself gives it
            at = made.index(low)
            parts[at:at + 2] = [low]
        if len(parts) == 2:
            pairs[rank] = (parts[0], parts[1])
    return Ranks(tokens, pairs)


class _Codes(dict):
    """Numbers of words: the rank of a word that is a token, else OWN and more in the order of first use."""

    def __init__(self, known: dict[str, int]) -> None:
        super().__init__(known)
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = OWN + len(self.words)
        self.words.append(word)
        return code


class Inside:
    """Which merged tokens the bytes of words hold.

    Tokens and their beginnings are slots of two hash tables without keys. A slot taken by chance only adds a rank whose
    pair the fold then does not meet, so no check is needed; no token is ever missed.
    """

    SLOTS = 1 << 21
    STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

    def __init__(self, ranks: Ranks) -> None:
        merged = {ranks.tokens[r]: r for r in ranks.pairs}
        heads = {t[:n] for t in merged for n in range(2, len(t))}
        self.longest = max(map(len, merged), default=0)
        self.tables = [np.zeros(self.SLOTS, np.int32) for _ in self.STEPS]  # 0: nothing, 1: a beginning, rank + 2: a token
        left = sorted(merged) + sorted(heads - set(merged))
        for table, step in zip(self.tables, self.STEPS, strict=True):
            slots = self._slots([self._hash(t, step) for t in left])
            value = [merged.get(t, -1) + 2 for t in left]
            rest = []
            for t, slot, v in zip(left, slots.tolist(), value, strict=True):
                if table[slot] == 0:
                    table[slot] = v
                elif v > 1 or table[slot] < 1:
                    rest.append(t)
            left = rest
        if any(t in merged for t in left):
            raise ValueError("the rank file has too many tokens for the tables")

    @staticmethod
    def _hash(token: bytes, step: np.uint64) -> int:
        value = 0
        for b in token:
            value = (value * int(step) + b + 1) & (2**64 - 1)
        return value

    def _slots(self, hashes) -> np.ndarray:
        x = np.asarray(hashes, np.uint64)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x >> np.uint64(43)).astype(np.int64)

    def find(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and ranks, ascending and distinct, of words laid end to end."""
        word = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at, room = np.arange(len(flat)), ends[word] - np.arange(len(flat))
        body, found = flat.astype(np.uint64) + np.uint64(1), []
        values = [body.copy() for _ in self.STEPS]
        for length in range(2, self.longest + 1):
            open_ = np.flatnonzero(room >= length)
            if not len(open_):
                break
            at, room = at[open_], room[open_]
            values = [v[open_] * step + body[at + length - 1] for v, step in zip(values, self.STEPS, strict=True)]
            hits = [table[self._slots(v)] for v, table in zip(values, self.tables, strict=True)]
            for hit in hits:
                token = np.flatnonzero(hit > 1)
                found.append((word[at[token]] << 16) | (hit[token] - 2))
            alive = np.flatnonzero((hits[0] > 0) | (hits[1] > 0))
            at, room, values = at[alive], room[alive], [v[alive] for v in values]
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return keys >> 16, keys & 0xFFFF


def _characters(ids: list[int]) -> str:
    return "".join([chr(FIRST_CHAR + k) for k in ids])


def words_and_documents(rows: DataFrame, ranks: Ranks, text_pattern: str, block_chars: int | None = None) -> DataFrame:
    """Rows (doc_id, text) as rows of words (chars, merges) followed by rows of documents (doc_id, stream), block by block."""
    most = block_chars or BLOCK_CHARS
    # the tokenizer, whatever the input; its tables are made once, here
    shared = rows.sparkSession.sparkContext.broadcast(([ranks.by_bytes[bytes([i])] for i in range(256)], ranks.by_word, ranks.inside, text_pattern))
    kind = dict(rows.dtypes)["doc_id"]
    schema = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("stream", pa.binary()), ("chars", pa.string()), ("merges", pa.list_(pa.int32()))])

    @tidied
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, known, inside, pattern = shared.value
        pieces = regex.compile(pattern)
        byte = {i: FIRST_CHAR + rank for i, rank in enumerate(single)}

        def block(ids: list, streams: list[bytes], words: list[str]) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(words), BATCH):
                bodies = [w.encode("utf-8") for w in words[lo:lo + BATCH]]
                ends = np.cumsum([len(b) for b in bodies])
                flat = b"".join(bodies)
                row, rank = inside.find(np.frombuffer(flat, np.uint8), ends)
                line = flat.decode("latin-1").translate(byte)
                chars = [line[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                n = len(chars)
                cuts = np.searchsorted(row, np.arange(n + 1))
                merges = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rank, pa.int32()))
                yield pa.record_batch([pa.nulls(n, schema.field(0).type), pa.nulls(n, pa.binary()), pa.array(chars), merges], schema=schema)
            for lo in range(0, len(ids), DOCUMENT_BATCH):
                hi = min(lo + DOCUMENT_BATCH, len(ids))
                n = hi - lo
                yield pa.record_batch([pa.array(ids[lo:hi], schema.field(0).type), pa.array(streams[lo:hi], pa.binary()),
                                       pa.nulls(n, pa.string()), pa.nulls(n, schema.field(3).type)], schema=schema)

        # a text becomes numbers as it comes, so that no block holds its texts
        ids, streams, codes, filled = [], [], _Codes(known), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id)
                streams.append(np.fromiter(map(codes.__getitem__, pieces.findall(text)), np.int32).tobytes())
                filled += len(text)
                if filled >= most:
                    yield from block(ids, streams, codes.words)
                    ids, streams, codes, filled = [], [], _Codes(known), 0
        if ids:
            yield from block(ids, streams, codes.words)

    return rows.mapInArrow(split, f"doc_id {kind}, stream binary, chars string, merges array<int>")


def folded(chars: Column, merges: Column, ranks: Ranks) -> Column:
    """The word after all merges: for each rank, the pair of the literal rank map becomes the merged character."""
    pairs = [_characters(list(ranks.pairs[r])) if r in ranks.pairs else "" for r in range(len(ranks.tokens))]
    merged = [_characters([r]) for r in range(len(ranks.tokens))]
    pair_map = F.split(F.lit("\n".join(pairs)), "\n")
    merged_map = F.split(F.lit("\n".join(merged)), "\n")
    return F.aggregate(merges, chars, lambda word, rank: F.replace(word, F.get(pair_map, rank), F.get(merged_map, rank)))


def encoded(docs: DataFrame, ranks: Ranks, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, block_chars: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also ids and decoded (bytes).

    Texts are split whole by ``pattern``; no special tokens; null text is empty text and has no tokens. Decoding joins
    the bytes of the ids. Smaller blocks (``block_chars``) take less memory and more time. Other columns are not read; repeated rows give equal rows; an empty table an empty table.
    """
    rows = words_and_documents(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ranks, pattern, block_chars)
    merged = rows.select("doc_id", "stream", folded(F.col("chars"), F.col("merges"), ranks).alias("word"))
    kind = dict(rows.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(ranks.tokens)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]

    @tidied
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        spare = [""] * (OWN - len(tokens))
        plain = [str(i) for i in range(len(tokens))] + spare
        bodies = tokens + [b""] * len(spare)
        numbers, parts, counts = list(plain), list(bodies), [1] * OWN
        size, after_documents = np.array(counts), False
        for batch in batches:
            streams, words = batch.column(1), batch.column(2)
            out, kept, held_tokens = {n: [] for n in names[1:]}, [], 0
            for i, (stream, word) in enumerate(zip(streams, words, strict=True)):
                if not stream.is_valid:
                    if after_documents:  # the first word of the next block
                        numbers, parts, counts, after_documents = list(plain), list(bodies), [1] * OWN, False
                    ids = [ord(c) - FIRST_CHAR for c in word.as_py()]
                    numbers.append(",".join([plain[k] for k in ids]))
                    parts.append(b"".join([tokens[k] for k in ids]))
                    counts.append(len(ids))
                    continue
                if not after_documents:
                    size, after_documents = np.array(counts), True
                codes = np.frombuffer(stream.as_py(), np.int32)
                many = codes.tolist()
                pick = itemgetter(*many) if len(many) > 1 else (lambda x, m=many: [x[k] for k in m])
                csv, body = ",".join(pick(numbers)), b"".join(pick(parts))
                kept.append(i)
                held_tokens += int(size[codes].sum())
                out["n_tokens"].append(int(size[codes].sum()))
                out["ids_sha256"].append(hashlib.sha256(csv.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(body).hexdigest())
                if with_ids:
                    out["ids"].append(np.array(csv.split(","), np.int32) if csv else np.zeros(0, np.int32))
                    out["decoded"].append(body)
                    if held_tokens > MOST_TOKENS:
                        yield rows_of(batch, kept, out)
                        out, kept, held_tokens = {n: [] for n in names[1:]}, [], 0
            if kept:
                yield rows_of(batch, kept, out)

    def rows_of(batch: pa.RecordBatch, kept: list[int], out: dict[str, list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        return pa.record_batch([batch.column(0).take(pa.array(kept)), *(pa.array(out[n], k) for n, k in zip(names[1:], kinds, strict=False))], names=names)

    fields = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return merged.mapInArrow(join, fields + (", ids array<int>, decoded binary" if with_ids else ""))
