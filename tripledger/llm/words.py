"""Words and word shingles of many texts at once, as pairs of 64-bit values in numpy arrays.

The values of a word are the halves of a 128-bit BLAKE2b digest of its bytes, so no two words are known that share them;
``sliced_words_of`` makes cheaper ones from a seed, for callers that draw one and compare the words themselves.
Runs of words chain their values with shifts between the steps, so that no sum of differences cancels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tripledger.llm.common import AT_END, BLANK_BYTES, mixed

#: Bytes of text that are looked at together; a longer text is one piece by itself.
PIECE = 3_000_000
#: Digests of words that a process remembers.
REMEMBERED = 150_000
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FOLD = np.uint64(29)
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANK_BYTES)] = True

#: Lower-cases A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Digests(dict):
    """Digests of words, made when first asked for."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return found


_DIGESTS = _Digests()
AT_END.append(_DIGESTS.clear)


def pieces(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``size`` bytes together."""
    lo, filled = 0, 0
    for i, text in enumerate(texts):
        filled += len(text)
        if filled >= size:
            yield lo, i + 1
            lo, filled = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


@dataclass
class Words:
    """The words of texts: byte ranges in ``body``, two values of each, and the first word of each text (one more at the end)."""

    body: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    other: np.ndarray
    first: np.ndarray
    #: Of ``sliced_words_of``: two numbers a word, which with its length tell any two words apart.
    exact: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[bytes]) -> Words:
    whole = b" ".join(texts) + b" "
    body = np.frombuffer(whole, np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    turn = np.flatnonzero(np.diff(_BLANK[body], prepend=True))
    start, end = turn[0::2], turn[1::2]
    first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    values = np.frombuffer(b"".join(map(_DIGESTS.__getitem__, whole.split())), np.uint64).reshape(-1, 2)  # splits at the same blanks
    return Words(body, start, end, values[:, 0].copy(), values[:, 1].copy(), first)


#: Masks that keep the first 0 to 8 bytes of a number, and the odd factors that join the parts of a word.
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = tuple(np.uint64(f) for f in (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F))


def sliced_words_of(texts: list[bytes], seed: int) -> Words:
    """As ``words_of``, by columns: the values of a word of up to 16 bytes are made of its bytes and ``seed`` in place of a digest.

    Longer words have digests. ``exact`` holds the bytes of short words; long ones are numbered within the call.
    """
    whole = b" ".join(texts) + b" " * 17
    body = np.frombuffer(whole, np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    blank = _BLANK[body]
    turn = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        turn = np.concatenate([[0], turn])
    start, end = turn[0::2], turn[1::2]
    first = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
    size = end - start
    eight = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))  # the eight bytes from each place on
    one = eight[start] & _HEADS[np.minimum(size, 8)]
    two = eight[start + 8] & _HEADS[np.clip(size - 8, 0, 8)]
    keys = (mixed(np.array([seed & (1 << 64) - 1, seed >> 64], np.uint64)) | np.uint64(1))
    length = size.astype(np.uint64) * _FACTORS[0]
    value = mixed(mixed(one ^ keys[0]) + two * _FACTORS[1] + length)
    other = mixed(mixed(two ^ keys[1]) + one * _FACTORS[2] + length)
    long = np.flatnonzero(size > 16)
    if len(long):
        words, number = [whole[a:b] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], {}
        digests = np.frombuffer(b"".join(map(_DIGESTS.__getitem__, words)), np.uint64).reshape(-1, 2)
        value[long], other[long] = digests[:, 0], digests[:, 1]
        one[long], two[long] = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(long)), 0
    return Words(body, start, end, value, other, first, (one, two))


def runs_of(value: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` neighbouring values, also of runs that cross texts."""
    if len(value) < n:
        return np.zeros(0, np.uint64)
    out = value[:len(value) - n + 1].copy()
    for j in range(1, n):
        out ^= out >> _FOLD
        out *= _STEP
        out += value[j:len(value) - n + 1 + j]
    return mixed(out)


def shingles_of(words: Words, n: int = 5, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text and the first of each text (one more at the end).

    A text with fewer words has its whole sequence as one shingle; a text without words has none. With ``other``, hashes
    of the words' other values, which are independent.
    """
    value, counts = words.other if other else words.value, words.counts
    whole = runs_of(value, n)
    have = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(have)])
    out = np.zeros(first[-1], np.uint64)
    long = np.flatnonzero(counts >= n)
    reps = have[long]
    inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    out[np.repeat(first[long], reps) + inside] = whole[np.repeat(words.first[long], reps) + inside]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        # the number of words comes first, so that a short sequence is no part of a longer one
        own = np.concatenate([counts[i:i + 1].astype(np.uint64), value[words.first[i]:words.first[i + 1]]])
        out[first[i]] = runs_of(own, len(own))[0]
    return out, first
