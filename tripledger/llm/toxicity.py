"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are the distinct words of a text and their first bytes, hashed; a feature counts the distinct words that have it. One weight vector is shared by all ordered
thresholds: P(grade <= j) = logistic(threshold_j - weights . features). The output is the expected grade.

Training labels only say toxic or not. A toxic training row gets grade 1, 2 or 3 by the third of the toxic rows in
which its number of marked words lies; a word is marked if one of its features is frequent in toxic rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import held_out, mixed, tidied
from tripledger.llm.quality import distinct
from tripledger.llm.words import LOWER, pieces, words_of

#: Hashed features, lengths in bytes of the beginnings of words that are features, and features that get a weight.
SLOTS = 1 << 20
HEADS = (3, 4, 5, 6)
CHOSEN = 512
#: The training sample: at most so many rows of each label, chosen by the checksum of the id.
SAMPLE_ROWS = 2500
GRADES = 3
STEPS, RATE, PENALTY = 300, 0.1, 5e-5
#: A text is predicted toxic from this probability of a grade of 1 or more on: held-out clean texts stay below 0.2.
CUT = 0.35
_TURN = np.uint64(0xD6E8FEB86659FD93)
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>*_~-"]] = True


@dataclass
class Model:
    """Weight per slot (zero for most) and ascending thresholds; no thresholds if nothing could be learned."""

    weights: np.ndarray
    thresholds: np.ndarray


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots (distinct words, 1 + len(HEADS)), text of each row, distinct words per text. Marks around words are left out."""
    words = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), words.counts)
    _, _, one = distinct(owner, words.value, len(texts))
    owner, start, end = owner[one], words.start[one].copy(), words.end[one].copy()
    for _ in range(3):
        start += _EDGE[words.body[start]] & (end - start > 1)
        end -= _EDGE[words.body[end - 1]] & (end - start > 1)
    body = np.append(words.body, np.zeros(64, np.uint8)).astype(np.uint64)
    size = end - start
    out = np.zeros((len(owner), 1 + len(HEADS)), np.int64)
    acc = np.zeros(len(owner), np.uint64)
    for j in range(int(min(size.max(initial=0), 64))):
        acc = np.where(j < size, (acc + body[start + j] + np.uint64(1)) * _TURN, acc)
        if j + 1 in HEADS:
            slot = (mixed(acc + np.uint64(j + 1)) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
            out[:, 1 + HEADS.index(j + 1)] = np.where(size > j, slot, 0)
    out[:, 0] = (mixed(acc) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    return out, owner, np.bincount(owner, minlength=len(texts))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def regress(slots: np.ndarray, row: np.ndarray, grade: np.ndarray, columns: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the proportional-odds model by Adam; ``slots`` and ``row`` are the ones of a sparse table."""
    top = max(grades, 1)
    w, cut = np.zeros(columns), np.concatenate([[1.0], np.full(top - 1, 0.0)])  # first threshold, logs of the gaps
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cut), np.zeros_like(cut)]
    n = len(grade)
    for step in range(1, STEPS + 1):
        theta = cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])
        line = np.bincount(row, w[slots], n)
        ends = _logistic(np.concatenate([np.full((n, 1), -60.0), theta[None, :] - line[:, None], np.full((n, 1), 60.0)], axis=1))
        ends[:, 0], ends[:, -1] = 0, 1
        up, low = ends[np.arange(n), grade + 1], ends[np.arange(n), grade]
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p  # of log p by the upper and the lower threshold
        d_line = (d_up - d_low) / n
        g_w = np.bincount(slots, d_line[row], columns) + PENALTY * w
        g_theta = np.zeros(top)
        for j in range(top):
            g_theta[j] = (d_low[grade == j + 1].sum() - d_up[grade == j].sum()) / n
        later = np.cumsum(g_theta[::-1])[::-1]
        g_cut = np.concatenate([[later[0]], later[1:] * np.exp(cut[1:])])
        for value, grad, m, v in ((w, g_w, moments[0], moments[1]), (cut, g_cut, moments[2], moments[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w, cut[0] + np.concatenate([[0.0], np.cumsum(np.exp(cut[1:]))])


def fit(texts: list[bytes], toxic: list[int]) -> Model:
    """The model of labelled texts. Without rows of both labels every text has severity 0."""
    y = np.array(toxic, np.int64)
    none = Model(np.zeros(SLOTS, np.float32), np.zeros(0))
    if not (y == 1).any() or not (y == 0).any():
        return none
    with_, without = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)
    for lo, hi in pieces(texts):  # piece by piece, as the driver holds little
        slots, row, _ = features(texts[lo:hi])
        keys = np.unique((np.repeat(row, slots.shape[1]) * SLOTS + slots.ravel())[slots.ravel() > 0])
        toxic_row = y[lo + keys // SLOTS] == 1
        np.add.at(with_, keys[toxic_row] % SLOTS, 1)
        np.add.at(without, keys[~toxic_row] % SLOTS, 1)
    a, b = with_ / np.float32((y == 1).sum()), without / np.float32((y == 0).sum())
    strength = np.where(with_ + without >= 3, (a - b) ** 2 / np.maximum(a + b, 1e-12), 0)
    chosen = np.argsort(-strength, kind="stable")[:CHOSEN]
    chosen = chosen[strength[chosen] > 0]
    if not len(chosen):
        return none
    marked = (with_ >= 3) & (a > 20 * b)
    column = np.full(SLOTS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    marks, flats, owners = np.zeros(len(y)), [], []
    for lo, hi in pieces(texts):
        slots, row, _ = features(texts[lo:hi])
        marks[lo:hi] = np.bincount(row, marked[slots].any(1).astype(float), hi - lo)
        flat, of = column[slots].ravel(), lo + np.repeat(row, slots.shape[1])
        flats.append(flat[flat >= 0])
        owners.append(of[flat >= 0])
    grade = np.zeros(len(y), np.int64)
    steps = np.quantile(marks[y == 1], np.arange(1, GRADES) / GRADES)
    grade[y == 1] = 1 + np.searchsorted(steps, marks[y == 1], side="left")
    w, thresholds = regress(np.concatenate(flats), np.concatenate(owners), grade, len(chosen), GRADES)
    weights = np.zeros(SLOTS, np.float32)
    weights[chosen] = w
    return Model(weights, thresholds)


def severities(texts: list[bytes], model: Model) -> np.ndarray:
    """P(grade >= j) for each text and grade from 1."""
    if not len(model.thresholds):
        return np.zeros((len(texts), GRADES))
    slots, row, _ = features(texts)
    line = np.bincount(row, model.weights[slots].sum(1, dtype=np.float64), len(texts))
    return 1 - _logistic(model.thresholds[None, :] - line[:, None])


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8").translate(LOWER)


def graded(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, score (P(grade >= 1)), severity (expected grade, 0 to 3), predicted (1 from CUT on).

    Learns from at most SAMPLE_ROWS rows of each label that are not held out. Null and empty texts have no features and
    so the severity of the thresholds alone. Repeated rows get equal rows; a repeated label counts each time. Other
    columns are not read; an empty table gives an empty table; without both labels all severities are 0.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label"))
    picked, counts = None, {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    for value in (0, 1):
        # only about the wanted ids leave the tasks, whatever their number
        share = min(1.0, 1.3 * SAMPLE_ROWS / max(1, counts.get(value, 0)))
        near = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) <= int(share * (1 << 30))
        part = known.where((F.col("label") == value) & near).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
        picked = part if picked is None else picked.union(part)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # at most 2 * SAMPLE_ROWS ids are broadcast
    sample = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text").orderBy("doc_id", "label").collect()
    model = fit([_bytes(r["text"]) for r in sample], [r["label"] for r in sample])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_bytes(x.as_py()) for x in batch.column(1)]
            for lo, hi in pieces(texts):
                p = severities(texts[lo:hi], shared.value)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array((p[:, 0] >= CUT).astype(np.int32))],
                                      names=["doc_id", "score", "severity", "predicted"])

    return rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, severity double, predicted int")
