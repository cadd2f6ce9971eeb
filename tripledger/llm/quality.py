"""Quality by regularised quadratic discriminants over transformed document statistics.

Each class has its own mean and covariance of the statistics, shrunk towards the pooled covariance and its diagonal. A
document's score is the logistic of the difference of the two Mahalanobis log densities. The Cholesky factors are
computed once; the sums that they come from are taken over all labelled rows by the tasks that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.llm.common import held, held_out, tidied
from tripledger.llm.words import Words, pieces, runs_of, words_of

#: Weights of the pooled covariance and of its diagonal in a class covariance, and the least variance of a statistic.
POOLED, DIAGONAL, FLOOR = 0.1, 0.1, 1e-4
#: Log densities differ by at most so much; the score then stays inside 0 to 1.
MOST = 30.0
KEEP = 0.7
#: Words and bytes that every document is padded with, in thought, at the usual shares of prose: a short text then says
#: little about itself, and its shares cannot be extreme by chance.
PAD_WORDS, PAD_BYTES = 50, 300
USUAL = {"word_length": 5.0, "upper": 0.014, "digits": 0.001, "symbols": 0.0005, "marks": 0.025, "wide": 0.03, "lines": 0.004,
         "vocabulary": 0.85, "common": 0.06, "phrases": 0.99}
STATISTICS = ("word_length", "upper", "digits", "symbols", "marks", "wide", "lines", "vocabulary", "common", "phrases")
_TABLES = np.zeros((6, 256), bool)
_TABLES[0, 65:91] = True  # A-Z
_TABLES[1, 48:58] = True  # digits
_TABLES[2, [ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"]] = True  # symbols
_TABLES[3, [ord(c) for c in ".,;:?'\"-()"]] = True  # marks of prose
_TABLES[4, 128:] = True  # bytes of wide characters
_TABLES[5, 10] = True  # line ends


def distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of distinct values and the count of the most frequent, and one position of each value."""
    if not len(value):
        return np.zeros(n), np.zeros(n), np.zeros(0, np.int64)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    cut = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])]))
    times = np.diff(np.append(cut, len(o)))
    most = np.zeros(n)
    np.maximum.at(most, o[cut], times)
    return np.bincount(o[cut], minlength=n).astype(float), most, order[cut]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of shares and logarithms of ratios, each with the padding; an empty text is only padding."""
    n = len(texts)
    words: Words = words_of(texts)
    size = np.array([len(t) for t in texts], float)
    ends = np.cumsum(size + 1).astype(np.int64)
    starts = ends - size.astype(np.int64) - 1
    share = []
    for name, table in zip(STATISTICS[1:7], _TABLES, strict=True):
        sums = np.concatenate([[0], np.cumsum(table[words.body], dtype=np.int64)])
        share.append(np.sqrt((sums[ends - 1] - sums[starts] + PAD_BYTES * USUAL[name]) / (size + PAD_BYTES)))
    counts = words.counts.astype(float)
    owner = np.repeat(np.arange(n), words.counts)
    kinds, most, _ = distinct(owner, words.value, n)
    three = runs_of(words.value, 3)
    inside = np.arange(len(three)) + 3 <= words.first[owner[:len(three)] + 1]
    phrases, _, _ = distinct(owner[:len(three)][inside], three[inside], n)
    total = np.maximum(counts - 2, 0)
    letters = np.bincount(owner, words.end - words.start, n)

    def ratio(name: str, part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return (part + PAD_WORDS * USUAL[name]) / (whole + PAD_WORDS)

    return np.column_stack([
        np.log(ratio("word_length", letters, counts)), *share, np.log(ratio("vocabulary", kinds, counts)),
        np.sqrt(ratio("common", most, counts)), ratio("phrases", phrases, total)])


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode("utf-8") for x in batch.column(1)]
            for lo, hi in pieces(texts):
                x = statistics(texts[lo:hi])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), flat], names=["doc_id", "x"])

    return kept.mapInArrow(rows, f"doc_id {dict(kept.dtypes)['doc_id']}, x array<double>")


@dataclass
class Discriminant:
    """Per class: mean, inverse Cholesky factor of the covariance, and log density offset. None without two classes."""

    mean: list[np.ndarray]
    root: list[np.ndarray]
    offset: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        log = [c - 0.5 * (((x - m) @ r.T) ** 2).sum(1) for m, r, c in zip(self.mean, self.root, self.offset, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -MOST, MOST)))


def fit(rows: DataFrame) -> Discriminant | None:
    """From rows (x, label): sums and products per class, added up by the tasks; null labels are left out."""

    @tidied
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for label, part in batch.groupby("label"):
                x = np.column_stack([np.ones(len(part)), np.stack(part["x"].to_numpy())])
                found[int(label)] = found.get(int(label), 0) + x.T @ x
        yield pd.DataFrame({"label": list(found), "moments": [m.ravel().tolist() for m in found.values()]})

    total: dict[int, np.ndarray] = {}
    for r in rows.where("label in (0, 1)").mapInPandas(sums, "label int, moments array<double>").collect():  # two rows per task
        total[r["label"]] = total.get(r["label"], 0) + np.array(r["moments"]).reshape(len(STATISTICS) + 1, -1)
    if len(total) < 2:
        return None
    mean, spread = [], []
    for label in (0, 1):
        m = total[label]
        mean.append(m[0, 1:] / m[0, 0])
        spread.append(m[1:, 1:] / m[0, 0] - np.outer(mean[-1], mean[-1]))
    weight = [total[c][0, 0] for c in (0, 1)]
    pooled = (weight[0] * spread[0] + weight[1] * spread[1]) / sum(weight)
    root, offset = [], []
    for label in (0, 1):
        own = (1 - POOLED) * spread[label] + POOLED * pooled
        own = (1 - DIAGONAL) * own + DIAGONAL * np.diag(np.diag(own)) + FLOOR * np.eye(len(own))
        low = np.linalg.cholesky(own)
        root.append(np.linalg.inv(low))
        offset.append(float(np.log(weight[label] / sum(weight)) - np.log(np.diag(low)).sum()))
    return Discriminant(mean, root, offset)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from KEEP on).

    Learns from rows with a label for which ``learn`` (a condition on doc_id) holds; by default those that are not held
    out. Null text is empty text. Without rows of both labels every score is 0.5. Repeated rows get equal rows; repeated
    labels count each. Other columns are not read; an empty table gives an empty table.
    """
    stats = held(document_statistics(docs, doc_id, text))
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("label"))
    learn = ~held_out(F.col("doc_id")) if learn is None else learn
    model = fit(stats.where(learn).join(known, F.col("doc_id") == F.col("_id")).select("x", "label"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if shared.value is None or not len(x):
            return pd.Series(np.full(len(x), 0.5))
        return pd.Series(shared.value.score(np.stack(x.to_numpy())))

    return stats.select("doc_id", score("x").alias("score")).withColumn("predicted", (F.col("score") >= KEEP).cast("int"))
