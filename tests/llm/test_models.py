"""The trained operators against their formulas, written out one value at a time."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripledger.llm import language_id, quality, toxicity

TEXTS = ["", "a", "The quick brown fox; jumps, over 12 lazy dogs!\nAnd again the quick brown fox", "ünï çødé 漢字 $$$ ##", "x " * 50, "\n\n", "One two. " * 7 + "END"]


def plain_network(text: bytes, w: dict) -> np.ndarray:
    """Mean class probabilities over the bytes of a text, in runs of SPAN bytes, one byte at a time."""
    squash = lambda x: x / (1 + abs(x))

    def states(run: bytes, table: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
        n = table.shape[0] // 3
        h, out = np.zeros(n), []
        for byte in run:
            x, a = table[:, byte].astype(float), u.astype(float) @ h
            z, r = 0.5 + 0.5 * squash(a[:n] + x[:n]), 0.5 + 0.5 * squash(a[n:2 * n] + x[n:2 * n])
            g = squash(r * a[2 * n:] + x[2 * n:])
            h = z * h + (1 - z) * g
            out.append(h)
        return out

    total = np.zeros(len(w["c"]))
    for lo in range(0, len(text), language_id.SPAN):
        run = text[lo:lo + language_id.SPAN]
        ahead, behind = states(run, w["tf"], w["uf"]), states(run[::-1], w["tb"], w["ub"])[::-1]
        for f, b in zip(ahead, behind, strict=True):
            e = np.exp(w["v"].astype(float) @ np.concatenate([f, b]) + w["c"])
            total += e / e.sum()
    return total / max(1, len(text))


def test_network_byte_by_byte_and_at_run_borders():
    rng = np.random.default_rng(4)
    n, span = 5, language_id.SPAN
    shapes = {"tf": (3 * n, 256), "tb": (3 * n, 256), "uf": (3 * n, n), "ub": (3 * n, n), "v": (3, 2 * n), "c": (3,)}
    w = {k: rng.normal(0, 0.7, s).astype(np.float32) for k, s in shapes.items()}
    model = language_id.Model(["de", "en", "fr"], w)
    texts = [rng.integers(0, 256, size).astype(np.uint8).tobytes() for size in (0, 1, 2, span - 1, span, span + 1, 2 * span, 3 * span + 7)]
    found = language_id.pooled(texts, model)
    for text, p in zip(texts, found, strict=True):
        assert np.allclose(p, plain_network(text, w), atol=2e-4)


def plain_statistics(text: str) -> list[float]:
    data = text.encode()
    words = data.split()
    kinds = Counter(words)
    phrases = {tuple(words[i:i + 3]) for i in range(len(words) - 2)}
    tests = {
        "upper": rb"[A-Z]", "digits": rb"[0-9]", "symbols": rb"[!#$%&*+/<=>@\\^_`{|}~]", "marks": rb"[.,;:?'\"()\-]", "wide": rb"[\x80-\xff]", "lines": rb"\n"}
    usual, pad = quality.USUAL, quality.PAD_WORDS
    shares = [math.sqrt((len(re.findall(p, data)) + quality.PAD_BYTES * usual[k]) / (len(data) + quality.PAD_BYTES)) for k, p in tests.items()]
    ratio = lambda k, part, whole: (part + pad * usual[k]) / (whole + pad)
    return [math.log(ratio("word_length", sum(map(len, words)), len(words))), *shares, math.log(ratio("vocabulary", len(kinds), len(words))),
            math.sqrt(ratio("common", max(kinds.values(), default=0), len(words))), ratio("phrases", len(phrases), max(len(words) - 2, 0))]


def test_document_statistics_one_text_at_a_time():
    assert np.allclose(quality.statistics([t.encode() for t in TEXTS]), [plain_statistics(t) for t in TEXTS], atol=1e-12)


def test_discriminant_from_plain_moments(spark):
    rng = np.random.default_rng(6)
    size = len(quality.STATISTICS)
    label = rng.integers(0, 2, 120)
    x = rng.normal(0, 1, (120, size)) @ rng.normal(0, 1, (size, size)) + label[:, None] * 0.7
    rows = spark.createDataFrame([(v.tolist(), int(y)) for v, y in zip(x, label, strict=True)] + [(x[0].tolist(), None)], "x array<double>, label int").repartition(5)
    model = quality.fit(rows)
    spread = [np.cov(x[label == c].T, bias=True) for c in (0, 1)]
    share = [(label == c).mean() for c in (0, 1)]
    both = share[0] * spread[0] + share[1] * spread[1]
    log = []
    for c in (0, 1):
        own = (1 - quality.POOLED) * spread[c] + quality.POOLED * both
        own = (1 - quality.DIAGONAL) * own + quality.DIAGONAL * np.diag(np.diag(own)) + quality.FLOOR * np.eye(size)
        away = x - x[label == c].mean(0)
        # log density of a normal distribution by the inverse and the determinant
        log.append(math.log(share[c]) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(own), away))
    plain = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -quality.MOST, quality.MOST)))
    assert np.allclose(model.score(x), plain, atol=1e-6)


def test_severities_from_a_dense_formula():
    rng = np.random.default_rng(8)
    texts = [t.encode().translate(toxicity.LOWER) for t in TEXTS]
    slots, row, _ = toxicity.features(texts)
    weights = np.zeros(toxicity.SLOTS, np.float32)
    used = np.unique(slots[slots > 0])
    weights[used] = rng.normal(0, 0.4, len(used))
    model = toxicity.Model(weights, np.array([-0.5, 0.4, 1.3]))
    found = toxicity.severities(texts, model)
    for i in range(len(texts)):
        line = sum(float(weights[s]) for s, r in zip(slots.tolist(), row.tolist(), strict=True) if r == i for s in s)
        at_most = [1 / (1 + math.exp(-(t - line))) for t in model.thresholds]
        assert np.allclose(found[i], [1 - p for p in at_most], atol=1e-5)
        # the expected grade is the sum over grades of their probabilities
        grades = np.diff([0, *at_most, 1])
        assert found[i].sum() == pytest.approx(sum(g * p for g, p in enumerate(grades)), abs=1e-5)


def test_regression_is_a_minimum_of_the_penalised_likelihood():
    rng = np.random.default_rng(9)
    dense = rng.random((400, 6)) < 0.3
    truth = dense @ np.array([2.0, -1.0, 0.5, 0.0, 1.5, -0.5]) + rng.logistic(0, 1, 400)
    grade = np.searchsorted([0.0, 1.0, 2.5], truth)
    row, slots = np.nonzero(dense)
    w, cut = toxicity.regress(slots, row, grade, 6, 3)

    def loss(w, cut):
        line = dense @ w
        ends = np.concatenate([np.zeros((400, 1)), 1 / (1 + np.exp(-(cut[None, :] - line[:, None]))), np.ones((400, 1))], axis=1)
        return -np.log(ends[np.arange(400), grade + 1] - ends[np.arange(400), grade]).mean() + toxicity.PENALTY * (w**2).sum() / 2

    best = loss(w, cut)
    for k in range(6):
        for step in (-0.15, 0.15):
            assert loss(w + step * np.eye(6)[k], cut) > best
    for k in range(3):
        for step in (-0.15, 0.15):
            assert loss(w, cut + step * np.eye(3)[k]) > best


def test_models_with_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "d e f", 5), (None, "a b c", 5), (None, None, 5), (2, "$$ ##", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for found in (quality.scored(docs, labels), toxicity.graded(docs, labels)):
        assert Counter(r["doc_id"] for r in found.collect()) == {1: 2, 2: 1, None: 2}
        assert found.where(F.col("score").isNull()).isEmpty()
