"""Ranked search against scores of all documents, with small blocks and shards, on odd rows and ties."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tripledger.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, top=10):
    docs = [(d, Counter(plain_terms(x))) for d, x in rows]
    docs = [(d, c) for d, c in docs if c]
    df = Counter(t for _, c in docs for t in c)
    length = sum(c.total() for _, c in docs)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in docs:
            m = 100 - 75 + 75 * c.total() * len(docs) // length
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:top], 1)]
    return Counter(out)


def _found(docs, items, **more):
    return Counter(map(tuple, lexical_search.ranked(docs, items, **more).collect()))


def _rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(400):
        topic = rng.integers(0, 4)
        rows.append((d, " ".join(words[int(15 * topic + rng.integers(0, 15) if rng.random() < 0.8 else rng.integers(0, 60))] for _ in range(rng.integers(1, 40)))))
    rows += [(500 + d, "common phrase w1 w2") for d in range(200)]  # ties, and a hot list
    rows += [(None, "common phrase w1 w2"), (500, "common phrase w1 w2"), (7, "w1 ÉTÉ été Été 漢字"), (None, None), (800, None), (801, ""), (802, " .,\t"),
             (803, "W1_w2-w3`w4{w5@w6[w7/w8:w9\x7fw10 naïve"), (804, "rare " * 50_000 + "end"), (805, "x" * 300_000)]
    items = [(0, "w1 w2 W3"), (1, "w1 w1 w1 w20 w50"), (2, "common phrase"), (3, None), (4, ""), (5, "nothing-here"), (6, "été"), (6, "ÉTÉ"), (7, "rare end naïve 漢字"),
             (None, "w59"), (8, "w5 w5"), (8, "w5 w5"), (9, " ".join(words))]
    return rows, items


@pytest.fixture(scope="module")
def tables(spark):
    rows, items = _rows()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, item_id string, n int, terms string").repartition(3)
    return docs, spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, score int")


@pytest.mark.parametrize("sizes", [(8192, 256, 64), (150, 16, 4), (40, 4, 0)])
def test_ranks_are_those_of_all_documents(tables, monkeypatch, sizes):
    for name, size in zip(("SHARD_DOCS", "BLOCK", "SHORT"), sizes, strict=True):
        monkeypatch.setattr(lexical_search, name, size)
    rows, items = _rows()
    assert _found(*tables) == plain(rows, items)


def test_blocks_of_searches_and_other_tops(tables, monkeypatch):
    monkeypatch.setattr(lexical_search, "PAIRS", 4)
    monkeypatch.setattr(lexical_search, "PIECE", 30)
    rows, items = _rows()
    assert _found(*tables, top=3) == plain(rows, items, 3)
    docs, few = tables
    for df in (lexical_search.ranked(docs.where("false"), few), lexical_search.ranked(docs, few.where("false"))):
        assert df.isEmpty() and df.columns == ["item_id", "rank", "doc_id", "score"]


def _shard(rows, terms, top):
    known = {t.encode(): i for i, t in enumerate(terms)}
    counts = [lexical_search.term_counts(x.encode(), known) for _, x in rows]
    held = [sorted((known[t], k) for t, k in c.items()) for _, c in counts]
    df = Counter(t for own in held for t, _ in own)
    stats = lexical_search.Statistics(len(rows), sum(n for n, _ in counts), np.array(
        [math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[t] + 1))) for t in range(len(terms))]))
    import pyarrow as pa

    first = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    flat = np.array([x for h in held for x in h], np.int64).reshape(-1, 2)
    return lexical_search.Shard.built(pa.array([d for d, _ in rows]), np.array([n for n, _ in counts]), first, flat[:, 0], flat[:, 1], stats), stats


def test_summaries_bound_and_skip_blocks(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 8)
    monkeypatch.setattr(lexical_search, "SHORT", 8)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(80)]
    rows = [(d, " ".join(["the"] * 3 + [words[20 * (d % 4) + int(k)] for k in rng.integers(0, 20, 10)])) for d in range(400)]
    shard, stats = _shard(rows, ["the", *words], 10)
    value = np.where(np.isin(np.arange(81), [0, 5, 9, 30]), stats.weight, 0)
    scores = shard.scores(np.arange(400), value)
    members = defaultdict(list)
    for t in range(81):
        lo, hi = shard.list_first[t], shard.list_first[t + 1]
        bounds = shard.bounds(lo, hi, value)
        for k in range(lo, hi):
            docs = shard.member[shard.block_first[k]:shard.block_first[k + 1]]
            assert 0 < len(docs) <= 8
            members[t] += docs.tolist()
            assert shard.summary_first[k] == shard.summary_first[k + 1] or bounds[k - lo] >= scores[docs].max()
    assert all(sorted(members[t + 1]) == [d for d, x in rows if w in x.split()] for t, w in enumerate(words))
    best = lexical_search.Best(10)
    opened, met = lexical_search.search_shard(shard, np.array([0, 5, 9, 30]), value, best)
    assert best.ids.tolist() == np.lexsort((np.arange(400), -scores))[:10].tolist()
    assert 0 < opened < 0.7 * met
