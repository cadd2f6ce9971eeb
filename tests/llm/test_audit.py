"""The filter audit against the filters applied to rows one after another, in every order."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripledger.llm import filter_audit

WORDS = " ".join(f"w{i}" for i in range(100))
#: Each filter alone and together; copies over parts, a null id and a repeated one among copies, null texts and parts, ties at the limits.
ROWS = [
    (1, WORDS, "en"), (2, WORDS, "de"), (3, WORDS, None), (3, WORDS, "en"), (None, WORDS, ""), (None, "only rows without an id", "en"), (None, "only rows without an id", "en"),
    (4, None, "en"), (5, "", None), (6, "one $", "en"), (7, "SHOUT " * 120, "en"), (8, "shout " * 120, "de"), (9, WORDS + " 100%", "fr"), (10, "A" + "é" * 9, "de"),
    (11, "AB" + "é" * 9, "de"), (12, " ".join(f"v{i % 80}" for i in range(100)), "en"), (13, " ".join(f"v{i % 79}" for i in range(100)), "en"), (14, "w\t" * 99, "en"),
    (15, WORDS.replace(" ", "\x0b"), "en"), (16, WORDS.replace(" ", " "), "en"), (20, "one $", "fr"), (21, "one $", "en"), (22, "\x00" + WORDS, "en"),
    (23, " ".join(f"long{i}" for i in range(300_000)), "en"), (24, "x" * 2_000_000, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (6, 1, 1), (7, None, 1), (12, 1, 0), (99, 1, 1), (None, 1, 1), (21, 0, 0)]


def plain(rows, labels):
    first = {}
    for d, x, _ in rows:
        if d is not None:
            first[x or ""] = min(d, first.get(x or "", d))
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))

    def fails(d, x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", x)) > 10 * len(x), bool(re.search("[#$%&*|]", x)),
                 x in first and (d is None or d > first[x]))
        return {f for f, t in zip("ABCDE", tests, strict=True) if t}

    parts = defaultdict(list)
    for d, x, p in rows:
        parts[p or ""].append((fails(d, x or ""), d in good, d in toxic))
    out = {}
    for p, own in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                before = [r for r in own if f in r[0] and r[0] & set(order[:step - 1])]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                out[p, order, step] = [len(left), len(gone), len(before), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone), f]
        for k, v in out.items():
            if k[0] == p:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def _found(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    found = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*r, 7, "x", 1) for r in ROWS], "doc_id long, text string, lang string, mask int, part string, quality int").repartition(4)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_every_order_on_odd_rows(tables, monkeypatch):
    docs, labels = tables
    expected = plain(ROWS, LABELS)
    assert _found(docs, labels) == expected
    monkeypatch.setattr(filter_audit, "PIECE", 50)
    monkeypatch.setattr(filter_audit, "COUNTED", 1)
    assert _found(docs, labels) == expected
    assert filter_audit.audit(docs.where("false"), labels).isEmpty()
    assert all(v[4:6] == (0, 0) for v in _found(docs, labels.where("false")).values())


def test_full_sketch_and_clear_rows(tables, spark, monkeypatch):
    docs, labels = tables
    facts = filter_audit.features(docs).cache()
    bits = filter_audit.repeated_slots(facts, 1 << 16)
    digests = [(r["d0"], r["d1"]) for r in facts.collect()]
    for k, (a, b) in enumerate(digests):  # every repeated text has both slots set, and so few others that most rows are clear
        at = filter_audit._slots(np.array([a]), np.array([b]), 1 << 16)
        assert (bits[at >> 3] >> (at & 7) & 1).all() == (digests.count(digests[k]) > 1)
    monkeypatch.setattr(filter_audit, "MAX_SLOTS", 8)
    monkeypatch.setattr(filter_audit, "PAGE", 8)
    assert _found(docs, labels) == plain(ROWS, LABELS)


def test_figures_add_up(spark):
    rows = spark.range(500).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 90).cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("lang"))
    found = _found(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len(found) == 3 * 600
    for (part, order, step), (kept, removed, *_, shapley) in found.items():
        total = 167 if part in "01" else 166
        assert kept + sum(found[part, order, s][1] for s in range(1, step + 1)) == total
        assert shapley == sum(v[1] for k, v in found.items() if k[0] == part and k[1][k[2] - 1] == order[step - 1])
