"""Line dedup against a plain statement of its rule, on odd rows and on a hot line."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from tripledger.llm import line_dedup

ENDS = " \t\n\x0b\x0c\r"
LINE = "The Same line of FORTY code points or more é"
SHORT = "a line of thirty-nine code points only."
#: Null, empty and blank texts, a null and a repeated id, repeated rows, lines twice in a document, trailing line ends.
ROWS = [
    (1, f"{LINE}\nown line one\n{LINE}"), (2, f"  {LINE.lower().replace('É', 'é')}\t\r\nown"), (3, f"{LINE}\n"), (4, f"\n\n{LINE} \x0c"),
    (5, f"head\n{LINE}\nmiddle\n{LINE}\ntail"), (5, f"other row of five\n{LINE}"), (5, f"head\n{LINE}\nmiddle\n{LINE}\ntail"), (None, f"{LINE}\nnull id"),
    (None, None), (6, ""), (7, None), (8, "\n"), (9, LINE.replace("é", "É")), *[(20 + i, f"{SHORT}\n{i}") for i in range(6)],
    *[(30 + i, "four documents hold this one, which is not enough") for i in range(4)], *[(None, "only rows without an id hold this, all of them") for _ in range(6)],
    (40, "\n".join([LINE + " twice"] * 50)), (41, LINE + " twice\nx"), *[(42 + i, f"x\n{LINE} twice") for i in range(4)], (50, "y\n" * 70_000 + LINE + "\nend\n"),
]


def plain(rows, points=40, least=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(ENDS))

    held = defaultdict(list)
    for d, x in rows:
        for k in {key(line) for line in (x or "").split("\n")}:
            held[k].append(d)
    last = {k: max((d for d in ids if d is not None), default=None) for k, ids in held.items() if len(k) >= points and len(ids) >= least}
    out = Counter()
    for d, x in rows:
        lines = (x or "").split("\n")
        kept = [line for line in lines if key(line) not in last or last[key(line)] == d]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def _found(docs, **more):
    rows = line_dedup.without_shared_lines(docs, with_text=True, **more).collect()
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest() for r in rows)
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows)


def test_lines_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x", b"x", 0) for r in ROWS], "doc_id long, text string, line string, mark binary, lost int").repartition(3)
    assert _found(docs) == plain(ROWS)
    assert _found(docs, points=1, least_docs=2) == plain(ROWS, 1, 2)
    assert line_dedup.without_shared_lines(docs.where("false")).isEmpty()
    renamed = docs.select(docs.doc_id.alias("key"), docs.text.alias("body"), docs.lost.alias("doc_id"))
    assert Counter(r["doc_id"] for r in line_dedup.without_shared_lines(renamed, "key", "body").collect()) == Counter(d for d, _ in ROWS)


def test_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BITS", (1, 64, 64))
    rows = [(i, f"{LINE}\n{i}" if i % 2 else str(i)) for i in range(600)]
    assert _found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == plain(rows)


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_main_path_is_native(spark, threshold):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        text = line_dedup.without_shared_lines(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for node in ("Python", "InArrow", "InPandas", "Cartesian", "NestedLoop", "MapPartitions"):
        assert node not in text
