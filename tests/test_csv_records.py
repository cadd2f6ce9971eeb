"""CSV records over many splits against the standard reader; many files in one scan."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tripledger.plans import runs
from tripledger.sources.csv_records import csv_records
from tripledger.sources.tables import csv_profile, csv_profiles, read_csv_text, texts_of, widest
from tests.test_runs import _lines


@pytest.fixture
def small_splits(spark):
    sizes = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _field(rng):
    pieces = ["word", "Flight", "gate", ",", "\n", '"', "\n\n", "é", " ", "", "x" * 30, '""', ', "\n"']
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))


def _rows(seed, n):
    rng = random.Random(seed)
    rows = [[_field(rng) for _ in range(3)] for _ in range(n)]
    rows[n // 2][1] = "long\n" * 400  # runs over several splits
    return rows


def _text(rows, head=("who", "the, text", 'quoted "name"')):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL)
    writer.writerow(head)
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_over_many_splits(spark, tmp_path, small_splits, seed):
    rows = _rows(seed, 120)
    path = tmp_path / "a b+c.csv"
    path.write_text(_text(rows), newline="")
    records = csv_records(spark, str(path))
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() >= 8
    found = read_csv_text(spark, str(path))
    assert found.columns == ["who", "the, text", 'quoted "name"']
    assert sorted(tuple(c or "" for c in r) for r in found.collect()) == sorted(map(tuple, rows))
    # places are the order of the records
    placed = [r["record"] for r in records.orderBy("at.block", "at.number").collect()]
    assert [[tuple(x) for x in csv.reader(io.StringIO(p, newline=""))][0] for p in placed] == [tuple(r) for r in csv.reader(io.StringIO(_text(rows), newline=""))]
    assert [r["head"] for r in records.orderBy("at.block", "at.number").collect()] == [True] + [False] * 120
    assert csv_profile(found).first()["row_count"] == 120


def test_line_ends_blank_lines_and_odd_files(spark, tmp_path):
    cases = {
        "crlf.csv": (b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n', ["a", "b"], [("1", "x\r\ny"), ("2", "z")]),
        "blank.csv": (b"\n\n a,b\n\n1,2\n", [" a", "b"], [("1", "2")]),
        "bare.csv": (b"a,b\n1,2", ["a", "b"], [("1", "2")]),
        "head.csv": (b"a,b\n", ["a", "b"], []),
        "uneven.csv": (b"a,b\n1\n1,2,3\n", ["a", "b"], [("1", None), ("1", "2")]),
        "bytes.csv": (b'a,b\n"bad \xff byte",2\n', ["a", "b"], [("bad � byte", "2")]),
    }
    for name, (data, head, rows) in cases.items():
        (tmp_path / name).write_bytes(data)
        found = read_csv_text(spark, str(tmp_path / name))
        assert (name, found.columns, sorted(map(tuple, found.collect()), key=str)) == (name, head, sorted(rows, key=str))


def test_many_files_in_one_scan(spark, tmp_path):
    rng = random.Random(4)
    expected = {}
    for i in range(200):
        folder = tmp_path / f"d{i % 20}" / f"e{i}"
        folder.mkdir(parents=True)
        rows = [[_field(rng) for _ in range(1 + i % 3)] for _ in range(rng.randrange(5))]
        rows = [r for r in rows if "".join(r).strip()]
        (folder / "chat.csv").write_text(_text(rows, [f"c{k}" for k in range(1 + i % 3)]), newline="")
        expected[f"e{i}"] = ([f"c{k}" for k in range(1 + i % 3)], rows)
    records = csv_records(spark, str(tmp_path), "chat.csv")
    records.collect()
    final = records._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan text") == 2  # quotes are counted, then records are cut, whatever the number of files
    records = records.cache()
    assert widest(records) == 3
    found = {r["path"].split("/")[-2]: (r["columns"], r["row_count"]) for r in csv_profiles(records, 3).collect()}
    assert found == {k: (head, len(rows)) for k, (head, rows) in expected.items()}
    texts = texts_of(records, 3).where("row").groupBy("path").agg(F.count_if(F.lower("text").contains("flight")).alias("n")).collect()
    assert {r["path"].split("/")[-2]: r["n"] for r in texts} == {
        k: sum("flight" in " ".join(r).lower() for r in rows) for k, (_, rows) in expected.items() if rows}
    runs.inventory(spark, str(tmp_path), str(tmp_path / "report"), "now", "chat.csv", "none.csv")
    words = _lines(f"{tmp_path}/report/chat_analysis")
    assert len({r["path"] for r in words}) == 200
    assert sum(r["n"] for r in words if r["keyword"] == "flight") == sum("flight" in " ".join(r).lower() for _, rows in expected.values() for r in rows)
    counts = {r["path"].split("/")[-2]: r["total_messages"] for r in _lines(f"{tmp_path}/report/file_inventory")}
    assert counts == {k: len(rows) for k, (_, rows) in expected.items()}
