"""The change store: buckets that follow the data, batches that are seen whole or not at all."""

import decimal

import pytest
from pyspark.sql import functions as F

from tests.test_register import LOG, NAMES, _as_dict, _random_log, _register, replay
from tripledger.operators import register as G
from tripledger.streaming import changes as S


def _rows(spark, n):
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in G.REGISTER_SCHEMA.fields if f.name not in ("flight_id", "status", "total_paid")]
    rows = spark.range(n).select(
        F.concat(F.lit("R"), F.col("id").cast("string")).alias("flight_id"), F.lit("active").alias("status"),
        F.col("id").cast("decimal(12,2)").alias("total_paid"), *blank)
    return rows.select(*NAMES)


def _updates(spark, keys, first=0):
    rows = [(first + i, "update", k, {"total_paid": f"{i}.5"}, f"t{i}") for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, LOG)


def test_larger_stores_have_more_buckets_and_a_batch_reads_only_its_own(spark, tmp_path):
    buckets = {}
    for n in (300, 3000):
        store = str(tmp_path / f"s{n}")
        S.start_store(_rows(spark, n), store, bucket_rows=200)
        directory = S.read_directory(spark, store)
        buckets[n] = len(directory.rows)
        assert sum(directory.rows.values()) == n and max(directory.rows.values()) <= 200
    assert buckets[3000] >= 8 * buckets[300] / 2 > buckets[300]
    label = S.bucket_of(directory.rows)
    (touched,) = {r[0] for r in spark.createDataFrame([("R7",)], "flight_id string").select(label).collect()}
    images = S.stored_images(spark, store, directory, [touched])
    assert images.inputFiles() and all(f"bucket={touched}/" in f for f in images.inputFiles())
    assert images.count() == directory.rows[touched] < 3000 / 10
    S.apply_batch(_updates(spark, ["R7"]), 0, store)
    after = S.read_directory(spark, store)
    assert {k for k in after.rows if after.folders[k] != directory.folders[k]} == {touched}
    assert after.rows[touched] == directory.rows[touched] + 1
    assert _as_dict(S.current_register(spark, store).where("flight_id in ('R7', 'R8')")) == {
        "R7": dict.fromkeys(NAMES) | {"flight_id": "R7", "status": "active", "total_paid": decimal.Decimal("0.50"), "updated_at": "t0"},
        "R8": dict.fromkeys(NAMES) | {"flight_id": "R8", "status": "active", "total_paid": decimal.Decimal("8.00")},
    }


def test_full_buckets_are_folded_and_split(spark, tmp_path):
    store = str(tmp_path / "s")
    S.start_store(_rows(spark, 60), store, bucket_rows=100)
    assert len(S.read_directory(spark, store).rows) == 2
    for number in range(3):  # images pile up and are folded, the number of keys stays
        S.apply_batch(_updates(spark, [f"R{i}" for i in range(60)], 100 * number), number, store)
    folded = S.read_directory(spark, store)
    assert sum(folded.rows.values()) < 4 * 60 and len(folded.rows) <= 4
    assert S.current_register(spark, store).count() == 60
    made = [(1000 + i, "create", None, {"date": "2024-01-02", "origin": f"o{i}", "dest": "x"}, "t") for i in range(600)]
    S.apply_batch(spark.createDataFrame(made, LOG), 3, store)
    split = S.read_directory(spark, store)
    assert len(split.rows) >= 8 and max(split.rows.values()) <= 100 and sum(split.rows.values()) >= 660
    assert S.current_register(spark, store).select("flight_id").distinct().count() == S.current_register(spark, store).count() == 660
    labels = sorted(split.rows)  # every hash has exactly one bucket
    assert sum(2.0 ** (1 - len(k)) for k in labels) == 1
    S.apply_batch(_updates(spark, ["R3", "R59", "R60"], 5000), 4, store)
    assert {r["flight_id"] for r in S.rejected_changes(spark, store).collect()} == {"R60"}
    assert S.compact(spark, store, str(tmp_path / "t")) and S.current_register(spark, str(tmp_path / "t")).count() == 660


def test_batches_are_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    base, log = _register(spark), _random_log(9)
    store = str(tmp_path / "s")
    S.start_store(base, store)
    first, second = (spark.createDataFrame(log[a:b], LOG) for a, b in ((0, 75), (75, 150)))
    S.apply_batch(first, 0, store)
    old = _as_dict(S.current_register(spark, store))
    refused = S.rejected_changes(spark, store).count()

    def stop(*_):
        raise RuntimeError("stopped between the writes")

    with monkeypatch.context() as broken:
        broken.setattr(S, "_commit", stop)  # rows and rejects are written, the directory is not
        with pytest.raises(RuntimeError):
            S.apply_batch(second, 1, store)
    assert (tmp_path / "s" / "data" / "batch=1").exists() and (tmp_path / "s" / "rejects" / "batch=1").exists()
    assert _as_dict(S.current_register(spark, store)) == old and S.rejected_changes(spark, store).count() == refused
    S.apply_batch(second, 1, store)
    rows, rejects = replay(base, log)
    assert _as_dict(S.current_register(spark, store)) == rows
    assert sorted((r["ord"], r["op"], r["flight_id"], r["code"]) for r in S.rejected_changes(spark, store).collect()) == rejects
    S.apply_batch(first, 1, store)  # was committed: nothing happens, whatever comes
    assert _as_dict(S.current_register(spark, store)) == rows


def test_empty_store_takes_rows(spark, tmp_path):
    store = str(tmp_path / "s")
    S.start_store(_rows(spark, 0), store)
    assert S.read_directory(spark, store).rows == {"b": 0} and S.current_register(spark, store).isEmpty() and S.rejected_changes(spark, store).isEmpty()
    S.apply_batch(spark.createDataFrame([(1, "create", None, {"date": "2024-01-02", "origin": "a", "dest": "b"}, "t")], LOG), 0, store)
    assert S.current_register(spark, store).count() == 1


def test_repeated_deliveries_are_dropped(spark, tmp_path):
    log = "ord long, op string, flight_id string, fields map<string,string>, at string, ts timestamp"
    sent = spark.range(40).select(
        F.col("id").alias("ord"), F.lit("update").alias("op"), F.concat(F.lit("R"), (F.col("id") % 5).cast("string")).alias("flight_id"),
        F.create_map(F.lit("website"), F.col("id").cast("string")).alias("fields"), F.col("id").cast("string").alias("at"),
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"))
    source, store = str(tmp_path / "in"), str(tmp_path / "s")
    S.start_store(_rows(spark, 5), store)
    for part in range(2):  # the second delivery repeats the last half hour of the first
        sent.where(F.col("ord").between(0, 29) if part == 0 else F.col("ord") >= 10).write.mode("append").parquet(source)
        stream = S.delivered_once(spark.readStream.schema(log).parquet(source), "ord", "ts", "1 hour")
        S.apply_change_stream(stream, store, str(tmp_path / "c")).awaitTermination()
    found = S.current_register(spark, store)
    assert {r["flight_id"]: r["website"] for r in found.collect()} == {f"R{i}": str(35 + i) for i in range(5)}
    assert S.read_directory(spark, store).rows["b"] == 5 + 5 + 5  # one image per row and batch
