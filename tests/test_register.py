"""Seeding, search, change sets against a sequential replay, and the stream."""

import datetime
import decimal
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tripledger import vocabulary as V
from tripledger.operators import register as G
from tripledger.operators.keep import row_index
from tripledger.streaming import changes as S

LOG = "ord long, op string, flight_id string, fields map<string,string>, at string"
NAMES = G.REGISTER_SCHEMA.names


def _register(spark, n=6):
    rows = []
    for i in range(n):
        row = dict.fromkeys(NAMES)
        row.update(
            flight_id=f"R{i}", date_iso=f"2024-0{1 + i % 3}-01T00:00:00Z", origin="SEA", dest=("SFO", "LHR")[i % 2],
            status=("active", "cancelled")[i == 5], created_at="t0", updated_at="t0", airline=("A", "B")[i % 2],
            international=i % 2 == 1, total_paid=decimal.Decimal(i * 10), trip_city="x",
        )
        rows.append(tuple(row[c] for c in NAMES))
    return spark.createDataFrame(rows, G.REGISTER_SCHEMA)


def replay(register, log):
    """The changes one by one, as a service would do them."""
    rows = {r["flight_id"]: r.asDict() for r in register.collect()}
    rejects = []
    for ord_, op, fid, fields, at in sorted(log, key=lambda r: r[0]):
        fields = fields or {}

        def no(code, key=fid):
            rejects.append((ord_, op, key or "", code))

        if op == "create":
            if any(not fields.get(f) for f in ("date", "origin", "dest")):
                no("missing_param", "")
                continue
            try:
                day = datetime.datetime.fromisoformat(fields["date"].replace("Z", "+00:00"))
            except ValueError:
                no("invalid_date", "")
                continue
            iso = day.strftime("%Y-%m-%dT%H:%M:%SZ")
            key = hashlib.sha256("|".join((iso, fields["origin"], fields["dest"], fields.get("sequence", "0"), "0")).encode())
            key = key.hexdigest()[:12]
            if key in rows:
                no("duplicate", key)
                continue
            row = dict.fromkeys(NAMES)
            row.update(flight_id=key, date_iso=iso, date_yyyy_mm=iso[:7], origin=fields["origin"].upper(),
                       dest=fields["dest"].upper(), status="active", created_at=at, updated_at=at)
            for f in G.OPTIONAL_FIELDS:
                if fields.get(f) is not None:
                    number = f in G._NUMBERS
                    row[f] = decimal.Decimal(fields[f]).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP) if number else fields[f]
            rows[key] = row
        elif not fid:
            no("missing_param")
        elif op == "update" and not fields:
            no("no_updates")
        elif op == "update" and set(fields) & set(V.IMMUTABLE_FIELDS):
            no("immutable_field")
        elif op == "update" and set(fields) - set(V.MUTABLE_FIELDS):
            no("unknown_field")
        elif fid not in rows:
            no("not_found")
        elif op == "update":
            for f, v in fields.items():
                number = f in ("base_fare", "extra_fees", "total_paid")
                rows[fid][f] = decimal.Decimal(v).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP) if number and v is not None else v
            rows[fid]["updated_at"] = at
        elif rows[fid]["status"] != "cancelled":
            rows[fid].update(status="cancelled", cancelled_at=at, updated_at=at)
    return rows, sorted(rejects)


def _random_log(seed, n=150):
    rng = random.Random(seed)
    created = [
        hashlib.sha256(f"2024-0{m}-02T00:00:00Z|{o}|sfo|0|0".encode()).hexdigest()[:12] for m in (1, 2) for o in ("sea", "jfk")
    ]
    log = []
    for i in range(n):
        op = rng.choice(["create", "update", "update", "cancel"])
        fid = rng.choice([*(f"R{k}" for k in range(7)), *created, *created, "", None])
        if op == "create":
            fields = {"date": rng.choice(["2024-01-02", "2024-02-02T00:00:00Z", "soon", ""]), "origin": rng.choice(["sea", "jfk", ""]),
                      "dest": "sfo", "total_paid": "12.345", "airline": f"x{i}"}
            fid = None
        elif op == "update":
            fields = rng.choice([{"website": f"w{i}"}, {"total_paid": f"{i}.5", "trip_city": f"c{i}"}, {"status": "x", "airline": "y"},
                                 {"airline": "y"}, {}, {"trip_city": None}])
        else:
            fields = None
        log.append((i, op, fid, fields, f"t{i:04d}"))
    return log


def _as_dict(df):
    return {r["flight_id"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_change_set_equals_replay(spark, seed):
    base, log = _register(spark), _random_log(seed)
    out = G.apply_changes(base, spark.createDataFrame(log, LOG).repartition(4))
    rows, rejects = replay(base, log)
    assert _as_dict(G.merge(base, out.changed)) == rows
    assert sorted((r["ord"], r["op"], r["flight_id"], r["code"]) for r in out.rejects.collect()) == rejects


def test_immutable_columns_never_change(spark):
    base = _register(spark)
    out = G.update(base, spark.createDataFrame(_random_log(6), LOG))
    before = _as_dict(base)
    for fid, row in _as_dict(out.changed).items():
        assert all(row[c] == before[fid][c] for c in V.IMMUTABLE_FIELDS if c in NAMES)


def test_reject_messages(spark):
    log = [
        (1, "create", None, {"dest": "SFO"}, "t"), (2, "update", "R1", {"status": "x", "dest": "y"}, "t"),
        (3, "update", "R1", {"zz": "x", "airline": "y"}, "t"), (4, "update", "R1", {"base_fare": "much"}, "t"),
    ]
    found = {r["ord"]: r["message"] for r in G.apply_changes(_register(spark), spark.createDataFrame(log, LOG)).rejects.collect()}
    assert found[1] == "Required field(s) missing: date, origin"
    assert found[2] == "Cannot modify immutable field(s): dest, status"
    assert found[3].startswith("Unknown field(s): airline, zz. Mutable fields: base_fare, booked_class,")
    assert found[4] == "Invalid number in field(s): base_fare"


def test_cancelling_twice_equals_once(spark):
    base = _register(spark)
    ids = spark.createDataFrame([("R1",), ("R1",), ("R5",), ("R9",)], "flight_id string")
    once = G.cancel(base, ids, "t1")
    assert set(_as_dict(once.changed)) == {"R1"}
    assert [r["code"] for r in once.rejects.collect()] == ["not_found"]
    again = G.cancel(G.merge(base, once.changed), ids, "t2")
    assert again.changed.count() == 0


def test_stream_equals_batch_and_survives_a_replayed_batch(spark, tmp_path):
    base, log = _register(spark), _random_log(7)
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for part in range(3):
        piece = spark.createDataFrame(log[part * 50 : part * 50 + 50], LOG).coalesce(1)
        piece.write.mode("append").parquet(source)
    S.start_store(base, store)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
    S.apply_change_stream(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    rows, rejects = replay(base, log)
    assert _as_dict(S.current_register(spark, store)) == rows
    refused = S.rejected_changes(spark, store)
    assert sorted((r["ord"], r["op"], r["flight_id"], r["code"]) for r in refused.collect()) == rejects
    S.apply_batch(spark.createDataFrame(log[100:], LOG), 2, store)
    assert _as_dict(S.current_register(spark, store)) == rows


def test_row_index_over_blocks(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aab"), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, ord long").repartition(5)
    found = {(r["k"], r["ord"]): r["n"] for r in row_index(df, ["k"], "ord", "n", block=16).collect()}
    seen, expected = {}, {}
    for k, i in rows:
        expected[k, i] = seen.setdefault(k, 0)
        seen[k] += 1
    assert found == expected


def test_seed_types_and_ids(spark):
    when = datetime.datetime(2024, 3, 5, 7, 8, 9)
    rows = [(0, when, "SEA", "SFO", 1.0, 2.675, True, when, 3, None), (1, when, "SEA", "SFO", 1.0, float("nan"), None, None, None, "old"),
            (2, None, None, "SFO", None, 1.0, False, None, 4, None)]
    df = spark.createDataFrame(
        rows, "ord long, date timestamp_ntz, origin string, dest string, sequence double, fare double, flag boolean, "
        "seen timestamp_ntz, n int, status string").withColumn("discount_1", F.lit(None).cast("double"))
    out = G.seed_transform(df, "ord", "now")
    found = {r["flight_id"]: r for r in out.collect()}
    key = lambda text: hashlib.sha256(text.encode()).hexdigest()[:12]
    a, b, c = (key("2024-03-05T07:08:09Z|SEA|SFO|1.0|0"), key("2024-03-05T07:08:09Z|SEA|SFO|1.0|1"), key("||SFO|0|0"))
    assert set(found) == {a, b, c} and "discount_1" not in out.columns and "date" not in out.columns
    assert found[a]["fare"] == decimal.Decimal("2.68") and found[a]["seen"] == "2024-03-05T07:08:09Z"
    assert found[b]["fare"] is None and found[b]["status"] == "old" and found[a]["status"] == "active"
    assert found[c]["date_iso"] == "" and dict(out.dtypes)["n"] == "int"


def test_search_pages(spark):
    base = _register(spark, 6)
    everything = G.search(base, limit=2)
    pages, cursor = [], None
    while True:
        page = G.search(base, limit=2, cursor=cursor)
        pages += [r["flight_id"] for r in page.collect()]
        cursor = G.next_cursor(page, 2)
        if cursor is None:
            break
    assert pages == [f"R{i}" for i in range(6)] and everything.columns == list(G.SUMMARY)
    assert [r["flight_id"] for r in G.search(base, international=False).collect()] == ["R0", "R2", "R4"]
    assert [r["flight_id"] for r in G.search(base, date_to="2024-01-01").collect()] == []
    assert [r["flight_id"] for r in G.search(base, dest="LHR", date_from="2024-02-01", airline=None).collect()] == ["R1", "R5"]
    with pytest.raises(TypeError):
        G.search(base, colour="red")


def test_upsert_and_check(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "flight_id string, v int")
    late = spark.createDataFrame([(1, "b", 3), (2, "b", 4), (0, "c", 5)], "ord long, flight_id string, v int")
    out = G.upsert(base, late, "ord")
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 4), ("c", 5)]
    assert tuple(G.load_check(out, base).first()) == (2, 3, False)
