"""The match rules against a plain row-by-row statement of them, and hot groups."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tripledger.functions import normalize as N
from tripledger.operators import reconcile as R

SIDE = "flight_id string, date_iso string, origin string, dest string, airline string, confirmation_code string"


def _norm(row):
    fid, date, origin, dest, line, code = ((v or "").strip() for v in row)
    date = date[:10] if len(date) >= 10 and date[4] == date[7] == "-" else ""
    try:
        day = datetime.date.fromisoformat(date)
    except ValueError:
        day = None
    return fid, date, day, origin.upper(), dest.upper(), line.lower(), code.upper()


def brute(candidate, register):
    """(status, ids, reason, confidence) of one candidate."""
    _, date, day, o, d, line, code = _norm(candidate)
    rows = [_norm(r) for r in register]
    same_code = [r for r in rows if code and r[6] == code]
    if same_code:
        fid, rdate, _, ro, rd, _, _ = same_code[-1]
        pairs = (("origin", o, ro), ("dest", d, rd), ("date", date, rdate))
        diffs = "; ".join(f"{n}: {a} vs {b}" for n, a, b in pairs if a and b and a != b)
        if diffs:
            return "conflict", [fid], f"confirmation_code match ({code}) but fields differ: {diffs}", "high"
        return "exact_duplicate", [fid], f"confirmation_code exact match ({code})", "high"
    full = date and o and d and line
    hits = [r[0] for r in rows if full and (r[1], r[3], r[4], r[5]) == (date, o, d, line)]
    if hits:
        return "exact_duplicate", hits, "date+origin+dest+airline match", "high"
    near = lambda r: day and r[2] and abs((day - r[2]).days) == 1
    hits = [r for r in rows if o and d and (r[3], r[4]) == (o, d) and near(r)]
    if hits:
        why = f"same route {o}-{d} +/-1 day (candidate: {date}, existing: {len(hits)} rows)"
        return "near_match", [r[0] for r in hits], why, "medium"
    if not (o and d) and line:
        note = " [candidate missing origin/dest"
        hits = [r for r in rows if date and r[5] == line and r[1] == date]
        if hits:
            return "near_match", [r[0] for r in hits], f"date+airline match ({date}, {line}){note}]", "low"
        hits = [r for r in rows if r[5] == line and near(r)]
        if hits:
            return "near_match", [r[0] for r in hits], f"date+airline near match ({date}, {line}){note}, +/-1 day]", "low"
    return "net_new", [], "", "high" if o and d and date else "medium" if date else "low"


def _rows(rng, prefix, n):
    days = ["2024-02-28", "2024-02-29", "2024-03-01T00:00:00Z", "2024-03-02", "2024-13-01", "", None, " 2024-03-01 "]
    pick = lambda *values: rng.choice(values)
    return [
        (f"{prefix}{i:03d}", pick(*days), pick("SEA", " sfo", "", None, "JFK"), pick("SEA", "SFO ", "", "LHR"),
         pick("Delta", "DELTA ", "United", "", None), pick("", "", "", None, "abc123", "ABC123", "q1", "Q2"))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    existing, new = _rows(rng, "R", 60), _rows(rng, "C", 120)
    order = list(range(len(existing)))
    rng.shuffle(order)
    register = spark.createDataFrame(
        [(*existing[i], i) for i in order], SIDE + ", ord long"
    )
    candidates = spark.createDataFrame(new, SIDE)
    got = R.classify(candidates, register).collect()
    members = {}
    for m in R.match_members(candidates, register).collect():
        members.setdefault(m["match_group"], []).append(m["flight_id"])
    found = {}
    for r in got:
        ids = sorted(members[r["match_group"]]) if r["match_group"] else []
        assert r["match_count"] == len(ids)
        found[r["flight_id"]] = (r["dedup_status"], ids, r["match_reason"], r["confidence"])
    assert len(got) == len(new) and set(members) == {r["match_group"] for r in got} - {""}
    assert found == {c[0]: (s, sorted(ids), why, level) for c in new for s, ids, why, level in [brute(c, existing)]}
    assert {s[0] for s in found.values()} == set(R.STATUSES)


def test_repeated_candidates_keep_their_rows(spark):
    row = ("C1", "2024-03-01", "SEA", "SFO", "Delta", "")
    register = spark.createDataFrame([("R1", "2024-03-01", "SEA", "SFO", "delta", "", 0)], SIDE + ", ord long")
    got = R.classify(spark.createDataFrame([row] * 50, SIDE), register).collect()
    assert len(got) == 50 and {(r["match_group"], r["match_count"]) for r in got} == {('["2","2024-03-01","SEA","SFO","delta"]', 1)}


def test_hot_group_is_complete(spark):
    """100,000 register rows share one airline and day; nothing of it is lost or collected."""
    n = 100_000
    blank = F.lit("")
    hot = spark.range(n).select(
        F.concat(F.lit("H"), "id").alias("flight_id"), F.lit("2024-03-01").alias("date_iso"), F.lit("SEA").alias("origin"), F.lit("SFO").alias("dest"),
        F.lit("Delta").alias("airline"), blank.alias("confirmation_code"), F.col("id").alias("ord"))
    new = spark.createDataFrame([("A", "2024-03-01", "", "SFO", "delta", ""), ("B", "2024-03-02", "", "SFO", "delta", "")], SIDE)
    found = {r["flight_id"]: r for r in R.classify(new, hot).collect()}
    members = R.match_members(new, hot)
    for name in ("A", "B"):
        assert (found[name]["dedup_status"], found[name]["confidence"], found[name]["match_count"]) == ("near_match", "low", n)
        own = members.where(F.col("match_group") == found[name]["match_group"])
        assert own.select("flight_id").distinct().count() == n
    plan = R.classify(new, hot)._jdf.queryExecution().executedPlan().toString() + members._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_empty_sides(spark):
    empty = spark.createDataFrame([], SIDE + ", ord long")
    one = spark.createDataFrame([("C1", "2024-03-01", "SEA", "SFO", "Delta", "X")], SIDE)
    assert R.classify(one, empty).first()["dedup_status"] == "net_new"
    none = R.classify(one.where("false"), empty)
    assert {(r["n"], r["percent"]) for r in R.status_counts(none).collect()} == {(0, 0.0)}
    assert {r["n"] for r in R.net_new_breakdown(none).collect()} == {0}


@pytest.mark.parametrize(
    "text, key",
    [
        ("2024-03-17T00:00:00Z", "2024-03-17"), (" 2024-99-99 ", "2024-99-99"), ("20240317", "2024-03-17"),
        ("3/7/2024", "2024-03-07"), ("7 Mar 2024", "2024-03-07"), ("March 7, 2024", "2024-03-07"), ("soon", ""), ("", ""), (None, ""),
    ],
)
def test_date_keys(spark, text, key):
    df = spark.createDataFrame([(text,)], "t string").select(N.date_key(F.col("t")).alias("k"))
    row = df.withColumn("d", N.day_of(F.col("k"))).first()
    assert row["k"] == key
    assert (row["d"] is None) == (key in ("", "2024-99-99"))
