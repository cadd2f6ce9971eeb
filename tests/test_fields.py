"""Field extraction from bodies and its documented oddities."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from tripledger import vocabulary as V
from tripledger.functions import fields as X
from tripledger.functions.mail import mail_clock
from tripledger.operators import extraction as E


def one(spark, body, *columns):
    row = spark.createDataFrame([(body,)], "b string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(row) == 1 else tuple(row)


def B():
    return F.col("b")


def test_airport_vocabulary():
    assert (len(V.DOMESTIC_AIRPORTS), len(V.AIRPORTS), len(V.NOT_AIRPORTS)) == (165, 300, 167)
    assert not {"ADD", "DAY", "EAT", "SAW", "SIT", "SUN"} & set(V.AIRPORTS)


@pytest.mark.parametrize(
    "body, code",
    [
        ("Confirmation code: abc12d.", "ABC12D"), ("confirmation number is ABC123", "NUMBER"),
        ("We confirm that booking ref", "OOKING"), ("Record  Locator # QWERTY", "QWERTY"), ("nothing here", None),
        ("booking X12345", "X12345"), ("Reservation 1BCDEF", None),
    ],
)
def test_codes(spark, body, code):
    assert one(spark, body, X.confirmation_code(B())) == code


@pytest.mark.parametrize(
    "body, pair",
    [
        ("THE-SUN then SEA-SFO", ("SEA", "SFO")), ("SEA to LHR", ("SEA", "LHR")), ("SEA – SFO", ("SEA", "SFO")),
        ("depart sea, arrive sea", ("SEA", "SEA")), ("from SEA and JFK, LHR", ("SEA", "JFK")), ("ALL THE DAY", (None, None)),
        ("SEA SEA", ("SEA", None)), ("XSEA seaX", (None, None)),
    ],
)
def test_airports(spark, body, pair):
    assert tuple(one(spark, body, X.airports(B()))) == pair


def test_flight_numbers(spark):
    assert one(spark, "on B6-123 or AS 4", X.flight_number(B())) == "B6123"
    assert one(spark, "as 12, XAS 12, AS 12345", X.flight_number(B())) is None
    assert one(spark, "F9 12", X.flight_airline(X.flight_number(B()))) == "Frontier Airlines"


@pytest.mark.parametrize(
    "body, fares",
    [
        ("$ 9.99 $10 $50,000.00 $50,000.01", (10.0, 50000.0)), ("$120.50", (None, 120.5)), ("$9", (None, None)),
        ("$,,, and none", (None, None)), ("", (None, None)),
    ],
)
def test_fares(spark, body, fares):
    amounts = X.fare_amounts(B())
    assert one(spark, body, X.base_fare(amounts), X.total_paid(amounts)) == fares


def _dates(spark, body, mail):
    got = one(spark, body, X.upcoming_first(X.body_dates(B()), mail_clock(F.lit(mail))))
    return [d.isoformat() for d in got]


def test_date_patterns_and_order(spark):
    body = "2024-03-01, 13/45/2024, 3/5/2024, Mar 3 2024, 4 march 2024, 2024-02-30, 1999-01-01, 2031-01-01, 2024-03-01"
    assert _dates(spark, body, "") == ["2024-03-03", "2024-03-05", "2024-03-01", "2024-03-04"]
    assert _dates(spark, body, "4 Mar 2024 09:00:00 +0000") == ["2024-03-04", "2024-03-05", "2024-03-01", "2024-03-03"]


@pytest.mark.parametrize("zone, first", [("-0700", "2024-03-05"), ("+0000", "2024-03-04"), ("+0900", "2024-03-04")])
def test_west_of_utc_the_mails_own_day_is_past(spark, zone, first):
    assert _dates(spark, "2024-03-04 2024-03-05", f"4 Mar 2024 09:00:00 {zone}")[0] == first


def test_confidence_is_a_double_sum_in_order(spark):
    names = ("code", "origin", "dest", "airline", "number", "fare", "body")
    cases = list(itertools.product([False, True], repeat=7))
    df = spark.createDataFrame(cases, ", ".join(f"{n} boolean" for n in names))
    value = lambda n: F.when(F.col(n), F.lit(1))
    score = X.confidence(*[value(n) for n in names[:-1]], F.col("body"))
    for row in df.select(*names, score.alias("s")).collect():
        total = 0.0
        total += 0.3 if row["code"] else 0.0
        total += 0.2 if row["origin"] and row["dest"] else 0.1 if row["origin"] or row["dest"] else 0.0
        for name, weight in (("airline", 0.2), ("number", 0.15), ("fare", 0.1), ("body", 0.05)):
            total += weight if row[name] else 0.0
        assert row["s"] == min(total, 1.0)


def test_international(spark):
    cases = {("SEA", "LHR"): True, ("SEA", "SFO"): False, ("SEA", None): False, (None, "CDG"): True, (None, None): False, ("", "SEA"): False}
    df = spark.createDataFrame(list(cases), "o string, d string")
    assert {(r[0], r[1]): r[2] for r in df.select("o", "d", X.is_international(F.col("o"), F.col("d"))).collect()} == cases


MAIL = "msg_id long, source_file string, from_hdr string, subject string, date_hdr string, body string"


def test_return_leg_and_fallback_date(spark):
    rows = [
        (1, "a.mbox", "x@kayak.com", "trip", "1 Mar 2024 23:30:00 -0700", "SEA-SFO on 2024-03-05 and 2024-03-09, $80 passenger"),
        (2, "a.mbox", "x@delta.com", "trip", "1 Mar 2024 23:30:00 -0700", "SEA-SFO, no dates in here at all"),
        (3, "a.mbox", "x@kayak.com", "trip", "", "nothing that looks like a booking"),
        (4, "a.mbox", "x@kayak.com", "trip", "", "only a fare of $50.00 in this mail"),
        (5, "a.mbox", "x@kayak.com", "trip", "", "only a fare of $50.01 in this mail"),
    ]
    df = spark.createDataFrame(rows, MAIL)
    found = {(r["msg_id"], r["leg"]): r for r in E.extract(df, "now", keep=["msg_id", "leg"]).collect()}
    assert set(found) == {(1, 0), (1, 1), (2, 0), (5, 0)}
    out, back, late = found[1, 0], found[1, 1], found[2, 0]
    assert (out["origin"], out["dest"], out["date_iso"]) == ("SEA", "SFO", "2024-03-05T00:00:00Z")
    assert (back["origin"], back["dest"], back["trip_city"], back["date_iso"]) == ("SFO", "SEA", "SEA", "2024-03-09T00:00:00Z")
    assert out["flight_id"] != back["flight_id"] and back["total_paid"] == 80.0
    assert (late["date_iso"], late["source_email_date"]) == ("2024-03-01T23:30:00Z", "2024-03-01T23:30:00-07:00")
    assert found[5, 0]["date_iso"] == "" and found[5, 0]["source_year"] == ""


def test_layout_and_keep_best(spark):
    rows = [
        (i, "a.mbox", "x@delta.com", "trip", "", "SEA-SFO on 2024-03-05" + extra)
        for i, extra in enumerate(["   ", ", AS 12", ", AS 12", ", no more"])
    ]
    best = E.candidates(spark.createDataFrame(rows, MAIL), "now", "msg_id")
    assert [(f.name, f.dataType) for f in best.schema] == [(f.name, f.dataType) for f in E.CANDIDATE_SCHEMA]
    assert len(best.columns) == 29
    (row,) = best.collect()
    assert row["flight_number"] == "AS12" and row["created_at"] == "now"


@pytest.mark.parametrize("column", E.CANDIDATE_SCHEMA.names)
def test_each_column_can_be_read_alone(spark, column):
    rows = [(1, "a.mbox", "x@kayak.com", "trip", "", "SEA-SFO on 2024-03-05 and 2024-03-09")]
    assert len(E.extract(spark.createDataFrame(rows, MAIL), "now").select(column).collect()) == 2


def test_empty_statistics(spark):
    none = spark.createDataFrame([], E.CANDIDATE_SCHEMA)
    assert {r["share"] for r in E.field_completeness(none).collect()} == {"0%"}
    assert tuple(E.confidence_buckets(none).first()) == (0, 0, 0)


def test_bucket_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.7, 0.6999, 0.4, 0.2 + 0.15 + 0.05)], "extraction_confidence double")
    assert tuple(E.confidence_buckets(df).first()) == (1, 2, 1)


def test_body_dates_are_dates(spark):
    assert one(spark, "2024-02-29", X.body_dates(B())) == [datetime.date(2024, 2, 29)]
