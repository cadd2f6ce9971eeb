"""Views of the driver tables in the shape of mails, bookings and change logs.

The formulas are in FIXTURES.md; ``plans.oracle`` states the same ones in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions.fields import clock_text, day_text
from tripledger.functions.text import word_array

AS_OF = "2024-06-01T00:00:00Z"
PLACES = ("SEA", "SFO", "JFK", "LHR", "ANC", "DEN", "NRT", "BOS", "YVR", "MIA", "CDG", "ORD")
SENDERS = (
    "Alpha <no-reply@ifly.alaskaair.com>", '"x@y.com via" <r@delta.com>', "trips@expedia.com",
    "Deals <d@mail.kayak.com>", "News <n@naacp.org>", "friend@example.org", "alerts@google.com", "no at sign",
)
SUBJECTS = (
    "Your itinerary", "Booking confirmation - Delta", "hello again", "Team standup notes", "Boarding pass ready",
)
MONTHS = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
    "December",
)
WORK_TAIL = "sprint standup jira meeting team deploy roadmap confluence"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that are at most dealt together, so that what a task holds does not grow with the input.
DEALT_ROWS = 200_000


def _dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out to all cores, in as many parts as their number asks for: what follows is costly per row,
    whatever the splits of the input. They are counted from the file footers."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT_ROWS)))


def _div(key: Column, by: int) -> Column:
    """Whole-number division."""
    return F.call_function("div", key, F.lit(by).cast("long"))


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(word_array(values), index.cast("int"))


def _places(user: Column, key: Column) -> tuple[Column, Column]:
    spot = user % 12
    return _pick(PLACES, spot), _pick(PLACES, (spot + 1 + key % 11) % 12)


def _hex_code(key: Column) -> Column:
    return F.format_string("Q%05X", key)


def _plus(day: Column, days: Column) -> Column:
    return F.date_add(day, days.cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mail per order."""
    orders = _dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    k, u, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    third, half = _div(k, 3), _div(k, 2)
    later = (half % 2) * 1826
    start, end = _places(u, k)
    sent = _plus(d, later)
    flight = _plus(d, later + k % 4 - 1)
    back = _plus(flight, F.lit(7))
    month = lambda day: _pick(MONTHS, F.month(day) - 1)
    num = lambda c: c.cast("string")
    slashed = lambda day: F.concat_ws("/", num(F.month(day)), num(F.day(day)), num(F.year(day)))

    date_hdr = (
        F.when(k % 7 == 0, "")
        .when(k % 7 == 1, "not a date")
        .otherwise(
            F.concat(
                num(F.day(sent)), F.lit(" "), F.left(month(sent), F.lit(3)), F.lit(" "), num(F.year(sent)),
                F.lit(" 08:00:00 "), _pick(("-0700", "+0000", "+0900"), third % 3),
            )
        )
    )
    choose = lambda index, *options: F.coalesce(*[F.when(index == i, o) for i, o in enumerate(options)])
    code = choose(
        k % 4, F.concat(F.lit("Confirmation code: "), _hex_code(k)), F.lit("Your confirmation number is ABC123"),
        F.lit("We confirm that booking ref"), F.lit("Note"),
    )
    airports = choose(
        _div(k, 4) % 4, F.concat(start, F.lit("-"), end),
        F.concat(F.lit("Depart "), start, F.lit(" arrive "), end),
        F.concat(F.lit("Airports "), start, F.lit(" then "), end, F.lit(" THE SUN")), F.lit("ALL THE DAY"),
    )
    number = F.when(_div(k, 16) % 2 == 0, F.concat(F.lit("Flight AS "), num(k % 2000))).otherwise("No number")
    fare = choose(
        F.least(k % 6, F.lit(3)), F.lit("No fare"), F.lit("$ 9.50"), F.lit("$120.50"), F.lit("$1,234.50 and $99")
    )
    iso = lambda day: day.cast("string")
    dates = choose(
        _div(k, 5) % 5,
        F.concat(F.lit("on "), month(flight), F.lit(" "), num(F.day(flight)), F.lit(", "), num(F.year(flight))),
        F.concat(F.lit("on "), slashed(flight), F.lit(" back "), slashed(back)),
        F.concat(iso(flight), F.lit(" and "), iso(back)),
        F.concat(
            num(F.day(flight)), F.lit(" "), F.left(month(flight), F.lit(3)), F.lit(" "), num(F.year(flight)),
            F.lit(", not 13/45/2024"),
        ),
        F.lit("no date"),
    )
    tail = F.when(k % 9 == 0, WORK_TAIL).otherwise("seat and passenger details")
    return orders.select(
        k.alias("msg_id"),
        F.concat(F.lit("box"), num(k % 3), F.lit(".mbox")).alias("source_file"),
        _pick(SENDERS, k % 8).alias("from_hdr"),
        _pick(SUBJECTS, k % 5).alias("subject"),
        date_hdr.alias("date_hdr"),
        F.concat_ws(". ", code, airports, number, fare, dates, tail).alias("body"),
    )


def _booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the segment of their customer; the join is left to the optimiser."""
    orders = _dealt(table(spark, sf_dir, "orders"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey, "left")


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One register row per order, in the full register layout plus ``ord``."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    start, end = _places(u, k)
    iso = day_text(F.col("o_orderdate").cast("date"))
    code = F.when(_div(k, 2) % 2 == 0, _hex_code(F.when(k % 28 == 0, k + 4).otherwise(k))).otherwise("")
    none = F.lit(None)
    return _booked(spark, sf_dir).select(
        k.alias("ord"),
        F.concat(F.lit("R"), k.cast("string")).alias("flight_id"),
        iso.alias("date_iso"),
        iso.substr(1, 7).alias("date_yyyy_mm"),
        start.alias("origin"),
        end.alias("dest"),
        F.when(F.col("o_orderstatus") == "P", "cancelled").otherwise("active").alias("status"),
        F.lit(AS_OF).alias("created_at"),
        F.lit(AS_OF).alias("updated_at"),
        F.col("o_orderstatus").alias("cost_type"),
        end.alias("trip_city"),
        F.col("c_mktsegment").alias("airline"),
        F.col("o_orderpriority").alias("booked_class"),
        none.cast("string").alias("funding_source"),
        code.alias("confirmation_code"),
        none.cast("string").alias("flight_number"),
        none.cast("string").alias("website"),
        none.cast("string").alias("cancelled_at"),
        (k % 2 == 0).alias("international"),
        none.cast("decimal(12,2)").alias("eqm_miles"),
        none.cast("decimal(12,2)").alias("base_fare"),
        none.cast("decimal(12,2)").alias("extra_fees"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total_paid"),
        none.cast("decimal(12,2)").alias("sequence"),
    )


def booking_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows turned into candidates, one change per kind ``v``."""
    k, v = F.col("ord"), F.col("ord") % 10
    day = F.substring("date_iso", 1, 10).cast("date")
    shift = F.when(v == 3, 1).when(v == 5, -1).when(v == 6, 4000).otherwise(0)
    date_iso = F.when(v == 7, "").otherwise(day_text(F.date_add(day, shift)))
    return register(spark, sf_dir).select(
        F.concat(F.lit("C"), k.cast("string")).alias("flight_id"),
        date_iso.alias("date_iso"),
        F.when(v.isin(4, 5), "").otherwise(F.lower("origin")).alias("origin"),
        F.when(v == 1, "ZZZ").when(v == 9, "").otherwise(F.concat(F.lit(" "), F.col("dest"))).alias("dest"),
        F.when(v.isin(8, 9), "").otherwise(F.upper("airline")).alias("airline"),
        F.when(v.isin(0, 1), F.col("confirmation_code")).otherwise("").alias("confirmation_code"),
    )


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a seed file holds them: date, route, sequence and three unused columns."""
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    start, end = _places(u, k)
    return _booked(spark, sf_dir).select(
        k.alias("ord"),
        F.when(k % 17 != 0, F.col("o_orderdate")).alias("date"),
        start.alias("origin"),
        end.alias("dest"),
        F.when(k % 3 != 0, (k % 3).cast("double")).alias("sequence"),
        F.col("c_mktsegment").alias("airline"),
        (k % 2 == 0).alias("international"),
        F.col("o_totalprice").alias("total_paid"),
        F.col("o_orderdate").alias("booked_on"),
        F.lit(None).cast("double").alias("discount_1"),
        F.lit(None).cast("double").alias("discount_2"),
        F.lit(None).cast("string").alias("discount_source"),
    )


def change_rows(events: DataFrame) -> DataFrame:
    """A change log from the event stream; works on a batch and on a stream."""
    e, user = F.col("event_id"), F.col("user_id")
    day = F.col("ts").cast("date").cast("string")
    start, end = _pick(PLACES, user % 12), _pick(PLACES, (user + 1) % 12)
    created = F.left(
        F.sha2(F.concat_ws("|", F.concat(day, F.lit("T00:00:00Z")), start, end, F.lit("0"), F.lit("0")), 256), F.lit(12)
    )
    key = (
        F.when(e % 11 == 0, "R999999999")
        .when(e % 7 == 0, created)
        .otherwise(F.concat(F.lit("R"), (user * 10 + e % 10).cast("string")))
    )
    kind = F.col("event_type")
    op = F.when(kind == "signup", "create").when(kind == "error", "cancel").otherwise("update")
    field = lambda name, value: F.create_map(F.lit(name), value)
    made = F.create_map(
        F.lit("date"), F.when(e % 13 == 0, "soon").otherwise(day),
        F.lit("origin"), F.when(e % 5 == 0, "").otherwise(start),
        F.lit("dest"), end,
        F.lit("total_paid"), F.col("value").cast("string"),
    )
    sited = F.create_map(
        F.lit("website"), F.concat(F.lit("site"), (e % 5).cast("string")), F.lit("trip_city"), end
    )
    fields = (
        F.when(kind == "signup", made)
        .when(kind == "purchase", field("total_paid", F.col("value").cast("string")))
        .when((kind == "view") & (e % 2 == 0), sited)
        .when(kind == "view", field("airline", F.lit("Other")))
        .when(kind == "click", field("status", F.lit("active")))
    )
    at = clock_text(F.col("ts"))
    return events.select(
        e.alias("ord"), op.alias("op"), F.when(op != "create", key).alias("flight_id"), fields.alias("fields"), at.alias("at")
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_rows(table(spark, sf_dir, "events"))
