"""Booking fields read from a mail body, as column expressions.

Patterns run with Unicode classes, since bodies may hold no-break spaces.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripledger import vocabulary as V
from tripledger.functions.mail import month_number
from tripledger.functions.text import bind, lookup, or_blank, present

_EXACT = "(?dU)"
_CASE_BLIND = "(?diuU)"


def _from(letters: str, pattern: str) -> str:
    """A case-blind pattern that is only tried where one of its first letters stands.

    It finds the same text; the test saves trying every alternative at every position.
    """
    return f"(?dU)(?=[{letters.lower()}{letters.upper()}]){_CASE_BLIND}{pattern}"


_LABELLED = _from("cbpr", V.LABELLED_CODE)
_STEM = _from("cbril", V.STEM_CODE)
_CONTEXT = _from("daftol", V.AIRPORT_IN_CONTEXT)
_NUMBER = _EXACT + "(?=[A-Z])" + V.FLIGHT_NUMBER
_MONTH = "(?=[JFMASOND])" + V.MONTH_NAME


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def confirmation_code(body: Column) -> Column:
    """Labelled six-character code, else the first one near a booking stem, upper-cased."""
    labelled = present(F.regexp_extract(body, _LABELLED, 1))
    nearby = present(F.regexp_extract(body, _STEM, 1))
    return F.upper(F.coalesce(labelled, nearby))


def airports(body: Column, codes: Iterable[str] = V.AIRPORTS) -> Column:
    """Struct (origin, dest): a route, else two codes in context, else codes standing alone."""
    codes = tuple(codes)
    known = lambda c: c.isin(*codes)
    ends = F.transform(
        _all(body, _EXACT + V.ROUTE), lambda m: F.array(F.left(m, F.lit(3)), F.right(m, F.lit(3)))
    )
    route = F.get(F.filter(ends, lambda pair: F.forall(pair, known)), F.lit(0))
    context = F.filter(
        F.transform(_all(body, _CONTEXT, 1), lambda m: F.upper(m)), known
    )
    alone = F.array_distinct(F.filter(_all(body, _EXACT + V.AIRPORT_ALONE, 1), known))
    two = bind(context, lambda codes: F.when(F.size(codes) >= 2, codes))
    return bind(
        F.coalesce(route, two, alone),
        lambda pair: F.struct(F.get(pair, F.lit(0)).alias("origin"), F.get(pair, F.lit(1)).alias("dest")),
    )


def flight_number(body: Column) -> Column:
    """Airline prefix and digits of the first flight number, without the separator."""
    hit = present(F.regexp_extract(body, _NUMBER, 0))
    return F.regexp_replace(hit, r"^(..)\D", "$1")


def flight_airline(number: Column, prefixes: dict[str, str] = V.AIRLINE_BY_PREFIX) -> Column:
    return lookup(F.left(number, F.lit(2)), prefixes)


def fare_amounts(body: Column, limits: tuple[float, float] = V.FARE_RANGE) -> Column:
    """All dollar amounts within the limits, ascending."""
    values = F.transform(
        _all(body, _EXACT + V.FARE, 1), lambda m: F.replace(m, F.lit(",")).try_cast("double")
    )
    return F.sort_array(F.filter(values, lambda v: v.between(*limits)))


def base_fare(amounts: Column) -> Column:
    return F.when(F.size(amounts) > 1, F.get(amounts, F.lit(0)))


def total_paid(amounts: Column) -> Column:
    return F.get(amounts, F.size(amounts) - 1)


def body_dates(body: Column, years: tuple[int, int] = V.YEAR_RANGE) -> Column:
    """Distinct valid dates of a body, in pattern order and then text order."""
    day, year = r"([0-9]{1,2})", r"([0-9]{4})"

    def read(pattern: str, cut: str, order: tuple[int, int, int], named: bool) -> Column:
        def one(match: Column) -> Column:
            parts = F.split(match, cut)
            y, m, d = (F.get(parts, F.lit(i)) for i in order)
            return F.concat_ws("-", y, month_number(m).cast("string") if named else m, d).try_cast("date")

        return F.transform(_all(body, _CASE_BLIND + pattern), one)

    found = F.concat(
        read(rf"\b{_MONTH}\s+{day},?\s+{year}\b", r"(?U)[\s,]+", (2, 0, 1), True),
        read(rf"\b{day}/{day}/{year}\b", "/", (2, 0, 1), False),
        read(rf"\b{year}-([0-9]{{2}})-([0-9]{{2}})\b", "-", (0, 1, 2), False),
        read(rf"\b{day}\s+{_MONTH}\s+{year}\b", r"(?U)\s+", (2, 1, 0), True),
    )
    return F.array_distinct(F.filter(found, lambda d: F.year(d).between(*years)))


def upcoming_first(dates: Column, clock: Column) -> Column:
    """Dates from the mail's day on ascending, then earlier ones ascending.

    A body date is a UTC midnight, the mail's day starts at midnight of its own offset: west
    of UTC the same calendar day is already past. Without a mail date the order is kept.
    """
    start = F.date_add(clock["wall"].cast("date"), F.when(clock["offset"] < 0, 1).otherwise(0))
    ordered = F.concat(
        F.sort_array(F.filter(dates, lambda d: d >= start)),
        F.sort_array(F.filter(dates, lambda d: d < start)),
    )
    return F.when(start.isNull(), dates).otherwise(ordered)


def airline(
    domain: Column,
    body: Column,
    by_number: Column,
    domains: dict[str, str] = V.AIRLINE_BY_DOMAIN,
    phrases: dict[str, tuple[str, ...]] = V.AIRLINE_BY_PHRASE,
) -> Column:
    """Airline by sender domain, else by flight number, else by the first phrase set found."""
    pairs = ", ".join(
        f"struct('{phrase}' AS phrase, '{name}' AS name)" for name, options in phrases.items() for phrase in options
    )
    first = bind(
        F.lower(body), lambda low: F.get(F.filter(F.expr(f"array({pairs})"), lambda p: low.contains(p["phrase"])), F.lit(0))
    )
    return F.coalesce(lookup(domain, domains), by_number, first["name"])


def confidence(
    code: Column, origin: Column, dest: Column, airline_name: Column, number: Column,
    fare: Column, from_body: Column, weights: dict[str, float] = V.WEIGHTS,
) -> Column:
    """Weighted sum of the fields found, in double precision and in this order.

    Arguments are NULL when missing (``from_body`` is a boolean).
    """
    has = lambda c: c.isNotNull()
    give = lambda test, key: F.when(test, F.lit(weights[key])).otherwise(F.lit(0.0))
    places = (
        F.when(has(origin) & has(dest), F.lit(weights["route"]))
        .when(has(origin) | has(dest), F.lit(weights["one_airport"]))
        .otherwise(F.lit(0.0))
    )
    total = (
        give(has(code), "code") + places + give(has(airline_name), "airline")
        + give(has(number), "flight_number") + give(has(fare), "fare") + give(from_body, "body_date")
    )
    return F.least(total, F.lit(1.0))


def _short_hash(sep: str, *parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(sep, *parts), 256), F.lit(12))


def candidate_id(origin: Column, dest: Column, date_iso: Column, code: Column) -> Column:
    """Key of an extracted booking; it never equals a register key by design."""
    return _short_hash(
        "#", F.coalesce(present(origin), F.lit("UNK")), F.coalesce(present(dest), F.lit("UNK")),
        or_blank(date_iso), F.coalesce(present(code), F.lit("NONE")),
    )


def register_id(date_iso: Column, origin: Column, dest: Column, seq: Column, row: Column) -> Column:
    """Key of a register row."""
    return _short_hash("|", date_iso, origin, dest, seq, row.cast("string"))


def is_international(
    origin: Column, dest: Column, domestic: Iterable[str] = V.DOMESTIC_AIRPORTS
) -> Column:
    """Any known airport outside the home country."""
    domestic = tuple(domestic)
    known = F.array_compact(F.array(present(origin), present(dest)))
    return F.exists(known, lambda c: ~c.isin(*domestic))


def day_text(day: Column) -> Column:
    """``yyyy-MM-ddT00:00:00Z`` of a date."""
    return F.concat(day.cast("string"), F.lit("T00:00:00Z"))


def clock_text(wall: Column) -> Column:
    """Wall clock printed with ``Z``, its offset not applied."""
    return F.concat(F.replace(wall.cast("string"), F.lit(" "), F.lit("T")).substr(1, 19), F.lit("Z"))
