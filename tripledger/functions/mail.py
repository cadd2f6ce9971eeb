"""Mail headers: names, sender domain, date and the tier of a message."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripledger import vocabulary as V
from tripledger.functions.text import BLANKS, bind, contains_any, count_words, or_blank, present, strip, word_array

# Named zones of RFC 2822 and their minutes east of UTC.
ZONE_MINUTES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
_DATE = (
    r"(?i)^\s*(?:[a-z]{3,9}(?:,\s*|\s+))?(\d{1,2})[\s-]+([a-z]{3})[a-z]*[\s-]+(\d{2,4})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[a-z]{1,5})?\s*$"
)


def header(block: Column, name: str) -> Column:
    """First header of that name, folded lines kept, blank when missing."""
    pattern = rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*(?:\r?\n[ \t][^\r\n]*)*)"
    return or_blank(F.regexp_extract(block, pattern, 1))


def sender_domain(sender: Column) -> Column:
    """Text after the first ``@``; the whole header when there is none."""
    found = present(F.regexp_extract(sender, r"(?U)@([\w.-]+)", 1))
    return F.coalesce(F.lower(found), strip(F.lower(sender)))


def mail_clock(date: Column) -> Column:
    """Struct of the mail's own wall clock, its offset in minutes and the ISO text.

    ``wall`` and ``iso`` are NULL for unparseable dates. A date without a zone (or with
    ``-0000``) has no offset in ``iso`` and counts as UTC in comparisons.
    """
    bare = F.regexp_replace(date, r"\([^)]*\)", " ")
    parts = F.split(F.regexp_replace(bare, _DATE, "$1\t$2\t$3\t$4\t$5\t$6\t$7"), "\t")
    # A text the pattern does not match comes back unchanged, so it has other than seven parts.
    timed = bind(
        parts, lambda p: F.when(F.size(p) == 7, F.struct(_wall(p).alias("wall"), _offset(p).alias("offset")))
    )
    return bind(
        timed,
        lambda t: F.struct(
            t["wall"].alias("wall"), F.coalesce(t["offset"], F.lit(0)).alias("offset"),
            F.concat(F.replace(t["wall"].cast("string"), F.lit(" "), F.lit("T")), or_blank(_zone_text(t["offset"]))).alias("iso"),
        ),
    )


def _wall(part: Column) -> Column:
    year = bind(
        F.get(part, F.lit(2)).try_cast("int"),
        lambda y: F.when(y > 99, y).when(y > 68, y + 1900).otherwise(y + 2000),
    )
    day = F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"), month_number(F.get(part, F.lit(1))).cast("string"), F.get(part, F.lit(0))
    )
    clock = F.concat_ws(
        ":", F.get(part, F.lit(3)), F.get(part, F.lit(4)), F.coalesce(present(F.get(part, F.lit(5))), F.lit("00"))
    )
    return F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz")


def _offset(part: Column) -> Column:
    """Minutes east of UTC, NULL without a known zone."""
    names = F.map_from_arrays(word_array(ZONE_MINUTES), F.expr("array(" + ", ".join(map(str, ZONE_MINUTES.values())) + ")"))

    def minutes(zone: Column) -> Column:
        digits = zone.substr(2, 4).try_cast("int")
        size = F.floor(digits / 100) * 60 + digits % 100
        return (
            F.when(zone == "-0000", F.lit(None))
            .when(zone.startswith("-"), -size)
            .when(zone.startswith("+"), size)
            .otherwise(F.try_element_at(names, zone))
            .cast("int")
        )

    return bind(F.upper(F.get(part, F.lit(6))), minutes)


def _zone_text(offset: Column) -> Column:
    hours = F.lpad(F.floor(F.abs(offset) / 60).cast("string"), 2, "0")
    minutes = F.lpad((F.abs(offset) % 60).cast("string"), 2, "0")
    return F.concat(F.when(offset < 0, "-").otherwise("+"), hours, F.lit(":"), minutes)


def mail_date(date: Column) -> Column:
    """ISO text of a Date header; NULL when blank, the trimmed text when unparseable."""
    return F.coalesce(mail_clock(date)["iso"], present(F.btrim(date, F.lit(BLANKS))))


def month_number(name: Column) -> Column:
    """1..12 from an English month name or its three-letter form, else NULL."""
    months = F.create_map(*[F.lit(x) for pair in V.MONTHS.items() for x in pair])
    return F.try_element_at(months, F.lower(name.substr(1, 3)))


def relevant(
    sender: Column,
    subject: Column,
    sender_words: Iterable[str] = V.SENDER_WORDS,
    subject_words: Iterable[str] = V.SUBJECT_WORDS,
) -> Column:
    """Sender or subject holds one of the words."""
    return contains_any(sender, sender_words) | contains_any(subject, subject_words)


def tier(
    domain: Column,
    subject: Column,
    airline_domains: Iterable[str] = tuple(V.AIRLINE_BY_DOMAIN),
    airline_labels: Iterable[str] = V.AIRLINE_LABELS,
    agency_domains: Iterable[str] = V.AGENCY_DOMAINS,
    agency_labels: Iterable[str] = V.AGENCY_LABELS,
    gated: str = V.GATED_AGENCY,
) -> Column:
    """1 for airline mail, 2 for agency mail, NULL for the rest.

    Airlines win over agencies; the gated agency counts only with a booking word in the
    subject, and without one it stays NULL whatever the subject says.
    """
    booking = contains_any(subject, V.BOOKING_SUBJECT_WORDS)
    airline = domain.isin(*airline_domains) | contains_any(domain, airline_labels)
    agency = domain.isin(*agency_domains) | contains_any(domain, agency_labels)
    return (
        F.when(airline, 1)
        .when(agency & domain.contains(gated), F.when(booking, 2))
        .when(agency, 2)
        .when(booking & contains_any(subject, V.AIRLINE_NAMES), 1)
        .cast("long")
    )


def is_work_mail(body: Column, subject: Column) -> Column:
    """More work words (body or subject) than booking words (body)."""
    return count_words(V.WORK_WORDS, body, subject) > count_words(V.BOOKING_WORDS, body)
