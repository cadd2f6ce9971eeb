"""Keys used when candidates are matched to the register."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripledger.functions.text import bind, or_blank, strip

# Date texts read besides yyyy-MM-dd... (a documented list in place of a guessing parser).
DATE_FORMATS = ("yyyyMMdd", "yyyy/M/d", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def date_key(text: Column) -> Column:
    """First ten characters of an ISO text (not validated), else a parsed date, else blank."""

    def key(bare: Column) -> Column:
        tries = [F.try_to_date(bare, f).cast("string") for f in DATE_FORMATS]
        iso = (F.length(bare) >= 10) & (bare.substr(5, 1) == "-") & (bare.substr(8, 1) == "-")
        return or_blank(F.when(iso, bare.substr(1, 10)).otherwise(F.coalesce(*tries)))

    return bind(strip(text), key)


def day_of(key: Column) -> Column:
    """The calendar day of a date key, NULL when it is not a valid ``yyyy-MM-dd``."""
    return F.when(key.rlike(r"^\d{4}-\d{2}-\d{2}$"), key.try_cast("date"))


def airline_key(text: Column) -> Column:
    return or_blank(strip(F.lower(text)))


def code_key(text: Column) -> Column:
    """Airport or confirmation code."""
    return or_blank(strip(F.upper(text)))
