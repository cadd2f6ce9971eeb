"""Small text expressions shared by every operator."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space a strip removes, spelled for btrim.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2007\u202f\u3000"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once and written once into the plan.

    A lambda over a one-element array stands in for a local variable, which keeps plans of
    nested expressions small.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_array(words: Iterable[str]) -> Column:
    """A constant array of texts, built as one expression."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({quoted})")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def present(text: Column) -> Column:
    """The text, or NULL when it is blank, so that blanks never match in a join."""
    return F.nullif(text, F.lit(""))


def or_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Case-blind substring test, as one regular expression pass over the text."""
    return text.rlike("(?iu)(?:" + "|".join(re.escape(w) for w in words) + ")")


def words_found(lowered: Column, words: Iterable[str]) -> Column:
    """The given words that occur in an already lower-cased text."""
    wanted = word_array(words)
    return bind(lowered, lambda text: F.filter(wanted, lambda w: text.contains(w)))


def count_words(words: Iterable[str], *texts: Column) -> Column:
    """How many words occur in at least one of the texts, each text lower-cased once."""
    wanted = word_array(words)
    return bind(
        F.array(*[F.lower(t) for t in texts]),
        lambda lowered: F.size(F.filter(wanted, lambda w: F.exists(lowered, lambda t: t.contains(w)))),
    )


def tagged(names: Sequence[str], *rows: Sequence[Column]) -> Column:
    """An array of structs with the given field names, one per row of columns."""
    return F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, row, strict=True)]) for row in rows])


def lookup(key: Column, table: dict[str, str]) -> Column:
    """A small fixed dictionary as a map literal; NULL when the key is absent."""
    keys, values = word_array(table), word_array(table.values())
    return F.try_element_at(F.map_from_arrays(keys, values), key)


def infer_format(path: Column) -> Column:
    """File format by suffix of the path."""
    lowered = F.lower(path)
    return (
        F.when(lowered.endswith(".mbox"), "mbox")
        .when(lowered.endswith(".csv"), "csv")
        .when(lowered.endswith(".json"), "json")
        .when(lowered.endswith(".gz"), "gzip")
        .otherwise("unknown")
    )


def say(template: str, *values: Column) -> Column:
    """The template with each ``{}`` replaced by the next value."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def safe_text(value: Column, kind: str) -> Column:
    """Text of any column, blank for NULL and NaN."""
    if kind in ("double", "float"):
        value = F.when(~F.isnan(value), value)
    return or_blank(value.cast("string"))
