"""The register: seeding, search, and changes applied as batches.

A change set has the columns

    ord long, op string (create / update / cancel), flight_id string,
    fields map<string,string>, at string (the time the change counts as made)

and is applied as if its rows were done one by one in ``ord`` order. Rows are never deleted,
so a key exists from its register row or its first valid create on. That makes the whole
set a few aggregates per key instead of a sequential replay.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger import vocabulary as V
from tripledger.functions import fields as X
from tripledger.functions.text import bind, or_blank, present, say, word_array
from tripledger.operators.keep import computed, join_once, keep_last, possible, row_index

MONEY = T.DecimalType(12, 2)
_TEXT = (
    "flight_id", "date_iso", "date_yyyy_mm", "origin", "dest", "status", "created_at", "updated_at", "cost_type",
    "trip_city", "airline", "booked_class", "funding_source", "confirmation_code", "flight_number", "website",
    "cancelled_at",
)
_NUMBERS = ("eqm_miles", "base_fare", "extra_fees", "total_paid", "sequence")
REGISTER_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField("international", T.BooleanType())]
    + [T.StructField(c, MONEY) for c in _NUMBERS]
)
OPTIONAL_FIELDS = (
    "cost_type", "trip_city", "airline", "booked_class", "international", "eqm_miles", "base_fare", "extra_fees",
    "total_paid", "funding_source", "confirmation_code", "flight_number", "website", "sequence",
)
SUMMARY = (
    "flight_id", "date_iso", "origin", "dest", "trip_city", "airline", "status", "total_paid", "booked_class",
    "cost_type",
)
REJECT = ("ord", "op", "flight_id", "code", "message")
_DATE = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"


# ---------------------------------------------------------------- seeding

def seed_transform(df: DataFrame, order: str, as_of: str) -> DataFrame:
    """Booking rows as keyed register rows.

    Needs ``date`` (timestamp), ``origin``, ``dest`` and ``sequence``. The id ends in the
    position of the row among rows with the same date, route and sequence, by the ``order``
    column. Columns of the input win over the built ones when they hold a value; doubles
    become money, timestamps ISO text.
    """
    text = lambda c: or_blank(F.col(c).cast("string"))
    iso = or_blank(X.clock_text(F.col("date").cast("timestamp_ntz")))
    keyed = df.withColumns(
        {
            "_iso": iso,
            "_o": text("origin"),
            "_d": text("dest"),
            "_s": F.coalesce(F.col("sequence").cast("string"), F.lit("0")),
        }
    )
    placed = row_index(keyed, ["_iso", "_o", "_d", "_s"], order, "_row")
    built = {
        "flight_id": X.register_id(F.col("_iso"), F.col("_o"), F.col("_d"), F.col("_s"), F.col("_row")),
        "date_iso": F.col("_iso"),
        "date_yyyy_mm": F.col("_iso").substr(1, 7),
        "status": F.lit("active"),
        "created_at": F.lit(as_of),
        "updated_at": F.lit(as_of),
    }
    given = {
        f.name: _stored(F.col(f.name), f.dataType)
        for f in df.schema.fields
        if f.name not in V.SEED_DROPPED and f.name not in ("date", order)
    }
    merged = {n: F.coalesce(given[n].cast("string"), c) if n in given else c for n, c in built.items()}
    merged.update({n: c for n, c in given.items() if n not in merged})
    return placed.select(*[c.alias(n) for n, c in merged.items()])


def _stored(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value).cast(MONEY)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return X.clock_text(value.cast("timestamp_ntz"))
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return value
    return value.cast("string")


def upsert(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Stored and incoming rows with the last write per flight_id; incoming rows come later.

    Writes of one key with the same ``order`` are told apart by their content, so that a rerun keeps the same one.
    """
    both = stored.withColumns({"_late": F.lit(0), order: F.lit(None).cast("long")}).unionByName(
        incoming.withColumn("_late", F.lit(1)), allowMissingColumns=True
    )
    content = F.to_json(F.struct(*[F.col(c) for c in sorted(both.columns) if c not in ("_late", order)]))
    tied = both.withColumn("_content", F.sha2(content, 256))
    return keep_last(tied, ["flight_id"], ["_late", order, "_content"]).drop("_late", order, "_content")


def load_check(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (expected, actual, ok) comparing row counts."""
    tagged = stored.select(F.lit(1).alias("_s")).unionByName(expected.select(F.lit(0).alias("_s")))
    counts = tagged.agg(
        F.count_if(F.col("_s") == 0).alias("expected"), F.count_if(F.col("_s") == 1).alias("actual")
    )
    return counts.withColumn("ok", F.col("expected") == F.col("actual"))


def preview(rows: DataFrame, n: int = 5, key: str = "flight_id") -> DataFrame:
    """The first rows by key, for a dry run."""
    return rows.orderBy(key).limit(n)


# ---------------------------------------------------------------- reading

def search(
    register: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    international: bool | None = None,
    limit: int = V.PAGE_LIMIT,
    cursor: str | None = None,
    **equals: str | None,
) -> DataFrame:
    """A page of summaries in flight_id order, every given predicate applied.

    Dates compare as text, both ends included. ``equals`` may name origin, dest, airline,
    booked_class, trip_city, status and cost_type. ``cursor`` comes from ``next_cursor``.
    """
    allowed = ("origin", "dest", "airline", "booked_class", "trip_city", "status", "cost_type")
    page = register
    for name, value in equals.items():
        if name not in allowed:
            raise TypeError(f"unknown search argument: {name}")
        if value:
            page = page.where(F.col(name) == value)
    if date_from:
        page = page.where(F.col("date_iso") >= date_from)
    if date_to:
        page = page.where(F.col("date_iso") <= date_to)
    if international is not None:
        page = page.where(F.col("international") == F.lit(bool(international)))
    if cursor:
        page = page.where(F.col("flight_id") > json.loads(base64.b64decode(cursor))["flight_id"])
    return page.select(*SUMMARY).orderBy("flight_id").limit(int(limit))


def page_info(page: DataFrame, limit: int) -> DataFrame:
    """One row (count, next_token) of a page; no token when it holds fewer rows than the ``limit`` of its search."""
    token = F.base64(F.to_json(F.struct(F.max("flight_id").alias("flight_id"))).cast("binary"))
    size = F.count(F.lit(1))
    return page.agg(size.alias("count"), F.when(size >= limit, token).alias("next_token"))


def next_cursor(page: DataFrame, limit: int) -> str | None:
    """The cursor for the page after this one (one row to the driver)."""
    return page_info(page, limit).first()["next_token"]


def get_rows(register: DataFrame, ids: DataFrame) -> DataFrame:
    """Full rows of the given flight_ids."""
    return register.join(ids.select("flight_id").distinct(), "flight_id", "left_semi")


def missing_rows(register: DataFrame, ids: DataFrame) -> DataFrame:
    """The given flight_ids the register does not hold, as reject rows."""
    absent = ids.select("flight_id").distinct().join(register.select("flight_id"), "flight_id", "left_anti")
    return absent.select(
        "flight_id",
        F.when(_blank("flight_id"), "missing_param").otherwise("not_found").alias("code"),
        F.when(_blank("flight_id"), "flight_id is required")
        .otherwise(say("Flight {} not found", F.col("flight_id"))).alias("message"),
    )


# ---------------------------------------------------------------- changes

def _blank(name: str) -> Column:
    return or_blank(F.col(name)) == ""


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def _typed(name: str, value: Column) -> Column:
    kind = REGISTER_SCHEMA[name].dataType
    if isinstance(kind, T.DecimalType):
        return value.try_cast("double").try_cast(kind)
    return value.try_cast(kind)


def _bad_numbers(names: Iterable[str]) -> Column:
    """Names of number fields whose text is not a number."""
    tests = [F.when(_field(n).isNotNull() & _typed(n, _field(n)).isNull(), F.lit(n)) for n in names]
    return F.array_join(F.array_compact(F.array(*tests)), ", ")


def _listed(fields: Column) -> Column:
    return F.array_join(F.array_sort(fields), ", ")


def _create_checks() -> Column:
    """Key, time and refusal of a create row."""
    parts = F.split(F.regexp_replace(_field("date"), _DATE, "$1\t$2\t$3\t$4\t$5\t$6"), "\t")

    def clock(part: Column) -> Column:
        at = lambda i: F.coalesce(present(F.get(part, F.lit(i))), F.lit("00"))
        return F.concat(F.concat_ws("-", at(0), at(1), at(2)), F.lit(" "), F.concat_ws(":", at(3), at(4), at(5)))

    wall = bind(parts, lambda p: F.when(F.size(p) == 6, clock(p)).try_cast("timestamp_ntz"))
    missing = F.concat_ws(", ", *[F.when(or_blank(_field(n)) == "", F.lit(n)) for n in ("date", "origin", "dest")])

    def verdict(seen: Column) -> Column:
        iso = X.clock_text(seen["wall"])
        refusal = _first_of(
            (seen["missing"] != "", "missing_param", say("Required field(s) missing: {}", seen["missing"])),
            (iso.isNull(), "invalid_date",
             say("Invalid date format: {}. Use ISO 8601 (e.g. 2025-06-15).", _field("date"))),
            (seen["bad"] != "", "invalid_number", say("Invalid number in field(s): {}", seen["bad"])),
        )
        key = X.register_id(
            iso, _field("origin"), _field("dest"), F.coalesce(_field("sequence"), F.lit("0")), F.lit(0)
        )
        return F.struct(key.alias("key"), iso.alias("iso"), refusal.alias("refusal"))

    seen = F.struct(wall.alias("wall"), missing.alias("missing"), _bad_numbers(_NUMBERS).alias("bad"))
    return bind(seen, verdict)


def _edit_checks() -> Column:
    """Key and refusal of an update or cancel row, as far as the register is not needed."""
    names = F.map_keys("fields")
    update = F.col("op") == "update"

    def verdict(seen: Column) -> Column:
        refusal = _first_of(
            (_blank("flight_id"), "missing_param", F.lit("flight_id is required")),
            (update & (F.coalesce(F.size("fields"), F.lit(0)) < 1), "no_updates", F.lit("No fields provided to update")),
            (update & (seen["fixed"] != ""), "immutable_field",
             say("Cannot modify immutable field(s): {}", seen["fixed"])),
            (update & (seen["unknown"] != ""), "unknown_field",
             say("Unknown field(s): {}. Mutable fields: " + ", ".join(sorted(V.MUTABLE_FIELDS)), seen["unknown"])),
            (update & (seen["bad"] != ""), "invalid_number", say("Invalid number in field(s): {}", seen["bad"])),
        )
        return F.struct(F.col("flight_id").alias("key"), F.lit(None).cast("string").alias("iso"), refusal.alias("refusal"))

    seen = F.struct(
        _listed(F.array_intersect(names, word_array(V.IMMUTABLE_FIELDS))).alias("fixed"),
        _listed(F.array_except(names, word_array(V.MUTABLE_FIELDS))).alias("unknown"),
        _bad_numbers(("base_fare", "extra_fees", "total_paid")).alias("bad"),
    )
    return bind(seen, verdict)


def _first_of(*tests: tuple[Column, str, Column]) -> Column:
    """Struct (code, message) of the first test that holds, or NULL."""
    chain = F
    for test, code, message in tests:
        chain = chain.when(test, F.struct(F.lit(code).alias("code"), message.alias("message")))
    return chain


def checked(log: DataFrame) -> DataFrame:
    """The change rows with ``key`` (the id they are about), ``iso``, ``code`` and ``message``.

    ``code`` is NULL for rows that can be applied if the register agrees. The checks pass
    through a generator, so that they run once per row and later filters do not repeat them.
    """
    verdict = F.when(F.col("op") == "create", _create_checks()).otherwise(_edit_checks())
    judged = computed(log.select("ord", "op", "flight_id", "fields", "at"), _v=verdict)
    return judged.select(
        "ord", "op", "fields", "at", "_v.key", "_v.iso", F.col("_v.refusal.code").alias("code"), F.col("_v.refusal.message").alias("message")
    )


def _created_row() -> Column:
    """The register row a create row asks for."""
    values = {
        "flight_id": F.col("key"),
        "date_iso": F.col("iso"),
        "date_yyyy_mm": F.col("iso").substr(1, 7),
        "origin": F.upper(_field("origin")),
        "dest": F.upper(_field("dest")),
        "status": F.lit("active"),
        "created_at": F.col("at"),
        "updated_at": F.col("at"),
        **{n: _typed(n, _field(n)) for n in OPTIONAL_FIELDS},
    }
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in REGISTER_SCHEMA.fields])


class Outcome:
    """What a change set does: ``changed`` rows (new images), ``rejects`` and the ``whole`` register afterwards.

    All are plans; ``decided`` is the change log that they share, with the verdict on each row, for a caller that runs
    more than one of them and wants to store it once.
    """

    def __init__(self, register: DataFrame, decided: DataFrame, keys: DataFrame | None):
        self._register = register
        self._keys = keys
        self.decided = decided

    @property
    def changed(self) -> DataFrame:
        """Only register rows that may be named are shuffled."""
        folded = _folded(self.decided)
        named = self._register if self._keys is None else possible(self._register, ["flight_id"], self._keys)
        met = folded.join(_old_rows(named), F.col("_id") == F.col("_key"), "left")
        # Rows that only repeated cancels touched are left out.
        moved = F.col("_new").isNotNull() | _last_edit().isNotNull()
        return met.withColumn("_row", F.coalesce("_old", "_new")).where(moved).select(*_image())

    @property
    def whole(self) -> DataFrame:
        met = _folded(self.decided).join(_old_rows(self._register), F.col("_id") == F.col("_key"), "full")
        return met.withColumn("_row", F.coalesce("_old", "_new")).select(*_image())

    @property
    def rejects(self) -> DataFrame:
        return _rejects(self.decided)


def apply_changes(register: DataFrame, log: DataFrame) -> Outcome:
    """What the changes do, see ``decide``."""
    return decide(register, checked(log))


def decide(register: DataFrame, rows: DataFrame, narrowed: bool = False) -> Outcome:
    """What the changes do, as if made one by one in ``ord`` order.

    One aggregate over register keys and changes together finds where each named key begins (in the register, or at its
    first valid create), one join tells every change whether it comes after that, and one aggregate per key folds what
    remains. All three combine the changes of a hot key before shuffling. The register is read once for its keys and
    once for its rows. ``rows`` are checked changes; ``narrowed`` says that the register holds little else than named rows.
    """
    valid, create_op = F.col("code").isNull(), F.col("op") == "create"
    no, yes = F.lit(False), F.lit(True)
    known = register.select(F.col("flight_id").alias("key"), yes.alias("held"), no.alias("named"), F.lit(None).cast("long").alias("made"))
    asked = rows.where(valid).select("key", no.alias("held"), yes.alias("named"), F.when(create_op, F.col("ord")).alias("made"))
    starts = known.unionByName(asked).groupBy("key").agg(
        F.max("held").alias("held"), F.max("named").alias("named"), F.min("made").alias("first_create")).where("named").drop("named")

    # Refused rows find no start: they are told apart by their order, which also spreads them.
    starts = starts.withColumn("_refused", F.lit(-1).cast("long"))
    keyed = rows.withColumn("_refused", F.when(valid, F.lit(-1).cast("long")).otherwise(F.col("ord")))
    placed = join_once(keyed, starts, ["key", "_refused"], "left")
    accepted = F.when(create_op, ~F.col("held") & (F.col("ord") == F.col("first_create"))).otherwise(
        F.col("held") | F.coalesce(F.col("ord") > F.col("first_create"), F.lit(False))
    )
    decided = placed.withColumn("_ok", valid & accepted)
    return Outcome(register, decided.drop("held", "first_create", "_refused"), None if narrowed else asked.select(F.col("key").alias("flight_id")))


def _folded(decided: DataFrame) -> DataFrame:
    """One row per key with accepted changes: ``_id``, the last value of each field, the created row, last update and first cancel."""
    update, cancel, create_op = (F.col("op") == op for op in ("update", "cancel", "create"))
    given = [
        F.max_by(
            F.struct(_typed(n, _field(n)).alias("v")),
            F.when(update & F.array_contains(F.map_keys("fields"), n), F.col("ord")),
        ).alias(f"_{n}")
        for n in V.MUTABLE_FIELDS
    ]
    return decided.where("_ok").groupBy(F.col("key").alias("_id")).agg(
        *given,
        F.max_by(_created_row(), F.when(create_op, F.col("ord"))).alias("_new"),
        F.max(F.when(update, F.struct("ord", "at"))).alias("_updated"),
        F.min(F.when(cancel, F.struct("ord", "at"))).alias("_cancelled"),
    )


def _old_rows(register: DataFrame) -> DataFrame:
    return register.select(F.col("flight_id").alias("_key"), F.struct(*REGISTER_SCHEMA.names).alias("_old"))


def _stop() -> Column:
    """The cancel that counts: the first one of a row that was not cancelled before."""
    return F.when(or_blank(F.col("_row.status")) != "cancelled", F.col("_cancelled"))


def _last_edit() -> Column:
    return F.greatest(F.col("_updated"), _stop())


def _image() -> list[Column]:
    """The columns of a row after its changes; a row without changes stays as it is."""
    was = lambda c: F.col(f"_row.{c}")
    edited = {n: F.when(F.col(f"_{n}").isNotNull(), F.col(f"_{n}.v")).otherwise(was(n)) for n in V.MUTABLE_FIELDS}
    edited["status"] = F.when(_stop().isNotNull(), "cancelled").otherwise(was("status"))
    edited["cancelled_at"] = F.coalesce(_stop()["at"], was("cancelled_at"))
    edited["updated_at"] = F.coalesce(_last_edit()["at"], was("updated_at"))
    return [edited.get(c, was(c)).alias(c) for c in REGISTER_SCHEMA.names]


def _rejects(decided: DataFrame) -> DataFrame:
    valid, create_op = F.col("code").isNull(), F.col("op") == "create"
    code = (
        F.when(~valid, F.struct("code", "message"))
        .when(
            create_op,
            F.struct(
                F.lit("duplicate").alias("code"),
                say("Flight {} already exists (same date/origin/dest/sequence). Use update_flight to modify it.",
                    F.col("key")).alias("message"),
            ),
        )
        .otherwise(F.struct(F.lit("not_found").alias("code"), say("Flight {} not found", F.col("key")).alias("message")))
    )
    refused = decided.where(~F.col("_ok")).withColumn("_why", code)
    return refused.select("ord", "op", or_blank(F.when(valid | ~create_op, F.col("key"))).alias("flight_id"), "_why.code", "_why.message")


def merge(register: DataFrame, changed: DataFrame) -> DataFrame:
    """The register with the new images in place of the old rows, by one join that computes both sides once."""
    columns = REGISTER_SCHEMA.names
    images = changed.select(F.col("flight_id").alias("_key"), F.struct(*columns).alias("_image"))
    both = register.select(*columns).join(images, F.col("flight_id") == F.col("_key"), "full")
    return both.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_image.{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def create(register: DataFrame, log: DataFrame) -> Outcome:
    """Inserts of the create rows only."""
    return apply_changes(register, log.where("op = 'create'"))


def update(register: DataFrame, log: DataFrame) -> Outcome:
    """Edits of the update rows only."""
    return apply_changes(register, log.where("op = 'update'"))


def cancel(register: DataFrame, ids: DataFrame, at: str) -> Outcome:
    """Soft delete of the given flight_ids; cancelling twice equals once."""
    log = ids.select("flight_id").distinct().select(
        F.lit(0).cast("long").alias("ord"), F.lit("cancel").alias("op"), "flight_id",
        F.lit(None).cast("map<string,string>").alias("fields"), F.lit(at).alias("at"),
    )
    return apply_changes(register, log)
