"""Candidates against an existing register: five match rules, first hit wins.

The result for a candidate depends only on its five normalised keys. So the work is done
once per distinct key tuple, on narrow rows:

    candidates -> distinct key tuples -> probes (one per rule that can apply)
    register   -> lookup rows per rule -> those that a probe may ask for -> counted per (rule, key)
    probes x counts -> first rule per tuple -> joined back to the candidates

Rules are numbered 1 to 5; ``match_rules`` selects a subset. All rules share one equi join: a
code is a key like the others, whose count carries its last register row, and a day band is two
lookup rows per register row (the day before and the day after). Where candidates are few, a Bloom
filter of the probes' hashes drops lookup rows before their shuffle that no candidate asks for, such
as the airline days of a register whose candidates all name their airports.

A candidate names the group of register rows that it matches and their number, whatever the
number is; ``match_members`` gives all rows of all groups in use. Nothing collects a group.
Counts of statuses need no candidate rows: ``status_totals`` weighs the tuples by their copies.

Skew: tuples and counts are aggregated before their shuffles, blank keys send no probe at
all, and the remaining joins have one row per key on one side, so adaptive execution can
split a hot other side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions import normalize as N
from tripledger.functions.text import present, safe_text, say, tagged
from tripledger.operators.keep import computed, join_once, possible

CODE, SAME_BOOKING, SAME_ROUTE_NEAR_DAY, SAME_AIRLINE_DAY, SAME_AIRLINE_NEAR_DAY = ALL_RULES = (1, 2, 3, 4, 5)
PARTS = ("_code", "_date", "_origin", "_dest", "_airline")
# A hash leads both keys: sorts then compare one number and rarely the texts behind it.
TUPLE = ("_hash", *PARTS)
KEY = ("hash", "rule", "k1", "k2", "k3", "k4")
STATUSES = ("net_new", "exact_duplicate", "near_match", "conflict")
LEVELS = ("high", "medium", "low")
BOOKING_REASON = "date+origin+dest+airline match"


def with_keys(df: DataFrame) -> DataFrame:
    """Adds the five normalised keys, blank when missing, and their hash."""
    named = computed(
        df,
        _code=N.code_key(F.col("confirmation_code")),
        _date=N.date_key(F.col("date_iso").cast("string")),
        _origin=N.code_key(F.col("origin")),
        _dest=N.code_key(F.col("dest")),
        _airline=N.airline_key(F.col("airline")),
    )
    return named.withColumn("_hash", F.xxhash64(*PARTS))


def _filled(*names: str) -> Column:
    test = F.lit(True)
    for name in names:
        test = test & (F.col(name) != "")
    return test


def _slot(rule: int, parts: Sequence[Column], test: Column, **extra: Column) -> Column:
    """A lookup or probe row for a rule, or NULL when the test fails."""
    padded = [*parts, *[F.lit("")] * (4 - len(parts))]
    number = F.lit(rule)
    named = [F.xxhash64(number, *padded).alias("hash"), number.alias("rule")]
    named += [p.alias(f"k{i + 1}") for i, p in enumerate(padded)]
    return F.when(test, F.struct(*named, *[c.alias(n) for n, c in extra.items()]))


def lookup_rows(register: DataFrame, rules: Sequence[int] = ALL_RULES) -> DataFrame:
    """Register rows under every key a rule may look them up by."""
    keyed = with_keys(register)
    date, origin, dest, line, code = (F.col(c) for c in ("_date", "_origin", "_dest", "_airline", "_code"))
    day = N.day_of(date)
    near = lambda shift: F.date_add(day, shift).cast("string")
    dated, routed, flown = day.isNotNull(), _filled("_origin", "_dest"), _filled("_airline")
    slots = {
        CODE: [((code,), _filled("_code"))],
        SAME_BOOKING: [((date, origin, dest, line), routed & flown & _filled("_date"))],
        SAME_ROUTE_NEAR_DAY: [((origin, dest, near(s)), routed & dated) for s in (-1, 1)],
        SAME_AIRLINE_DAY: [((line, date), flown & _filled("_date"))],
        SAME_AIRLINE_NEAR_DAY: [((line, near(s)), flown & dated) for s in (-1, 1)],
    }
    rows = [_slot(r, key, test) for r in rules for key, test in slots[r]]
    opened = keyed.select("ord", "flight_id", "_date", "_origin", "_dest", F.explode(F.array_compact(F.array(*rows))).alias("_slot"))
    return opened.select(
        "_slot.*", "ord", F.col("flight_id").cast("string").alias("flight_id"), F.col("_date").alias("date"), F.col("_origin").alias("origin"),
        F.col("_dest").alias("dest"))


def _last_of_code() -> Column:
    """Of the lookup rows of a code, the last register row."""
    return F.max(F.when(F.col("rule") == CODE, F.struct("ord", "flight_id", "date", "origin", "dest")))


def _reason(rule: Column, n: Column) -> Column:
    """Reason text of a candidate, from its keys and the size of its group."""
    date, origin, dest, line = (F.col(c) for c in ("_date", "_origin", "_dest", "_airline"))
    missing = " [candidate missing origin/dest"
    return (
        F.when(rule == SAME_BOOKING, BOOKING_REASON)
        .when(rule == SAME_ROUTE_NEAR_DAY, say("same route {}-{} +/-1 day (candidate: {}, existing: {} rows)", origin, dest, date, n))
        .when(rule == SAME_AIRLINE_DAY, say("date+airline match ({}, {})" + missing + "]", date, line))
        .when(rule == SAME_AIRLINE_NEAR_DAY, say("date+airline near match ({}, {})" + missing + ", +/-1 day]", date, line))
    )


def _member_reason() -> Column:
    """Reason text of one register row of a group, from the key of the group."""
    k1, k2, k3, existing = (F.col(c) for c in ("k1", "k2", "k3", "date"))
    missing = " [candidate missing origin/dest"
    rule = F.col("rule")
    return (
        F.when(rule == SAME_BOOKING, BOOKING_REASON)
        .when(rule == SAME_ROUTE_NEAR_DAY, say("same route {}-{} +/-1 day (candidate: {}, existing: {})", k1, k2, k3, existing))
        .when(rule == SAME_AIRLINE_DAY, say("date+airline match ({}, {})" + missing + "]", k2, k1))
        .when(rule == SAME_AIRLINE_NEAR_DAY, say("date+airline near match ({} vs {}, {})" + missing + ", +/-1 day]", k2, existing, k1))
        .when(rule == CODE, say("confirmation_code match ({})", k1))
    )


def _group_name(rule: Column, parts: Sequence[Column]) -> Column:
    return F.to_json(F.array(rule.cast("string"), *parts))


def _tuple_key(rule: Column) -> list[Column]:
    """The four key parts under which a rule looks a tuple up."""
    date, origin, dest, line, code = (F.col(c) for c in ("_date", "_origin", "_dest", "_airline", "_code"))
    by_rule = {CODE: (code,), SAME_BOOKING: (date, origin, dest, line), SAME_ROUTE_NEAR_DAY: (origin, dest, date)}
    parts = []
    for i in range(4):
        part = F.when(rule >= SAME_AIRLINE_DAY, (line, date, F.lit(""), F.lit(""))[i])
        for number, key in by_rule.items():
            part = part.when(rule == number, key[i] if i < len(key) else F.lit(""))
        parts.append(part)
    return parts


def _probes(tuples: DataFrame, rules: Sequence[int], blank: bool = False) -> DataFrame:
    """One row per tuple and rule that can apply; with ``blank`` also one that finds nothing for every other tuple."""
    date, origin, dest, line, code = (F.col(c) for c in ("_date", "_origin", "_dest", "_airline", "_code"))
    dated, routed, flown = N.day_of(date).isNotNull(), _filled("_origin", "_dest"), _filled("_airline")
    slots = {
        CODE: ((code,), _filled("_code")),
        SAME_BOOKING: ((date, origin, dest, line), routed & flown & _filled("_date")),
        SAME_ROUTE_NEAR_DAY: ((origin, dest, date), routed & dated),
        SAME_AIRLINE_DAY: ((line, date), ~routed & flown & _filled("_date")),
        SAME_AIRLINE_NEAR_DAY: ((line, date), ~routed & flown & dated),
    }
    made = F.array_compact(F.array(*[_slot(r, *slots[r]) for r in rules]))
    if blank:  # rule 0 has no lookup row; its hash is that of the tuple, which spreads these rows
        none = F.struct(F.col("_hash").alias("hash"), F.lit(0).alias("rule"), *[F.lit("").alias(f"k{i}") for i in (1, 2, 3, 4)])
        made = F.when(F.size(made) == 0, F.array(none)).otherwise(made)
    return tuples.select(*tuples.columns, F.explode(made).alias("_slot")).select(*tuples.columns, "_slot.*")


def asked_rows(register: DataFrame, probes: DataFrame, rules: Sequence[int] = ALL_RULES) -> DataFrame:
    """The lookup rows that some probe may ask for: the others are dropped before any shuffle."""
    return possible(lookup_rows(register, rules), ["hash"], probes)


def _differences() -> Column:
    """The fields in which a tuple differs from the last row of its code, blank if in none."""

    def differs(label: str, mine: str, other: str) -> Column:
        a, b = F.col(mine), F.col(f"last.{other}")
        return F.when((a != "") & (b != "") & (a != b), say(label + ": {} vs {}", a, b))

    return F.concat_ws("; ", differs("origin", "_origin", "origin"), differs("dest", "_dest", "dest"), differs("date", "_date", "date"))


def counted_lookups(rows: DataFrame) -> DataFrame:
    """Lookup rows counted per key, with the last register row of a code: one row per key of the register."""
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), _last_of_code().alias("last"))


def _hits(
    tuples: DataFrame, register: DataFrame | None, rules: Sequence[int], every: bool = False, few: bool = False, lookups: DataFrame | None = None,
) -> DataFrame:
    """The first rule that hits, per distinct key tuple: rule, n (register rows); of a code conflict, differences and the last row.

    With ``every``, tuples without a hit too. Columns that a caller does not read are pruned.
    """
    probes = _probes(tuples, rules, blank=every)
    if lookups is None:
        counts = counted_lookups(asked_rows(register, probes, rules) if few else lookup_rows(register, rules))
        found = join_once(probes, counts, KEY, "left" if every else "inner")
    else:
        found = probes.join(lookups, [*KEY], "left" if every else "inner")
    by_code = F.when((F.col("rule") == CODE) & F.col("n").isNotNull(), _differences())
    sizes = [F.max(F.when(F.col("rule") == r, F.col("n"))).alias(f"n{r}") for r in rules if r != CODE]
    hits = found.groupBy(*tuples.columns).agg(
        F.min(F.when(F.col("n").isNotNull(), F.col("rule"))).alias("rule"), *sizes, F.max(by_code).alias("differences"),
        F.max((by_code != "").cast("int")).alias("conflict"), F.max(F.when(F.col("rule") == CODE, F.struct("last.ord", "last.flight_id"))).alias("last"))
    n = F.when(F.col("rule") == CODE, F.lit(1).cast("long"))
    for r in rules:
        n = n if r == CODE else n.when(F.col("rule") == r, F.col(f"n{r}"))
    return hits.select(*tuples.columns, "rule", n.alias("n"), "conflict", "differences", "last")


def match_hits(
    candidates: DataFrame, register: DataFrame | None, rules: Sequence[int] = ALL_RULES, few: bool = False, lookups: DataFrame | None = None,
) -> DataFrame:
    """The hits of the distinct key tuples of the candidates, see ``_hits``.

    ``few`` says that the candidates are few against the register: then its lookup rows pass the filter first, for which
    the candidates are read once more. ``lookups`` are ``counted_lookups`` that a caller stored, best in a table with
    buckets by KEY: then repeated reconciliations need no register and shuffle the probes only. Such a join does not split
    the probes of a hot key.
    """
    return _hits(with_keys(candidates).select(*TUPLE).distinct(), register, rules, few=few, lookups=lookups)


def _status(rule: Column, conflict: Column) -> Column:
    return (
        F.when(rule.isNull(), "net_new")
        .when((rule == CODE) & (conflict == 1), "conflict")
        .when(rule <= SAME_BOOKING, "exact_duplicate")
        .otherwise("near_match")
    )


def status_totals(candidates: DataFrame, register: DataFrame, rules: Sequence[int] = ALL_RULES) -> DataFrame:
    """As ``status_counts`` of the classified candidates, from the tuples alone: no candidate row is joined."""
    tuples = with_keys(candidates).groupBy(*TUPLE).agg(F.count(F.lit(1)).alias("copies"))
    hits = _hits(tuples, register, rules, every=True)
    return _totals(hits.select(_status(F.col("rule"), F.col("conflict")).alias("dedup_status"), "copies"), F.col("copies"))


def classify(
    candidates: DataFrame, register: DataFrame | None, rules: Sequence[int] = ALL_RULES, hits: DataFrame | None = None,
) -> DataFrame:
    """All candidate columns plus dedup_status, match_group, match_count, match_reason, confidence.

    ``register`` needs flight_id, date_iso, origin, dest, airline, confirmation_code and
    ``ord``, its row order. The candidate row count never changes. ``match_group`` is blank
    for a new candidate; ``match_members`` lists the register rows of every group. ``hits`` may
    give the result of ``match_hits``, if it was stored.
    """
    keyed = with_keys(candidates)
    hits = match_hits(candidates, register, rules) if hits is None else hits
    hit = {c: f"_hit_{c}" for c in hits.columns if c not in TUPLE}
    joined = join_once(keyed, hits.withColumnsRenamed(hit), TUPLE, "left")
    rule, n, differences, conflict = (F.col(f"_hit_{c}") for c in ("rule", "n", "differences", "conflict"))
    code = F.col("_code")
    by_code = F.when(differences == "", say("confirmation_code exact match ({})", code)).otherwise(
        say("confirmation_code match ({}) but fields differ: {}", code, differences))
    unmatched = (
        F.when(_filled("_origin", "_dest", "_date"), "high").when(_filled("_date"), "medium").otherwise("low")
    )
    level = (
        F.when(rule.isNull(), unmatched)
        .when(rule <= SAME_BOOKING, "high")
        .when(rule == SAME_ROUTE_NEAR_DAY, "medium")
        .otherwise("low")
    )
    return joined.select(
        *[F.col(c) for c in candidates.columns],
        _status(rule, conflict).alias("dedup_status"),
        F.when(rule.isNull(), "").otherwise(_group_name(rule, _tuple_key(rule))).alias("match_group"),
        F.coalesce(n, F.lit(0)).cast("long").alias("match_count"),
        F.when(rule.isNull(), "").when(rule == CODE, by_code).otherwise(_reason(rule, n)).alias("match_reason"),
        level.alias("confidence"),
    )


def matches(candidates: DataFrame, register: DataFrame, rules: Sequence[int]) -> DataFrame:
    """Only the candidates that the given rules match."""
    return classify(candidates, register, rules).where("dedup_status <> 'net_new'")


def match_members(candidates: DataFrame, register: DataFrame, rules: Sequence[int] = ALL_RULES) -> DataFrame:
    """All register rows of every group that a candidate names: match_group, ord, flight_id, date, reason."""
    return members_of(match_hits(candidates, register, rules), register, rules)


def members_of(hits: DataFrame, register: DataFrame, rules: Sequence[int] = ALL_RULES, stored: bool = False) -> DataFrame:
    """As ``match_members``, from hits; of ``stored`` ones the groups filter the lookup rows first."""
    rule = F.col("rule")
    parts = _tuple_key(rule)
    groups = hits.where("rule is not null").select(
        F.xxhash64(rule, *parts).alias("hash"), rule, *[p.alias(f"k{i + 1}") for i, p in enumerate(parts)],
        F.when(rule == CODE, F.col("last")).alias("only")).distinct()
    met = join_once(asked_rows(register, groups, rules) if stored else lookup_rows(register, rules), groups, KEY)
    # of the rows of a code only the last one is a member
    return met.where("only is null or (ord <=> only.ord and flight_id <=> only.flight_id)").select(
        _group_name(rule, [F.col(k) for k in KEY[2:]]).alias("match_group"), "ord", "flight_id", "date", _member_reason().alias("reason"))


def key_coverage(register: DataFrame) -> DataFrame:
    """Distinct keys per kind of lookup."""
    kinds = {
        "exact_key": ("_date", "_origin", "_dest", "_airline"), "confirmation": ("_code",),
        "route": ("_origin", "_dest"), "date": ("_date",), "airline": ("_airline",),
    }
    tags = tagged(
        ("kind", "key", "ok"),
        *[(F.lit(kind), F.concat_ws("\x01", *parts), _filled(*parts)) for kind, parts in kinds.items()],
    )
    keyed = with_keys(register).select(F.inline(tags)).where("ok")
    return keyed.groupBy("kind").agg(F.countDistinct("key").alias("distinct_keys"))


def status_counts(classified: DataFrame) -> DataFrame:
    """Candidates and their share per status, all four statuses present."""
    return _totals(classified, F.lit(1).cast("long"))


def _totals(rows: DataFrame, copies: Column) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counted = rows.agg(
        total(copies).alias("_all"), *[total(F.when(F.col("dedup_status") == s, copies)).alias(s) for s in STATUSES])
    share = lambda s: F.when(F.col("_all") == 0, F.lit(0.0)).otherwise(F.col(s) * 100.0 / F.col("_all"))
    pairs = tagged(("dedup_status", "n", "percent"), *[(F.lit(s), F.col(s), share(s)) for s in STATUSES])
    return counted.select(F.inline(pairs))


def net_new_breakdown(classified: DataFrame) -> DataFrame:
    """New candidates by year, airline and confidence, in one pass; all levels present."""
    new = classified.where("dedup_status = 'net_new'")
    named = lambda c: F.coalesce(present(c), F.lit("unknown"))
    year = F.when(F.trim("date_iso") != "", F.col("date_iso").substr(1, 4))
    names = ("kind", "value", "one")
    tags = tagged(
        names,
        (F.lit("year"), named(year), F.lit(1)),
        (F.lit("airline"), named(F.trim("airline")), F.lit(1)),
        (F.lit("confidence"), F.col("confidence"), F.lit(1)),
    )
    # A row of zeros per level keeps levels without candidates in the result.
    levels = tagged(names, *[(F.lit("confidence"), F.lit(v), F.lit(0)) for v in LEVELS])
    zeros = classified.sparkSession.range(1).select(F.inline(levels))
    return (
        new.select(F.inline(tags)).unionByName(zeros)
        .groupBy("kind", "value").agg(F.sum("one").alias("n"))
    )


_REVIEW = {
    "exact_duplicate": ("flight_id", "date_iso", "origin", "dest", "airline", "match_group", "match_count", "match_reason"),
    "near_match": (
        "flight_id", "date_iso", "origin", "dest", "airline", "confirmation_code",
        "match_group", "match_count", "match_reason", "confidence",
    ),
    "conflict": (
        "flight_id", "date_iso", "origin", "dest", "airline", "confirmation_code",
        "match_group", "match_count", "match_reason",
    ),
}
_REVIEW_NAMES = {
    "flight_id": "candidate_flight_id", "date_iso": "date", "match_reason": "reason",
}


def review(classified: DataFrame, status: str) -> DataFrame:
    """The rows of a status as text fields for review."""
    kinds = dict(classified.dtypes)
    return classified.where(F.col("dedup_status") == status).select(
        *[safe_text(F.col(c), kinds[c]).alias(_REVIEW_NAMES.get(c, c)) for c in _REVIEW[status]]
    )
