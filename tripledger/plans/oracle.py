"""The registered queries in DuckDB SQL over the same tables."""

from __future__ import annotations

from tripledger import vocabulary as V
from tripledger.plans import fixtures as D
from tripledger.plans.queries import CHAT_WORDS, KEY_EXTENSIONS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in table.items()) + "}"


def _holds(text: str, words) -> str:
    return f"(len(list_filter({_list(words)}, lambda w: contains(lower({text}), w))) > 0)"


def _score(words, *texts: str) -> str:
    test = " OR ".join(f"contains(lower({t}), w)" for t in texts)
    return f"len(list_filter({_list(words)}, lambda w: {test}))"


def _pick(values, index: str) -> str:
    return f"({_list(values)})[CAST({index} AS INTEGER) + 1]"


def _places(user: str, key: str) -> tuple[str, str]:
    return _pick(D.PLACES, f"{user} % 12"), _pick(D.PLACES, f"({user} % 12 + 1 + {key} % 11) % 12")


_O, _E = _places("u", "k")
_HEX = "'Q' || printf('%05X', {0})"

# ---------------------------------------------------------------- inputs

MESSAGES = f"""
mail_base AS (
  SELECT k, u, d, sent, flight, flight + 7 AS back, {_O} AS o, {_E} AS e
  FROM (
    SELECT k, u, d, CAST(d + CAST(later AS INTEGER) AS DATE) AS sent,
           CAST(d + CAST(later + k % 4 - 1 AS INTEGER) AS DATE) AS flight
    FROM (SELECT o_orderkey AS k, o_custkey AS u, CAST(o_orderdate AS DATE) AS d,
                 ((o_orderkey // 2) % 2) * 1826 AS later FROM orders))
),
messages AS (
  SELECT k AS msg_id, 'box' || (k % 3) || '.mbox' AS source_file,
    {_pick(D.SENDERS, "k % 8")} AS from_hdr,
    {_pick(D.SUBJECTS, "k % 5")} AS subject,
    CASE WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN 'not a date'
      ELSE day(sent) || ' ' || strftime(sent, '%b') || ' ' || year(sent) || ' 08:00:00 '
           || {_pick(("-0700", "+0000", "+0900"), "(k // 3) % 3")} END AS date_hdr,
    concat_ws('. ',
      CASE k % 4 WHEN 0 THEN 'Confirmation code: ' || {_HEX.format("k")}
        WHEN 1 THEN 'Your confirmation number is ABC123' WHEN 2 THEN 'We confirm that booking ref' ELSE 'Note' END,
      CASE (k // 4) % 4 WHEN 0 THEN o || '-' || e WHEN 1 THEN 'Depart ' || o || ' arrive ' || e
        WHEN 2 THEN 'Airports ' || o || ' then ' || e || ' THE SUN' ELSE 'ALL THE DAY' END,
      CASE WHEN (k // 16) % 2 = 0 THEN 'Flight AS ' || (k % 2000) ELSE 'No number' END,
      CASE k % 6 WHEN 0 THEN 'No fare' WHEN 1 THEN '$ 9.50' WHEN 2 THEN '$120.50' ELSE '$1,234.50 and $99' END,
      CASE (k // 5) % 5
        WHEN 0 THEN 'on ' || strftime(flight, '%B') || ' ' || day(flight) || ', ' || year(flight)
        WHEN 1 THEN 'on ' || month(flight) || '/' || day(flight) || '/' || year(flight)
                 || ' back ' || month(back) || '/' || day(back) || '/' || year(back)
        WHEN 2 THEN strftime(flight, '%Y-%m-%d') || ' and ' || strftime(back, '%Y-%m-%d')
        WHEN 3 THEN day(flight) || ' ' || strftime(flight, '%b') || ' ' || year(flight) || ', not 13/45/2024'
        ELSE 'no date' END,
      CASE WHEN k % 9 = 0 THEN {_q(D.WORK_TAIL)} ELSE 'seat and passenger details' END) AS body
  FROM mail_base
)"""

_WALL = "try_strptime(left(date_hdr, length(date_hdr) - 6), '%d %b %Y %H:%M:%S')"
HEADED = f"""
clocked AS (
  SELECT *, coalesce(nullif(lower(regexp_extract(from_hdr, '@([\\w.-]+)', 1)), ''), trim(lower(from_hdr))) AS domain,
    CASE WHEN length(date_hdr) > 12 THEN {_WALL} END AS wall, right(date_hdr, 5) AS zone
  FROM messages
),
headed AS (
  SELECT *, CASE WHEN trim(date_hdr) = '' THEN NULL
      WHEN wall IS NULL THEN trim(date_hdr)
      ELSE strftime(wall, '%Y-%m-%dT%H:%M:%S') || left(zone, 3) || ':' || right(zone, 2) END AS date
  FROM clocked
)"""
RELEVANT = f"""
relevant AS (
  SELECT * FROM headed WHERE {_holds("from_hdr", V.SENDER_WORDS)} OR {_holds("subject", V.SUBJECT_WORDS)}
)"""
_BOOKING = _holds("subject", V.BOOKING_SUBJECT_WORDS)
TIERED = f"""
tiered AS (
  SELECT *, CAST(CASE
    WHEN domain IN ({", ".join(map(_q, V.AIRLINE_BY_DOMAIN))}) OR {_holds("domain", V.AIRLINE_LABELS)} THEN 1
    WHEN domain IN ({", ".join(map(_q, V.AGENCY_DOMAINS))}) OR {_holds("domain", V.AGENCY_LABELS)} THEN
      CASE WHEN contains(domain, 'expedia') AND NOT {_BOOKING} THEN NULL ELSE 2 END
    WHEN {_BOOKING} AND {_holds("subject", V.AIRLINE_NAMES)} THEN 1 END AS BIGINT) AS extraction_tier
  FROM headed
)"""
READABLE = f"""
readable AS (
  SELECT * FROM tiered
  WHERE extraction_tier IS NOT NULL AND length(body) >= 20
    AND NOT (contains(domain, 'expedia')
      AND {_score(V.WORK_WORDS, "body", "subject")} > {_score(V.BOOKING_WORDS, "body")})
)"""


def _codes(valid_of: str) -> str:
    return f"list_contains(airports, {valid_of})"


_D1 = rf"\b{V.MONTH_NAME}\s+\d{{1,2}},?\s+\d{{4}}\b"
_D4 = rf"\b\d{{1,2}}\s+{V.MONTH_NAME}\s+\d{{4}}\b"


def _dates(pattern: str, formats: str, squeeze: bool = False) -> str:
    text = "regexp_replace(m, '[\\s,]+', ' ', 'g')" if squeeze else "m"
    return (
        f"list_transform(regexp_extract_all(body, {_q(pattern)}, 0, 'i'), "
        f"lambda m: CAST(try_strptime({text}, {formats}) AS DATE))"
    )


def fields(source: str) -> str:
    """Extracted fields of every row of a mail relation, as CTEs ending in ``found``."""
    return f"""
raw_fields AS (
  SELECT *, {_list(V.AIRPORTS)} AS airports,
    upper(coalesce(nullif(regexp_extract(body, {_q(V.LABELLED_CODE)}, 1, 'i'), ''),
                   nullif(regexp_extract(body, {_q(V.STEM_CODE)}, 1, 'i'), ''))) AS code,
    regexp_extract_all(body, {_q(V.ROUTE)}, 1) AS r1, regexp_extract_all(body, {_q(V.ROUTE)}, 2) AS r2,
    list_transform(regexp_extract_all(body, {_q(V.AIRPORT_IN_CONTEXT)}, 1, 'i'), lambda c: upper(c)) AS ctx,
    regexp_extract_all(body, {_q(V.AIRPORT_ALONE)}, 1) AS solo,
    nullif(regexp_extract(body, {_q(V.FLIGHT_NUMBER)}, 1), '') AS prefix,
    regexp_extract(body, {_q(V.FLIGHT_NUMBER)}, 2) AS digits,
    list_filter(list_transform(regexp_extract_all(body, {_q(V.FARE)}, 1),
      lambda m: try_cast(replace(m, ',', '') AS DOUBLE)), lambda v: v BETWEEN 10 AND 50000) AS amounts,
    list_filter(list_concat({_dates(_D1, "['%B %d %Y', '%b %d %Y']", True)},
      {_dates(r"\b\d{1,2}/\d{1,2}/\d{4}\b", "'%m/%d/%Y'")},
      {_dates(r"\b\d{4}-\d{2}-\d{2}\b", "'%Y-%m-%d'")},
      {_dates(_D4, "['%d %B %Y', '%d %b %Y']", True)}),
      lambda x: x IS NOT NULL AND year(x) BETWEEN 2000 AND 2030) AS days_all
  FROM {source}
),
narrowed AS (
  SELECT *, list_filter(range(1, len(r1) + 1), lambda i: {_codes("r1[i]")} AND {_codes("r2[i]")})[1] AS hit,
    list_filter(ctx, lambda c: {_codes("c")}) AS ctx_ok,
    list_filter(solo, lambda c: {_codes("c")}) AS solo_ok,
    list_filter(days_all, lambda x, i: list_position(days_all, x) = i) AS days,
    CAST(wall AS DATE) + CASE WHEN left(zone, 1) = '-' THEN 1 ELSE 0 END AS start
  FROM raw_fields
),
paired AS (
  SELECT *, CASE WHEN hit IS NOT NULL THEN [r1[hit], r2[hit]] WHEN len(ctx_ok) >= 2 THEN ctx_ok
      ELSE list_filter(solo_ok, lambda c, i: list_position(solo_ok, c) = i) END AS pair,
    CASE WHEN start IS NULL THEN days ELSE list_concat(
      list_sort(list_filter(days, lambda x: x >= start)), list_sort(list_filter(days, lambda x: x < start))) END AS dates
  FROM narrowed
),
found AS (
  SELECT *, pair[1] AS origin, pair[2] AS dest, prefix || digits AS number,
    CASE WHEN len(amounts) > 1 THEN list_min(amounts) END AS base_fare, list_max(amounts) AS total_paid,
    coalesce({_map(V.AIRLINE_BY_DOMAIN)}[domain], {_map(V.AIRLINE_BY_PREFIX)}[prefix],
      CASE {" ".join(f"WHEN {_holds('body', w)} THEN {_q(n)}" for n, w in V.AIRLINE_BY_PHRASE.items())} END) AS airline
  FROM paired
)"""


_ABROAD = (
    "(coalesce(origin NOT IN (SELECT unnest({0})), false) OR coalesce(dest NOT IN (SELECT unnest({0})), false))"
).format(_list(V.DOMESTIC_AIRPORTS))


def _w(name: str) -> str:
    return f"{V.WEIGHTS[name]}::DOUBLE"


LEGS = f"""
signalled AS (
  SELECT *, {_ABROAD} AS international FROM found
  WHERE code IS NOT NULL OR origin IS NOT NULL OR dest IS NOT NULL OR number IS NOT NULL
     OR airline IS NOT NULL OR coalesce(total_paid > 50, false)
),
legs AS (
  SELECT 0 AS leg, * , dates[1] AS dy FROM signalled
  UNION ALL
  SELECT 1 AS leg, * REPLACE (dest AS origin, origin AS dest), dates[2] AS dy FROM signalled
  WHERE extraction_tier = 2 AND origin IS NOT NULL AND dest IS NOT NULL AND len(dates) >= 2
),
scored AS (
  SELECT *, coalesce(strftime(dy, '%Y-%m-%d') || 'T00:00:00Z', strftime(wall, '%Y-%m-%dT%H:%M:%S') || 'Z', '') AS date_iso,
    least(CASE WHEN code IS NOT NULL THEN {_w("code")} ELSE 0::DOUBLE END
      + CASE WHEN origin IS NOT NULL AND dest IS NOT NULL THEN {_w("route")}
             WHEN origin IS NOT NULL OR dest IS NOT NULL THEN {_w("one_airport")} ELSE 0::DOUBLE END
      + CASE WHEN airline IS NOT NULL THEN {_w("airline")} ELSE 0::DOUBLE END
      + CASE WHEN number IS NOT NULL THEN {_w("flight_number")} ELSE 0::DOUBLE END
      + CASE WHEN total_paid IS NOT NULL OR base_fare IS NOT NULL THEN {_w("fare")} ELSE 0::DOUBLE END
      + CASE WHEN dy IS NOT NULL THEN {_w("body_date")} ELSE 0::DOUBLE END, 1::DOUBLE) AS extraction_confidence
  FROM legs
),
extracted AS (
  SELECT msg_id, leg,
    left(sha256(coalesce(origin, 'UNK') || '#' || coalesce(dest, 'UNK') || '#' || date_iso || '#' || coalesce(code, 'NONE')), 12) AS flight_id,
    date_iso, left(date_iso, 7) AS date_yyyy_mm, coalesce(origin, '') AS origin, coalesce(dest, '') AS dest,
    coalesce(airline, '') AS airline, '' AS booked_class, coalesce(code, '') AS confirmation_code,
    coalesce(number, '') AS flight_number, base_fare, total_paid, coalesce(dest, '') AS trip_city, '' AS cost_type,
    international, CAST(NULL AS DOUBLE) AS eqm_miles, 'candidate' AS status, left(date_iso, 4) AS source_year,
    replace(source_file, '.mbox', '') AS source_sheet, domain AS website, '' AS funding_source, '' AS funding_date,
    '' AS sequence, {_q(D.AS_OF)} AS created_at, {_q(D.AS_OF)} AS updated_at, extraction_confidence, extraction_tier,
    source_file, subject AS source_email_subject,
    CASE WHEN wall IS NULL THEN '' ELSE date END AS source_email_date
  FROM scored
),
candidates AS (
  SELECT * EXCLUDE (msg_id, leg) FROM extracted
  QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY extraction_confidence DESC, msg_id, leg) = 1
)"""

BOOKED = """
booked AS (
  SELECT o_orderkey AS k, o_custkey AS u, CAST(o_orderdate AS DATE) AS d, o_orderdate, o_totalprice, o_orderstatus,
         o_orderpriority, c_mktsegment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""
REGISTER = f"""
register AS (
  SELECT k AS ord, 'R' || k AS flight_id, strftime(d, '%Y-%m-%d') || 'T00:00:00Z' AS date_iso,
    strftime(d, '%Y-%m') AS date_yyyy_mm, {_O} AS origin, {_E} AS dest,
    CASE WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE 'active' END AS status,
    {_q(D.AS_OF)} AS created_at, {_q(D.AS_OF)} AS updated_at, o_orderstatus AS cost_type, {_E} AS trip_city,
    c_mktsegment AS airline, o_orderpriority AS booked_class, CAST(NULL AS VARCHAR) AS funding_source,
    CASE WHEN (k // 2) % 2 = 0 THEN {_HEX.format("CASE WHEN k % 28 = 0 THEN k + 4 ELSE k END")} ELSE '' END AS confirmation_code,
    CAST(NULL AS VARCHAR) AS flight_number, CAST(NULL AS VARCHAR) AS website, CAST(NULL AS VARCHAR) AS cancelled_at,
    k % 2 = 0 AS international, CAST(NULL AS DOUBLE) AS eqm_miles, CAST(NULL AS DOUBLE) AS base_fare,
    CAST(NULL AS DOUBLE) AS extra_fees, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_paid,
    CAST(NULL AS DOUBLE) AS sequence
  FROM booked
)"""
CANDIDATE = """
candidate AS (
  SELECT 'C' || ord AS flight_id,
    CASE WHEN ord % 10 = 7 THEN '' ELSE strftime(CAST(left(date_iso, 10) AS DATE)
      + CASE ord % 10 WHEN 3 THEN 1 WHEN 5 THEN -1 WHEN 6 THEN 4000 ELSE 0 END, '%Y-%m-%d') || 'T00:00:00Z' END AS date_iso,
    CASE WHEN ord % 10 IN (4, 5) THEN '' ELSE lower(origin) END AS origin,
    CASE ord % 10 WHEN 1 THEN 'ZZZ' WHEN 9 THEN '' ELSE ' ' || dest END AS dest,
    CASE WHEN ord % 10 IN (8, 9) THEN '' ELSE upper(airline) END AS airline,
    CASE WHEN ord % 10 IN (0, 1) THEN confirmation_code ELSE '' END AS confirmation_code
  FROM register
)"""
SIDES = """
c AS (
  SELECT *, upper(trim(confirmation_code)) AS cc, left(trim(date_iso), 10) AS dk, upper(trim(origin)) AS ok,
    upper(trim(dest)) AS ek, lower(trim(airline)) AS ak, try_cast(left(trim(date_iso), 10) AS DATE) AS dd FROM candidate
),
r AS (
  SELECT ord, flight_id, upper(trim(confirmation_code)) AS cc, left(trim(date_iso), 10) AS dk, upper(trim(origin)) AS ok,
    upper(trim(dest)) AS ek, lower(trim(airline)) AS ak, try_cast(left(trim(date_iso), 10) AS DATE) AS dd FROM register
),
diffs AS (
  SELECT c.flight_id, r.ord, r.flight_id AS rid, r.dk AS rdk, c.cc, concat_ws('; ',
      CASE WHEN c.ok <> '' AND r.ok <> '' AND c.ok <> r.ok THEN 'origin: ' || c.ok || ' vs ' || r.ok END,
      CASE WHEN c.ek <> '' AND r.ek <> '' AND c.ek <> r.ek THEN 'dest: ' || c.ek || ' vs ' || r.ek END,
      CASE WHEN c.dk <> '' AND r.dk <> '' AND c.dk <> r.dk THEN 'date: ' || c.dk || ' vs ' || r.dk END) AS diff
  FROM c JOIN (SELECT * FROM r WHERE cc <> '' QUALIFY row_number() OVER (PARTITION BY cc ORDER BY ord DESC) = 1) r
    ON c.cc = r.cc
),
pairs AS (
  SELECT 2 AS rule, c.flight_id, r.ord, r.flight_id AS rid, r.dk AS rdk, 'date+origin+dest+airline match' AS why,
    ['2', c.dk, c.ok, c.ek, c.ak] AS grp
  FROM c JOIN r ON c.dk = r.dk AND c.ok = r.ok AND c.ek = r.ek AND c.ak = r.ak
  WHERE c.dk <> '' AND c.ok <> '' AND c.ek <> '' AND c.ak <> ''
  UNION ALL
  SELECT 3, c.flight_id, r.ord, r.flight_id, r.dk, 'same route ' || c.ok || '-' || c.ek || ' +/-1 day (candidate: ' || c.dk
    || ', existing: ' || r.dk || ')', ['3', c.ok, c.ek, c.dk, '']
  FROM c JOIN r ON c.ok = r.ok AND c.ek = r.ek AND abs(c.dd - r.dd) = 1 WHERE c.ok <> '' AND c.ek <> ''
  UNION ALL
  SELECT 4, c.flight_id, r.ord, r.flight_id, r.dk, 'date+airline match (' || c.dk || ', ' || c.ak || ') [candidate missing origin/dest]',
    ['4', c.ak, c.dk, '', '']
  FROM c JOIN r ON c.ak = r.ak AND c.dk = r.dk WHERE c.ak <> '' AND c.dk <> '' AND (c.ok = '' OR c.ek = '')
  UNION ALL
  SELECT 5, c.flight_id, r.ord, r.flight_id, r.dk, 'date+airline near match (' || c.dk || ' vs ' || r.dk || ', ' || c.ak
    || ') [candidate missing origin/dest, +/-1 day]', ['5', c.ak, c.dk, '', '']
  FROM c JOIN r ON c.ak = r.ak AND abs(c.dd - r.dd) = 1 WHERE c.ak <> '' AND (c.ok = '' OR c.ek = '')
),
hits AS (
  SELECT 1 AS rule, flight_id,
    CASE WHEN diff = '' THEN 'confirmation_code exact match (' || cc || ')'
      ELSE 'confirmation_code match (' || cc || ') but fields differ: ' || diff END AS why,
    CASE WHEN diff = '' THEN 'exact_duplicate' ELSE 'conflict' END AS status, 1 AS n, CAST(to_json(['1', cc, '', '', '']) AS VARCHAR) AS grp
  FROM diffs
  UNION ALL
  SELECT rule, flight_id,
    CASE rule WHEN 2 THEN any_value(why)
      WHEN 3 THEN 'same route ' || any_value(grp)[2] || '-' || any_value(grp)[3] || ' +/-1 day (candidate: ' || any_value(grp)[4] || ', existing: ' || count(*) || ' rows)'
      WHEN 4 THEN any_value(why)
      ELSE 'date+airline near match (' || any_value(grp)[3] || ', ' || any_value(grp)[2] || ') [candidate missing origin/dest, +/-1 day]' END,
    CASE WHEN rule = 2 THEN 'exact_duplicate' ELSE 'near_match' END, count(*), CAST(to_json(any_value(grp)) AS VARCHAR)
  FROM pairs GROUP BY rule, flight_id
),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY rule) = 1),
classified AS (
  SELECT c.* EXCLUDE (cc, dk, ok, ek, ak, dd), coalesce(best.status, 'net_new') AS dedup_status,
    coalesce(grp, '') AS match_group, CAST(coalesce(n, 0) AS BIGINT) AS match_count, coalesce(why, '') AS match_reason,
    CASE WHEN rule <= 2 THEN 'high' WHEN rule = 3 THEN 'medium' WHEN rule >= 4 THEN 'low'
      WHEN ok <> '' AND ek <> '' AND dk <> '' THEN 'high' WHEN dk <> '' THEN 'medium' ELSE 'low' END AS confidence,
    rule
  FROM c LEFT JOIN best USING (flight_id)
)"""

_S, _T = _pick(D.PLACES, "user_id % 12"), _pick(D.PLACES, "(user_id + 1) % 12")
CHANGES = f"""
ev AS (
  SELECT event_id AS ord, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS dy, {_S} AS s, {_T} AS t,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp
  FROM events
),
log AS (
  SELECT *, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'cancel' ELSE 'update' END AS op,
    left(sha256(dy || 'T00:00:00Z|' || s || '|' || t || '|0|0'), 12) AS made,
    CASE WHEN ord % 13 = 0 THEN 'soon' ELSE dy END AS c_date, CASE WHEN ord % 5 = 0 THEN '' ELSE s END AS c_origin,
    CASE WHEN ord % 11 = 0 THEN 'R999999999'
         WHEN ord % 7 = 0 THEN left(sha256(dy || 'T00:00:00Z|' || s || '|' || t || '|0|0'), 12)
         ELSE 'R' || (user_id * 10 + ord % 10) END AS key,
    CASE event_type WHEN 'view' THEN (CASE WHEN ord % 2 = 0 THEN 'site' ELSE 'airline' END)
      WHEN 'purchase' THEN 'fare' WHEN 'click' THEN 'status' END AS kind
  FROM ev
)"""


def changes(ops: str) -> str:
    """CTEs that apply the change rows of some operations: ``changed`` and ``rejects``."""
    mutable = ", ".join(sorted(V.MUTABLE_FIELDS))
    return f"""
todo AS (SELECT * FROM log WHERE op IN ({ops})),
okay AS (SELECT * FROM todo WHERE op = 'create' AND c_origin <> '' AND c_date <> 'soon'),
firsts AS (
  SELECT * FROM okay WHERE made NOT IN (SELECT flight_id FROM register)
  QUALIFY row_number() OVER (PARTITION BY made ORDER BY ord) = 1
),
base AS (
  SELECT * EXCLUDE (ord), CAST(-1 AS BIGINT) AS since FROM register
  UNION ALL BY NAME
  SELECT made AS flight_id, dy || 'T00:00:00Z' AS date_iso, left(dy, 7) AS date_yyyy_mm, s AS origin, t AS dest,
    'active' AS status, stamp AS created_at, stamp AS updated_at, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS total_paid,
    ord AS since FROM firsts
),
placed AS (
  SELECT todo.*, base.flight_id IS NOT NULL AS found FROM todo LEFT JOIN base ON key = base.flight_id AND todo.ord > since
  WHERE op = 'cancel' OR kind IN ('site', 'fare')
),
edits AS (
  SELECT key, arg_max(CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE), ord) FILTER (kind = 'fare') AS fare,
    arg_max('site' || (ord % 5), ord) FILTER (kind = 'site') AS site, arg_max(t, ord) FILTER (kind = 'site') AS city,
    max(ord) FILTER (op = 'update') AS u_ord, arg_max(stamp, ord) FILTER (op = 'update') AS u_at,
    min(ord) FILTER (op = 'cancel') AS c_ord, arg_min(stamp, ord) FILTER (op = 'cancel') AS c_at
  FROM placed WHERE found GROUP BY key
),
merged AS (
  SELECT base.* REPLACE (
      CASE WHEN c_ord IS NOT NULL THEN 'cancelled' ELSE status END AS status,
      CASE WHEN c_ord IS NOT NULL AND status <> 'cancelled' THEN c_at ELSE cancelled_at END AS cancelled_at,
      CASE WHEN c_ord IS NOT NULL AND status <> 'cancelled' AND (u_ord IS NULL OR c_ord > u_ord) THEN c_at
           WHEN u_ord IS NOT NULL THEN u_at ELSE updated_at END AS updated_at,
      coalesce(fare, total_paid) AS total_paid, coalesce(site, website) AS website, coalesce(city, trip_city) AS trip_city),
    since >= 0 OR u_ord IS NOT NULL OR (c_ord IS NOT NULL AND status <> 'cancelled') AS moved
  FROM base LEFT JOIN edits ON base.flight_id = edits.key
),
changed AS (SELECT * EXCLUDE (since, moved) FROM merged WHERE moved),
rejects AS (
  SELECT ord, 'create' AS op, '' AS flight_id, CASE WHEN c_origin = '' THEN 'missing_param' ELSE 'invalid_date' END AS code,
    CASE WHEN c_origin = '' THEN 'Required field(s) missing: origin'
      ELSE 'Invalid date format: soon. Use ISO 8601 (e.g. 2025-06-15).' END AS message
  FROM todo WHERE op = 'create' AND (c_origin = '' OR c_date = 'soon')
  UNION ALL
  SELECT ord, 'create', made, 'duplicate', 'Flight ' || made
    || ' already exists (same date/origin/dest/sequence). Use update_flight to modify it.'
  FROM okay WHERE ord NOT IN (SELECT ord FROM firsts)
  UNION ALL
  SELECT ord, op, key, 'immutable_field', 'Cannot modify immutable field(s): status' FROM todo WHERE kind = 'status'
  UNION ALL
  SELECT ord, op, key, 'unknown_field', 'Unknown field(s): airline. Mutable fields: {mutable}' FROM todo WHERE kind = 'airline'
  UNION ALL
  SELECT ord, op, key, 'not_found', 'Flight ' || key || ' not found' FROM placed WHERE NOT found
)"""


SEEDED = f"""
seed AS (
  SELECT k AS ord, CASE WHEN k % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS date_iso,
    {_O} AS origin, {_E} AS dest, CASE WHEN k % 3 <> 0 THEN CAST(k % 3 AS DOUBLE) END AS sequence,
    c_mktsegment AS airline, k % 2 = 0 AS international, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_paid,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS booked_on
  FROM booked
),
seeded AS (
  SELECT * EXCLUDE (ord), left(sha256(concat_ws('|', date_iso, origin, dest, coalesce(CAST(sequence AS VARCHAR), '0'),
      row_number() OVER (PARTITION BY date_iso, origin, dest, sequence ORDER BY ord) - 1)), 12) AS flight_id,
    left(date_iso, 7) AS date_yyyy_mm, 'active' AS status, {_q(D.AS_OF)} AS created_at, {_q(D.AS_OF)} AS updated_at
  FROM seed
)"""

_KEYS = f"""
keys AS (
  SELECT regexp_replace(url, '[?#].*', '') || {_pick(KEY_EXTENSIONS, f"page_id % {len(KEY_EXTENSIONS)}")} AS path,
    CAST(length(html) AS BIGINT) AS size_bytes FROM pages
),
listing AS (
  SELECT *, CASE WHEN lower(path) LIKE '%.mbox' THEN 'mbox' WHEN lower(path) LIKE '%.csv' THEN 'csv'
    WHEN lower(path) LIKE '%.json' THEN 'json' WHEN lower(path) LIKE '%.gz' THEN 'gzip' ELSE 'unknown' END AS format
  FROM keys
)"""

_PAGE = """
page AS (
  SELECT flight_id, date_iso, origin, dest, trip_city, airline, status, total_paid, booked_class, cost_type FROM register
  WHERE date_iso >= '1996-01-01' AND date_iso <= '2000-12-31T23:59:59Z' AND airline = 'BUILDING' AND status = 'active'
    AND international
),
page1 AS (SELECT * FROM page ORDER BY flight_id LIMIT 50)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _mail(select: str, *more: str) -> str:
    return _with(MESSAGES, HEADED, *more, select=select)


def _found(select: str) -> str:
    return _mail(select, fields("headed"))


def _run(select: str) -> str:
    return _mail(select, TIERED, READABLE, fields("readable"), LEGS)


def _sides(select: str) -> str:
    return _with(BOOKED, REGISTER, CANDIDATE, SIDES, select=select)


def _change(select: str, ops: str = "'create', 'update', 'cancel'") -> str:
    return _with(BOOKED, REGISTER, CHANGES, changes(ops), select=select)


def _html(column: str) -> str:
    tags = "br|p|div|tr|li|h1|h2|h3|h4"
    steps = (
        (r"<!--.*?-->", "", "gs"), (r"<script\b[^>]*>.*?</script\s*>", "", "gis"),
        (r"<style\b[^>]*>.*?</style\s*>", "", "gis"), (rf"</(?:{tags})\s*>|<(?:{tags})(?:\s[^>]*)?/>", " ", "gi"),
        (r"<[^>]+>", "", "g"),
    )
    text = column
    for pattern, put, flags in steps:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(put)}, '{flags}')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
                       ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, {_q(name)}, {_q(char)})"
    return f"trim(regexp_replace({text}, '[\\s\xa0]+', ' ', 'g'))"


def _chat() -> str:
    per_word = " UNION ALL ".join(
        f"SELECT {_q(w)} AS keyword, count(*) FILTER (contains(txt, {_q(w)})) AS n, count(*) AS total_rows, "
        f"count(*) FILTER ({_holds('txt', CHAT_WORDS)}) AS matched_rows FROM chat"
        for w in CHAT_WORDS
    )
    return "WITH chat AS (SELECT lower(concat_ws(' ', conv_id, turn, role, text)) AS txt FROM conversations) " + per_word


def _review(status: str, extra: str = "") -> str:
    return _sides(
        f"SELECT flight_id AS candidate_flight_id, date_iso AS date, origin, dest, airline, {extra} "
        f"match_group, CAST(match_count AS VARCHAR) AS match_count, match_reason AS reason FROM classified WHERE dedup_status = '{status}'"
    )


def _matched(rule: int) -> str:
    level = "'high'" if rule <= 2 else "'medium'" if rule == 3 else "'low'"
    return _sides(
        f"SELECT flight_id, status AS dedup_status, grp AS match_group, CAST(n AS BIGINT) AS match_count, why AS match_reason, {level} AS confidence "
        f"FROM hits WHERE rule = {rule}"
    )


_STATS = (
    "SELECT t.*, coalesce(signal_emails, 0) AS signal_emails, coalesce(records_extracted, 0) AS records_extracted FROM "
    "(SELECT source_file, count(*) AS total_emails, count(*) FILTER (extraction_tier IS NULL) AS header_filtered, "
    "CAST(0 AS BIGINT) AS errors FROM tiered GROUP BY source_file) t LEFT JOIN (SELECT source_file, "
    "count(*) FILTER (leg = 0) AS signal_emails, count(*) AS records_extracted FROM extracted GROUP BY source_file) e "
    "USING (source_file)"
)


def all_oracles() -> dict[str, str]:
    cls = "SELECT * EXCLUDE (rule) FROM classified"
    counts = " UNION ALL ".join(
        f"SELECT '{s}' AS dedup_status, count(*) FILTER (dedup_status = '{s}') AS n, "
        f"count(*) FILTER (dedup_status = '{s}') * 100.0::DOUBLE / count(*) AS percent FROM classified"
        for s in ("net_new", "exact_duplicate", "near_match", "conflict")
    )
    complete = " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER (CAST({f} AS VARCHAR) <> '') AS filled, "
        f"printf('%.1f%%', 100.0::DOUBLE * count(*) FILTER (CAST({f} AS VARCHAR) <> '') / count(*)) AS share FROM candidates"
        for f in ("confirmation_code", "origin", "dest", "airline", "flight_number", "base_fare", "total_paid", "date_iso")
    )
    cols = "flight_id, status, cancelled_at, updated_at"
    page2 = _with(
        BOOKED, REGISTER, _PAGE,
        select="SELECT * FROM page WHERE flight_id > (SELECT max(flight_id) FROM page1) AND (SELECT count(*) FROM page1) = 50 "
        "ORDER BY flight_id LIMIT 50")
    ids = "(SELECT DISTINCT key FROM log WHERE op = 'cancel')"
    return {
        "sender_catalog": _mail(
            "SELECT domain AS sender_domain, count(*) AS mails, min(date) AS first_date, max(date) AS last_date "
            "FROM relevant GROUP BY domain", RELEVANT),
        "subject_patterns": _mail(
            f"SELECT pattern, count(*) AS mails FROM (SELECT unnest(list_filter({_list(V.SUBJECT_WORDS)}, "
            "lambda w: contains(lower(subject), w))) AS pattern FROM relevant) GROUP BY pattern", RELEVANT),
        "corpus_date_range": _mail(
            "SELECT count(*) AS relevant_mails, min(date) AS earliest, max(date) AS latest, "
            "count(DISTINCT left(date, 10)) AS estimated_unique FROM relevant", RELEVANT),
        "catalog_entries": _mail(
            "SELECT domain AS sender_domain, subject, date, source_file FROM relevant", RELEVANT),
        "file_stats": _mail(
            f"SELECT source_file, count(*) AS total_messages, count(*) FILTER ({_holds('from_hdr', V.SENDER_WORDS)} OR "
            f"{_holds('subject', V.SUBJECT_WORDS)}) AS relevant_count FROM headed GROUP BY source_file"),
        "keyword_frequency": _chat(),
        "csv_chat": _chat(),
        "csv_profile_rows": "SELECT 'conv_id,turn,role,text' AS columns, count(*) AS row_count FROM conversations",
        "format_inventory": _with(
            _KEYS, select="SELECT format, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM listing GROUP BY format"),
        "file_inventory": _with(
            _KEYS, select="SELECT path, size_bytes, format, count(*) OVER w AS total_messages, "
            "count(*) FILTER (format = 'mbox') OVER w AS relevant_count FROM listing "
            "WINDOW w AS (PARTITION BY path)"),
        "corpus_totals": _with(
            _KEYS, select="SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM keys"),
        "page_text": f"SELECT page_id, {_html('html')} AS text FROM pages",
        "mail_dates": _mail("SELECT msg_id, domain, date FROM headed"),
        "tier_classification": _mail("SELECT msg_id, domain, extraction_tier FROM tiered", TIERED),
        "work_mail_filter": _mail("SELECT msg_id, domain, extraction_tier FROM readable", TIERED, READABLE),
        "confirmation_codes": _found("SELECT msg_id, code FROM found"),
        "airports": _found(f"SELECT msg_id, origin, dest, {_ABROAD} AS international FROM found"),
        "flight_numbers": _found("SELECT msg_id, number, airline FROM found"),
        "fares": _found("SELECT msg_id, base_fare, total_paid FROM found"),
        "flight_dates": _found(
            "SELECT msg_id, coalesce(array_to_string(list_transform(dates, lambda x: strftime(x, '%Y-%m-%d')), ','), '') AS dates FROM found"),
        "normalized_keys": _sides(
            "SELECT flight_id, cc AS code, dk AS date, ok AS origin, ek AS dest, ak AS airline, strftime(dd, '%Y-%m-%d') AS day FROM c"),
        "candidates": _run("SELECT * FROM candidates"),
        "write_candidate_rows": _run("SELECT * FROM candidates"),
        "candidate_table": _run("SELECT airline, count(*) AS n FROM candidates GROUP BY airline"),
        "confidence_buckets": _run(
            "SELECT count(*) FILTER (extraction_confidence >= 0.7::DOUBLE) AS high, count(*) FILTER (extraction_confidence >= 0.4::DOUBLE "
            "AND extraction_confidence < 0.7::DOUBLE) AS medium, count(*) FILTER (extraction_confidence < 0.4::DOUBLE) AS low FROM candidates"),
        "field_completeness": _run(complete),
        "candidate_counts": _run(
            "SELECT 'source_file' AS kind, source_file AS value, count(*) AS n FROM candidates GROUP BY 2 UNION ALL "
            "SELECT 'airline', coalesce(nullif(airline, ''), '(unknown)'), count(*) FROM candidates GROUP BY 2 UNION ALL "
            "SELECT 'year', source_year, count(*) FROM candidates WHERE source_year <> '' GROUP BY 2 UNION ALL "
            "SELECT 'international', 'true', count(*) FROM candidates WHERE international HAVING count(*) > 0"),
        "extraction_stats": _run(_STATS),
        "run_totals": _run(
            "SELECT count(*) AS files, CAST(sum(total_emails) AS BIGINT) AS total_emails, CAST(sum(header_filtered) AS BIGINT) AS header_filtered, "
            "CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(signal_emails) AS BIGINT) AS signal_emails, "
            f"CAST(sum(records_extracted) AS BIGINT) AS records_extracted FROM ({_STATS})"),
        "id_counts": _run(
            "SELECT count(*) AS records, count(DISTINCT flight_id) AS unique_ids, count(*) - count(DISTINCT flight_id) AS duplicate_ids FROM extracted"),
        "match_confirmation": _matched(1),
        "match_composite": _matched(2),
        "match_route_band": _matched(3),
        "match_airline_day": _matched(4),
        "match_airline_band": _matched(5),
        "classify_candidates": _sides(cls),
        "classify_bucketed": _sides(cls),
        "status_counts": _sides(counts),
        "net_new_breakdown": _sides(
            "SELECT kind, value, CAST(sum(one) AS BIGINT) AS n FROM ("
            "SELECT 'year' AS kind, CASE WHEN date_iso = '' THEN 'unknown' ELSE left(date_iso, 4) END AS value, 1 AS one FROM classified WHERE dedup_status = 'net_new' "
            "UNION ALL SELECT 'airline', coalesce(nullif(trim(airline), ''), 'unknown'), 1 FROM classified WHERE dedup_status = 'net_new' "
            "UNION ALL SELECT 'confidence', confidence, 1 FROM classified WHERE dedup_status = 'net_new' "
            "UNION ALL SELECT 'confidence', unnest(['high', 'medium', 'low']), 0) GROUP BY kind, value"),
        "review_duplicates": _review("exact_duplicate"),
        "review_near_matches": _review("near_match", "confirmation_code, confidence,"),
        "review_conflicts": _review("conflict", "confirmation_code,"),
        "key_coverage": _sides(
            "SELECT 'exact_key' AS kind, count(DISTINCT (dk, ok, ek, ak)) AS distinct_keys FROM r WHERE dk <> '' AND ok <> '' AND ek <> '' AND ak <> '' "
            "UNION ALL SELECT 'confirmation', count(DISTINCT cc) FROM r WHERE cc <> '' "
            "UNION ALL SELECT 'route', count(DISTINCT (ok, ek)) FROM r WHERE ok <> '' AND ek <> '' "
            "UNION ALL SELECT 'date', count(DISTINCT dk) FROM r WHERE dk <> '' "
            "UNION ALL SELECT 'airline', count(DISTINCT ak) FROM r WHERE ak <> ''"),
        "match_members": _sides(
            "SELECT DISTINCT CAST(to_json(p.grp) AS VARCHAR) AS match_group, p.ord, p.rid AS flight_id, p.rdk AS date, p.why AS reason "
            "FROM pairs p JOIN best b ON p.flight_id = b.flight_id AND p.rule = b.rule "
            "UNION ALL SELECT DISTINCT CAST(to_json(['1', cc, '', '', '']) AS VARCHAR), ord, rid, rdk, 'confirmation_code match (' || cc || ')' FROM diffs"),
        "register_seed": _with(BOOKED, SEEDED, select="SELECT * FROM seeded"),
        "load_check": _with(
            BOOKED, SEEDED, select="SELECT (SELECT count(*) FROM booked) AS expected, count(DISTINCT flight_id) AS actual, "
            "count(DISTINCT flight_id) = (SELECT count(*) FROM booked) AS ok FROM seeded"),
        "preview": _with(
            BOOKED, SEEDED, select="SELECT flight_id, date_iso, origin, dest, airline FROM seeded ORDER BY flight_id LIMIT 5"),
        "search_register": _with(BOOKED, REGISTER, _PAGE, select="SELECT * FROM page1"),
        "search_page2": page2,
        "search_stored_page2": page2,
        "search_cursor": _with(
            BOOKED, REGISTER, _PAGE,
            select="SELECT count(*) AS count, CASE WHEN count(*) >= 50 THEN base64(encode('{\"flight_id\":\"' || max(flight_id) || '\"}')) END "
            "AS next_token FROM page1"),
        "get_rows": _with(
            BOOKED, REGISTER, CHANGES, select=f"SELECT * EXCLUDE (ord) FROM register WHERE flight_id IN {ids}"),
        "get_misses": _with(
            BOOKED, REGISTER, CHANGES,
            select=f"SELECT key AS flight_id, 'not_found' AS code, 'Flight ' || key || ' not found' AS message FROM {ids} "
            "WHERE key NOT IN (SELECT flight_id FROM register)"),
        "create_rows": _change("SELECT * FROM changed", "'create'"),
        "create_rejects": _change("SELECT * FROM rejects", "'create'"),
        "update_rows": _change("SELECT * FROM changed", "'update'"),
        "update_rejects": _change("SELECT * FROM rejects", "'update'"),
        "cancel_rows": _with(
            BOOKED, REGISTER, CHANGES,
            select=f"SELECT flight_id, 'cancelled' AS status, {_q(D.AS_OF)} AS cancelled_at, {_q(D.AS_OF)} AS updated_at "
            f"FROM register WHERE status <> 'cancelled' AND flight_id IN {ids}"),
        "apply_changes": _change("SELECT * EXCLUDE (since, moved) FROM merged"),
        "stream_changes": _change("SELECT * EXCLUDE (since, moved) FROM merged"),
        "stream_redelivered": _change("SELECT * EXCLUDE (since, moved) FROM merged"),
        "change_rejects": _change("SELECT * FROM rejects"),
        "upsert_latest": _with(
            BOOKED, REGISTER, CHANGES,
            select="SELECT coalesce(w.key, r.flight_id) AS flight_id, coalesce(w.status, r.status) AS status, "
            "coalesce(w.stamp, r.updated_at) AS updated_at, CASE WHEN w.key IS NULL THEN r.origin END AS origin FROM register r "
            "FULL JOIN (SELECT key, 'written' AS status, arg_max(stamp, ord) AS stamp FROM log WHERE op = 'update' GROUP BY key) w "
            "ON w.key = r.flight_id"),
        "mailbox_scan": _mail("SELECT msg_id, from_hdr, subject, date_hdr FROM messages"),
        "mail_bodies": _mail(
            "SELECT msg_id, extraction_tier, body, CAST(NULL AS VARCHAR) AS error FROM tiered WHERE extraction_tier IS NOT NULL", TIERED),
        "reconciled_rows": _sides(cls),
        "report_section": _sides(counts),
        "scan_skips_missing": _mail("SELECT msg_id, subject FROM headed"),
        "register_decimals": _with(BOOKED, REGISTER, select="SELECT flight_id, total_paid FROM register"),
    }
