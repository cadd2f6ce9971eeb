"""The registered queries: every operator over the driver tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions import fields as X
from tripledger.functions import normalize as N
from tripledger.functions.html import html_to_text
from tripledger.functions.mail import mail_clock, mail_date, sender_domain
from tripledger.functions.text import infer_format
from tripledger.operators import catalogs as C
from tripledger.operators import extraction as E
from tripledger.operators import reconcile as R
from tripledger.operators import register as G
from tripledger.plans import fixtures as D
from tripledger.session import scratch_dir
from tripledger.sources.files import base_name, list_files
from tripledger.sources.mailbox import named, scan_headers, scan_messages, with_bodies
from tripledger.sources.tables import csv_profile, decimals_to_double, read_csv_text, read_register
from tripledger.sources.writers import register_bucketed, register_table, write_candidates, write_clustered, write_report, write_rows
from tripledger.streaming.changes import apply_change_stream, current_register, delivered_once, start_store
from tripledger.vocabulary import PAGE_LIMIT

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}
CHAT_WORDS = ("flight", "gate", "plane", "que", "nicht", "the", "landed")
KEY_EXTENSIONS = (".mbox", ".CSV", ".json", ".tar.gz", ".txt", ".Mbox")


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    _ALL[fn.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_ALL)


# ---------------------------------------------------------------- inventory

def _relevant(spark, sf_dir):
    return C.relevant_mails(D.messages(spark, sf_dir))


@query
def sender_catalog(spark, sf_dir):
    return C.sender_catalog(_relevant(spark, sf_dir))


@query
def subject_patterns(spark, sf_dir):
    return C.subject_patterns(_relevant(spark, sf_dir))


@query
def corpus_date_range(spark, sf_dir):
    return C.date_summary(_relevant(spark, sf_dir))


@query
def catalog_entries(spark, sf_dir):
    return C.catalog_entries(_relevant(spark, sf_dir))


@query
def file_stats(spark, sf_dir):
    return C.file_stats(D.messages(spark, sf_dir))


@query
def keyword_frequency(spark, sf_dir):
    return C.keyword_frequency(D.table(spark, sf_dir, "conversations"), CHAT_WORDS)


def _keys(spark, sf_dir):
    """Page addresses as object keys with a file suffix."""
    bare = F.regexp_replace("url", "[?#].*", "")
    suffix = F.get(F.array(*[F.lit(e) for e in KEY_EXTENSIONS]), (F.col("page_id") % len(KEY_EXTENSIONS)).cast("int"))
    return D.table(spark, sf_dir, "pages").select(
        F.concat(bare, suffix).alias("path"), F.length("html").cast("long").alias("size_bytes")
    )


@query
def format_inventory(spark, sf_dir):
    return C.format_counts(_keys(spark, sf_dir).withColumn("format", infer_format(F.col("path"))))


@query
def file_inventory(spark, sf_dir):
    listing = _keys(spark, sf_dir).withColumn("format", infer_format(F.col("path")))
    counted = listing.groupBy(F.col("path").alias("source_path")).agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(F.col("format") == "mbox").alias("relevant_count")
    )
    return C.file_inventory(listing, counted)


@query
def corpus_totals(spark, sf_dir):
    return C.corpus_totals(_keys(spark, sf_dir))


# ---------------------------------------------------------------- parsing

@query
def page_text(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@query
def mail_dates(spark, sf_dir):
    return D.messages(spark, sf_dir).select(
        "msg_id", sender_domain(F.col("from_hdr")).alias("domain"), mail_date(F.col("date_hdr")).alias("date")
    )


@query
def tier_classification(spark, sf_dir):
    return E.classified(D.messages(spark, sf_dir)).select("msg_id", "domain", "extraction_tier")


@query
def work_mail_filter(spark, sf_dir):
    return E.readable(E.booking_mails(D.messages(spark, sf_dir))).select("msg_id", "domain", "extraction_tier")


@query
def confirmation_codes(spark, sf_dir):
    return D.messages(spark, sf_dir).select("msg_id", X.confirmation_code(F.col("body")).alias("code"))


@query
def airports(spark, sf_dir):
    found = D.messages(spark, sf_dir).select("msg_id", X.airports(F.col("body")).alias("p"))
    places = found.select("msg_id", "p.origin", "p.dest")
    return places.withColumn("international", X.is_international(F.col("origin"), F.col("dest")))


@query
def flight_numbers(spark, sf_dir):
    named = D.messages(spark, sf_dir).select(
        "msg_id", "body", sender_domain(F.col("from_hdr")).alias("domain"), X.flight_number(F.col("body")).alias("number")
    )
    line = X.airline(F.col("domain"), F.col("body"), X.flight_airline(F.col("number")))
    return named.select("msg_id", "number", line.alias("airline"))


@query
def fares(spark, sf_dir):
    found = D.messages(spark, sf_dir).select("msg_id", X.fare_amounts(F.col("body")).alias("a"))
    return found.select("msg_id", X.base_fare(F.col("a")).alias("base_fare"), X.total_paid(F.col("a")).alias("total_paid"))


@query
def flight_dates(spark, sf_dir):
    found = D.messages(spark, sf_dir).select(
        "msg_id", mail_clock(F.col("date_hdr")).alias("c"), X.body_dates(F.col("body")).alias("d")
    )
    ordered = X.upcoming_first(F.col("d"), F.col("c"))
    return found.select("msg_id", F.array_join(F.transform(ordered, lambda d: d.cast("string")), ",").alias("dates"))


@query
def normalized_keys(spark, sf_dir):
    keyed = R.with_keys(D.booking_candidates(spark, sf_dir))
    return keyed.select(
        "flight_id", F.col("_code").alias("code"), F.col("_date").alias("date"), F.col("_origin").alias("origin"),
        F.col("_dest").alias("dest"), F.col("_airline").alias("airline"), N.day_of(F.col("_date")).cast("string").alias("day"),
    )


# ---------------------------------------------------------------- extraction

def _extracted(spark, sf_dir):
    return E.extract(D.messages(spark, sf_dir), D.AS_OF, keep=["msg_id", "leg"])


def _candidates(spark, sf_dir):
    return E.candidates(D.messages(spark, sf_dir), D.AS_OF, "msg_id")


@query
def candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query
def confidence_buckets(spark, sf_dir):
    return E.confidence_buckets(_candidates(spark, sf_dir))


@query
def field_completeness(spark, sf_dir):
    return E.field_completeness(_candidates(spark, sf_dir))


@query
def candidate_counts(spark, sf_dir):
    return E.grouped_counts(_candidates(spark, sf_dir))


@query
def extraction_stats(spark, sf_dir):
    return E.extraction_stats(D.messages(spark, sf_dir), D.AS_OF)


@query
def run_totals(spark, sf_dir):
    return E.run_totals(E.extraction_stats(D.messages(spark, sf_dir), D.AS_OF))


@query
def id_counts(spark, sf_dir):
    return E.id_counts(_extracted(spark, sf_dir))


# ---------------------------------------------------------------- reconciliation

def _sides(spark, sf_dir):
    return D.booking_candidates(spark, sf_dir), D.register(spark, sf_dir)


def _matched(rule):
    def run(spark, sf_dir):
        columns = ("flight_id", "dedup_status", "match_group", "match_count", "match_reason", "confidence")
        return R.matches(*_sides(spark, sf_dir), rules=(rule,)).select(*columns)

    return run


for _name, _rule in {
    "match_confirmation": R.CODE,
    "match_composite": R.SAME_BOOKING,
    "match_route_band": R.SAME_ROUTE_NEAR_DAY,
    "match_airline_day": R.SAME_AIRLINE_DAY,
    "match_airline_band": R.SAME_AIRLINE_NEAR_DAY,
}.items():
    _run = _matched(_rule)
    _run.__name__ = _name
    query(_run)


@query
def classify_candidates(spark, sf_dir):
    return R.classify(*_sides(spark, sf_dir))


@query
def classify_bucketed(spark, sf_dir):
    """As ``classify_candidates``, against counted lookups in a bucketed table in place of the register."""
    candidates, register = _sides(spark, sf_dir)
    path = scratch_dir(spark, "lookups")
    name = "lookups_" + path.rsplit("-", 1)[1]
    register_bucketed(R.counted_lookups(R.lookup_rows(register)), name, path, R.KEY, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = R.classify(candidates, None, hits=R.match_hits(candidates, None, lookups=spark.table(name)))
    # The frame is resolved by now; the catalog entry goes, the external rows stay.
    spark.sql(f"DROP TABLE {name}")
    return found


@query
def status_counts(spark, sf_dir):
    return R.status_totals(*_sides(spark, sf_dir))


@query
def net_new_breakdown(spark, sf_dir):
    return R.net_new_breakdown(R.classify(*_sides(spark, sf_dir)))


@query
def review_duplicates(spark, sf_dir):
    return R.review(R.classify(*_sides(spark, sf_dir)), "exact_duplicate")


@query
def review_near_matches(spark, sf_dir):
    return R.review(R.classify(*_sides(spark, sf_dir)), "near_match")


@query
def review_conflicts(spark, sf_dir):
    return R.review(R.classify(*_sides(spark, sf_dir)), "conflict")


@query
def key_coverage(spark, sf_dir):
    return R.key_coverage(D.register(spark, sf_dir))


@query
def match_members(spark, sf_dir):
    candidates, register = _sides(spark, sf_dir)
    path = scratch_dir(spark, "hits")
    write_rows(R.match_hits(candidates, register), path)
    return R.members_of(spark.read.parquet(path), register, stored=True)


# ---------------------------------------------------------------- register

@query
def register_seed(spark, sf_dir):
    return decimals_to_double(G.seed_transform(D.bookings(spark, sf_dir), "ord", D.AS_OF))


def _page(spark, sf_dir, cursor=None):
    return _search(D.register(spark, sf_dir), cursor)


def _search(register, cursor=None):
    return G.search(
        register, date_from="1996-01-01", date_to="2000-12-31T23:59:59Z", airline="BUILDING", status="active", international=True,
        cursor=cursor,
    )


@query
def search_register(spark, sf_dir):
    return decimals_to_double(_page(spark, sf_dir))


@query
def search_page2(spark, sf_dir):
    return decimals_to_double(_page(spark, sf_dir, G.next_cursor(_page(spark, sf_dir), PAGE_LIMIT)))


@query
def search_stored_page2(spark, sf_dir):
    """The second page of a register stored in the order of its ids, whose row groups the cursor prunes."""
    path = scratch_dir(spark, "clustered")
    write_clustered(D.register(spark, sf_dir), path)
    stored = spark.read.parquet(path)
    return decimals_to_double(_search(stored, G.next_cursor(_search(stored), PAGE_LIMIT)))


@query
def search_cursor(spark, sf_dir):
    return G.page_info(_page(spark, sf_dir), PAGE_LIMIT)


def _log_ids(spark, sf_dir):
    return D.change_log(spark, sf_dir).where("op = 'cancel'").select("flight_id")


@query
def get_rows(spark, sf_dir):
    return decimals_to_double(G.get_rows(D.register(spark, sf_dir), _log_ids(spark, sf_dir)).drop("ord"))


@query
def get_misses(spark, sf_dir):
    return G.missing_rows(D.register(spark, sf_dir), _log_ids(spark, sf_dir))


def _change(op, spark, sf_dir):
    return op(D.register(spark, sf_dir), D.change_log(spark, sf_dir))


@query
def create_rows(spark, sf_dir):
    return decimals_to_double(_change(G.create, spark, sf_dir).changed)


@query
def create_rejects(spark, sf_dir):
    return _change(G.create, spark, sf_dir).rejects


@query
def update_rows(spark, sf_dir):
    return decimals_to_double(_change(G.update, spark, sf_dir).changed)


@query
def update_rejects(spark, sf_dir):
    return _change(G.update, spark, sf_dir).rejects


@query
def cancel_rows(spark, sf_dir):
    done = G.cancel(D.register(spark, sf_dir), _log_ids(spark, sf_dir), D.AS_OF)
    return done.changed.select("flight_id", "status", "cancelled_at", "updated_at")


@query
def apply_changes(spark, sf_dir):
    base = D.register(spark, sf_dir)
    return decimals_to_double(G.apply_changes(base, D.change_log(spark, sf_dir)).whole)


@query
def change_rejects(spark, sf_dir):
    return _change(G.apply_changes, spark, sf_dir).rejects


def _thirds(spark, sf_dir):
    """The events in three parts, one after the other."""
    events = D.table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    return [events.where(F.floor(F.col("event_id") * 3 / (last + 1)) == third) for third in range(3)]


@query
def stream_changes(spark, sf_dir):
    """The stream is stopped and started again from its checkpoint between three deliveries of events."""
    store = scratch_dir(spark, "register")
    start_store(D.register(spark, sf_dir), store)
    for part in _thirds(spark, sf_dir):
        part.write.mode("append").parquet(f"{store}/events")
        events = spark.readStream.schema(part.schema).parquet(f"{store}/events")
        apply_change_stream(D.change_rows(events), store, f"{store}/checkpoint").awaitTermination()
    return decimals_to_double(current_register(spark, store))


@query
def stream_redelivered(spark, sf_dir):
    """As ``stream_changes``, with a delivery that comes again beside the next: repeats are dropped under a watermark."""
    store = scratch_dir(spark, "register")
    start_store(D.register(spark, sf_dir), store)
    first, second, third = _thirds(spark, sf_dir)
    for parts in ((first,), (second,), (second, third)):
        for part in parts:
            part.write.mode("append").parquet(f"{store}/events")
        events = spark.readStream.schema(first.schema).parquet(f"{store}/events")
        once = delivered_once(events, "event_id", "ts", "11 days")  # a third of the events spans ten days
        apply_change_stream(D.change_rows(once), store, f"{store}/checkpoint").awaitTermination()
    return decimals_to_double(current_register(spark, store))


@query
def upsert_latest(spark, sf_dir):
    """Updates of the fare as whole-row writes; the last write per key stays."""
    base = D.register(spark, sf_dir).drop("ord")
    log = D.change_log(spark, sf_dir).where("op = 'update'").select(
        "ord", "flight_id", F.lit("written").alias("status"), F.col("at").alias("updated_at")
    )
    return G.upsert(base, log, "ord").select("flight_id", "status", "updated_at", "origin")


@query
def load_check(spark, sf_dir):
    seeded = G.seed_transform(D.bookings(spark, sf_dir), "ord", D.AS_OF)
    return G.load_check(seeded.select("flight_id").distinct(), D.bookings(spark, sf_dir))


@query
def preview(spark, sf_dir):
    return G.preview(G.seed_transform(D.bookings(spark, sf_dir), "ord", D.AS_OF)).select(
        "flight_id", "date_iso", "origin", "dest", "airline"
    )


# ---------------------------------------------------------------- files

def _mail_records(spark, sf_dir):
    """Messages as mailbox text: a third plain, a third multipart, a third HTML only."""
    mails = D.messages(spark, sf_dir)
    body, kind = F.col("body"), F.col("msg_id") % 3
    head = F.concat_ws(
        "\n",
        F.lit("From sender Mon Jan  1 00:00:00 2024"), F.concat(F.lit("X-Msg: "), F.col("msg_id").cast("string")),
        F.concat(F.lit("From: "), F.col("from_hdr")), F.concat(F.lit("Subject: "), F.col("subject")),
        F.concat(F.lit("Date: "), F.col("date_hdr")),
    )
    multipart = F.concat(
        F.lit('\nContent-Type: multipart/mixed; boundary="cut"\n\n--cut\nContent-Type: text/plain; charset=utf-8\n'
              "Content-Transfer-Encoding: base64\n\n"),
        F.base64(body.cast("binary")),
        F.lit("\n--cut\nContent-Type: text/plain\nContent-Disposition: attachment; filename=a.txt\n\nnot me\n--cut--\n"),
    )
    page = F.concat(
        F.lit("\nContent-Type: text/html; charset=utf-8\n\n<html><style>p {}</style><p>"), body, F.lit("</p></html>\n")
    )
    rest = F.when(kind == 0, F.concat(F.lit("\n\n"), body, F.lit("\n"))).when(kind == 1, multipart).otherwise(page)
    return mails.select(F.concat(head, rest).alias("value"))


def _mailbox(spark, sf_dir):
    path = scratch_dir(spark, "mailbox")
    _mail_records(spark, sf_dir).write.text(path)
    return path


def _number(df):
    return F.regexp_extract("headers", r"(?m)^X-Msg: (\d+)", 1).cast("long").alias("msg_id")


@query
def mailbox_scan(spark, sf_dir):
    found = scan_headers(spark, _mailbox(spark, sf_dir))
    return found.select(_number(found), "from_hdr", "subject", "date_hdr")


@query
def mail_bodies(spark, sf_dir):
    found = with_bodies(E.booking_mails(scan_messages(spark, _mailbox(spark, sf_dir))))
    return found.select(_number(found), "extraction_tier", F.regexp_replace("body", r"\n+\z", "").alias("body"), "error")


def _chat_csv(spark, sf_dir):
    path = scratch_dir(spark, "chat")
    D.table(spark, sf_dir, "conversations").write.csv(path, header=True, escape='"', quoteAll=True)
    return read_csv_text(spark, path)


@query
def csv_chat(spark, sf_dir):
    return C.keyword_frequency(_chat_csv(spark, sf_dir), CHAT_WORDS)


@query
def csv_profile_rows(spark, sf_dir):
    found = csv_profile(_chat_csv(spark, sf_dir))
    return found.select(F.array_join("columns", ",").alias("columns"), "row_count")


@query
def register_decimals(spark, sf_dir):
    path = scratch_dir(spark, "stored")
    D.register(spark, sf_dir).write.parquet(path)
    return read_register(spark, path).select("flight_id", "total_paid")


def _written(spark, sf_dir):
    path = scratch_dir(spark, "candidates")
    write_candidates(_candidates(spark, sf_dir), path, probe=_extracted(spark, sf_dir))
    return path


@query
def write_candidate_rows(spark, sf_dir):
    return spark.read.parquet(_written(spark, sf_dir))


@query
def reconciled_rows(spark, sf_dir):
    """Reconciled rows as written and read again."""
    path = scratch_dir(spark, "reconciled")
    write_rows(R.classify(*_sides(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query
def report_section(spark, sf_dir):
    """A section of the report as written and read again."""
    path = scratch_dir(spark, "report")
    write_report({"classification": R.status_counts(R.classify(*_sides(spark, sf_dir)))}, path)
    return spark.read.schema("dedup_status string, n long, percent double").json(f"{path}/classification")


@query
def scan_skips_missing(spark, sf_dir):
    """Mailboxes picked by name, one of which does not exist."""
    path = scratch_dir(spark, "boxes")
    _mail_records(spark, sf_dir).write.text(f"{path}/box 0.mbox")
    names = [r["name"] for r in list_files(spark, path, "part-*").select(base_name(F.col("path")).alias("name")).collect()]
    found = scan_headers(spark, path, named([*names, "absent.mbox"]))
    return found.select(_number(found), "subject")


@query
def candidate_table(spark, sf_dir):
    path = _written(spark, sf_dir)
    name = "candidates_" + path.rsplit("-", 1)[1]
    register_table(spark, name, path)
    counted = spark.table(name).groupBy("airline").agg(F.count(F.lit(1)).alias("n"))
    # The frame is resolved by now; the catalog entry goes, the external rows stay.
    spark.sql(f"DROP TABLE {name}")
    return counted
