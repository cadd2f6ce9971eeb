"""The five steps end to end: inventory, extraction, reconciliation, seeding, registration."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger import vocabulary as V
from tripledger.operators import catalogs as C
from tripledger.operators import extraction as E
from tripledger.operators import reconcile as R
from tripledger.operators import register as G
from tripledger.sources.csv_records import csv_records
from tripledger.sources.files import list_files
from tripledger.sources.mailbox import ANY_MAILBOX, named, scan_headers, scan_messages, with_bodies
from tripledger.sources.tables import csv_profiles, texts_of, widest
from tripledger.sources.writers import write_candidates, write_report, write_rows

# Ties between records with one id: content decides, as files have no row order.
TIES = ("source_file", "source_email_date", "source_email_subject", "date_iso", "total_paid", "base_fare", "airline",
        "flight_number", "extraction_tier", "website")


def inventory(
    spark: SparkSession,
    root: str,
    report: str,
    as_of: str,
    chats: str,
    contacts: str,
    chat_words: Iterable[str] = V.CHAT_WORDS,
) -> dict[str, DataFrame]:
    """Lists a corpus folder, scans its mailboxes and CSV files and writes the report.

    ``chats`` and ``contacts`` are file names; every file of such a name takes part, told apart by
    its path, in one scan per name. Listing, records and relevant mails are stored once and
    everything else is derived from them.
    """
    store = f"{report}/_stored"
    listing = _kept(list_files(spark, root), f"{store}/listing")
    boxes = scan_headers(spark, root, ANY_MAILBOX)
    relevant = _kept(C.relevant_mails(boxes).select("sender_domain", "subject", "date", "source_file"), f"{store}/relevant")
    stats = C.file_stats(boxes, by="source_path")
    sections = {
        "head": _head(spark, as_of, root),
        "flight_email_catalog": C.catalog_entries(relevant),
        "sender_pattern_catalog": C.sender_catalog(relevant),
        "subject_pattern_catalog": C.subject_patterns(relevant),
        "date_range": C.date_summary(relevant),
        "corpus": C.corpus_totals(listing),
    }
    for section, name in (("chat_analysis", chats), ("contacts_analysis", contacts)):
        records = _kept(csv_records(spark, root, named([name])), f"{store}/{section}")
        columns = widest(records)
        sections[section] = rows = (
            C.keyword_frequency_by(texts_of(records, columns), "path", "text", "row", chat_words)
            if section == "chat_analysis" else csv_profiles(records, columns)
        )
        count = "total_rows" if section == "chat_analysis" else "row_count"
        stats = stats.unionByName(rows.select(
            F.col("path").alias("source_path"), F.col(count).alias("total_messages"), F.lit(None).cast("long").alias("relevant_count")).distinct())
    sections["file_inventory"] = C.file_inventory(listing, stats)
    write_report(sections, report)
    return sections


def _kept(rows: DataFrame, path: str) -> DataFrame:
    write_rows(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _head(spark: SparkSession, as_of: str, corpus: str, **totals: int) -> DataFrame:
    """The head of a report: when and over what it was made."""
    return spark.range(1).select(
        F.lit(as_of).alias("generated_at"), F.lit(corpus).alias("corpus_path"), *[F.lit(n).alias(c) for c, n in totals.items()])


def extraction(spark: SparkSession, root: str, out: str, report: str, as_of: str, names: Iterable[str]) -> bool:
    """Reads the wanted mailboxes that exist, writes candidates (if any) and the run summary.

    Mails are decoded once: the scanned rows with the bodies of gated mails are stored beside the
    report, and candidates and statistics are derived from them.
    """
    store = f"{report}/_stored"
    mails = _kept(scanned_with_bodies(scan_messages(spark, root, named(names))), f"{store}/mails")
    found = _kept(E.extract(E.booking_mails(mails), as_of), f"{store}/extracted")
    written = write_candidates(E.unique_candidates(found, TIES), out, probe=found)
    rows = spark.read.parquet(out) if written else E.unique_candidates(found, TIES)
    stats = _kept(E.extraction_stats(mails, as_of), f"{store}/files")
    write_report(
        {
            "head": _head(spark, as_of, root),
            "files": stats,
            "totals": E.run_totals(stats),
            "ids": E.id_counts(found),
            "confidence_distribution": E.confidence_buckets(rows),
            "field_completeness": E.field_completeness(rows),
            "counts": E.grouped_counts(rows),
        },
        report,
    )
    return written


def scanned_with_bodies(scanned: DataFrame) -> DataFrame:
    """All messages; the body is read only for those that pass the header gate."""
    gate = F.col("extraction_tier").isNotNull()
    tiered = E.classified(scanned)
    kept = {c: F.when(gate, F.col(c)) for c in ("body_raw", "message")}
    return with_bodies(tiered.withColumns(kept)).drop("domain", "extraction_tier", "headers")


def reconciliation(candidates: DataFrame, register: DataFrame, out: str, report: str, as_of: str) -> DataFrame:
    """Classifies candidates, writes the rows and the report, returns the stored rows.

    The hits of the key tuples are stored once, for the rows and for the members of their groups.
    """
    spark = candidates.sparkSession
    hits = _kept(R.match_hits(candidates, register), f"{report}/_stored/hits")
    write_rows(R.classify(candidates, register, hits=hits), out)
    stored = spark.read.parquet(out)
    write_report(
        {
            "head": _head(spark, as_of, out, total_candidates=stored.count()),
            "classification": R.status_counts(stored),
            "existing_records": register.agg(F.count(F.lit(1)).alias("existing_records")),
            "net_new": R.net_new_breakdown(stored),
            "duplicate_details": R.review(stored, "exact_duplicate"),
            "near_match_details": R.review(stored, "near_match"),
            "conflict_details": R.review(stored, "conflict"),
            "match_members": R.members_of(hits, register, stored=True),
            "key_coverage": R.key_coverage(register),
        },
        report,
    )
    return stored


def seeding(bookings: DataFrame, order: str, out: str, as_of: str) -> DataFrame:
    """Writes the keyed register rows and returns the load check (expected, actual, ok)."""
    write_rows(G.seed_transform(bookings, order, as_of), out)
    return G.load_check(bookings.sparkSession.read.parquet(out), bookings)
