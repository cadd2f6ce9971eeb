"""Corpus inventory: what the messages, chats and files hold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from tripledger import vocabulary as V
from tripledger.functions.mail import mail_date, relevant, sender_domain
from tripledger.functions.text import contains_any, tagged, words_found
from tripledger.operators.keep import join_once


def relevant_mails(
    messages: DataFrame,
    sender_words: Iterable[str] = V.SENDER_WORDS,
    subject_words: Iterable[str] = V.SUBJECT_WORDS,
) -> DataFrame:
    """Messages with a sender or subject word, plus ``sender_domain`` and ``date`` (ISO text)."""
    kept = messages.where(relevant(F.col("from_hdr"), F.col("subject"), sender_words, subject_words))
    return kept.withColumns(
        {"sender_domain": sender_domain(F.col("from_hdr")), "date": mail_date(F.col("date_hdr"))}
    )


def catalog_entries(relevant_df: DataFrame) -> DataFrame:
    """One row per relevant mail, with its whole subject."""
    return relevant_df.select(
        "sender_domain", "subject", "date", "source_file"
    )


def sender_catalog(relevant_df: DataFrame) -> DataFrame:
    """Mails, first and last date per sender domain, most mails first (ties by domain).

    Dates compare as text, so raw unparsed dates take part and NULL dates do not.
    """
    return (
        relevant_df.groupBy("sender_domain")
        .agg(F.count(F.lit(1)).alias("mails"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        .orderBy(F.desc("mails"), "sender_domain")
    )


def subject_patterns(relevant_df: DataFrame, words: Iterable[str] = V.SUBJECT_WORDS) -> DataFrame:
    """Relevant mails per subject word; words without a hit are absent."""
    return (
        relevant_df.select(F.explode(words_found(F.lower(F.col("subject")), words)).alias("pattern"))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("mails"))
        .orderBy(F.desc("mails"), "pattern")
    )


def date_summary(relevant_df: DataFrame) -> DataFrame:
    """Relevant mails, first and last date, and distinct days (first ten characters)."""
    return relevant_df.agg(
        F.count(F.lit(1)).alias("relevant_mails"),
        F.min("date").alias("earliest"),
        F.max("date").alias("latest"),
        F.countDistinct(F.col("date").substr(1, 10)).alias("estimated_unique"),
    )


def file_stats(
    messages: DataFrame,
    sender_words: Iterable[str] = V.SENDER_WORDS,
    subject_words: Iterable[str] = V.SUBJECT_WORDS,
    by: str = "source_file",
) -> DataFrame:
    """Messages and relevant messages per source file; ``by`` names the column that tells files apart."""
    hit = relevant(F.col("from_hdr"), F.col("subject"), sender_words, subject_words)
    return messages.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(hit).alias("relevant_count")
    )


def file_inventory(listing: DataFrame, stats: DataFrame) -> DataFrame:
    """Listed files with the counts of those that were scanned, joined on the whole path (``source_path``)."""
    return join_once(listing, stats.withColumnRenamed("source_path", "path"), ["path"], "left")


def corpus_totals(listing: DataFrame) -> DataFrame:
    """Files and bytes of a listing."""
    return listing.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes")
    )


def format_counts(listing: DataFrame) -> DataFrame:
    """Files and bytes per format."""
    return listing.groupBy("format").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("total_bytes")
    )


def keyword_frequency(rows: DataFrame, words: Iterable[str] = V.CHAT_WORDS) -> DataFrame:
    """Rows per keyword over the text of all columns, zeros kept, with both totals.

    Each result row also carries the number of rows and of rows with any keyword.
    """
    tested = rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns]).alias("_text"))
    return _keyword_counts(tested.groupBy(), F.lit(True), list(words))


def keyword_frequency_by(rows: DataFrame, by: str, text: str, counted: str, words: Iterable[str] = V.CHAT_WORDS) -> DataFrame:
    """As ``keyword_frequency`` for every value of ``by`` in one pass; only rows that ``counted`` marks count."""
    tested = rows.select(by, F.col(counted).alias("_counted"), F.col(text).alias("_text"))
    return _keyword_counts(tested.groupBy(by), F.col("_counted"), list(words), by)


def _keyword_counts(groups: GroupedData, counted: Column, words: list[str], *by: str) -> DataFrame:
    text = F.lower("_text")
    counts = groups.agg(
        F.count_if(counted).alias("total_rows"),
        F.count_if(counted & contains_any(text, words)).alias("matched_rows"),
        *[F.count_if(counted & text.contains(w)).alias(f"_k{i}") for i, w in enumerate(words)],
    )
    pairs = tagged(("keyword", "n"), *[(F.lit(w), F.col(f"_k{i}")) for i, w in enumerate(words)])
    return counts.select(*by, "total_rows", "matched_rows", F.inline(pairs))
