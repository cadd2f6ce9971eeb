"""From raw documents to training tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tripledger.llm import byte_bpe, exact_dedup, language_id, minhash_join, mixing
from tripledger.llm.common import documents, shared_folder

#: Similarity of near copies between stages; the 85 of minhash_join belongs to the op6 query.
NEAR_PERCENT = 80
#: Characters of a block of the last stage: half of the usual, as the stages before leave executors fuller.
TOKEN_BLOCK = 4_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts without a letter (null ones too) go, and no other. A missing ``lang`` is filled in."""
    return language_id.keep_readable(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each equal text."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word shingles that agree to NEAR_PERCENT or more."""
    return minhash_join.keep_one(docs, percent=NEAR_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes from them, in training order."""
    return mixing.training_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the bytes they decode to; a row per repetition."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN, with_ids=True, block_chars=TOKEN_BLOCK)
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_join", near),
    ("source_mixing", mixed),
    ("byte_bpe", tokens),
]

#: The first stage learns its model and the third hashes, so SQL cannot state the rows; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``.

    The rows between two stages are a table in the shared folder, which is emptied when the next one is written.
    """
    docs, base, before = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before is not None:
            docs.where("false").write.mode("overwrite").parquet(before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
