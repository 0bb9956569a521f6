"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, SentencePiece.

``STAGES`` lists the stages in order.  Each takes ``(spark, docs, sf_dir)``; its result is
written as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``docs``; no stage reads anything but its own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import digest_index, langid, mixing, piece_codec, simhash
from weft.llm.common import rows_that_stay, staged
from weft.llm.queries import MIX, PIECE_MODEL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the classifier, learned from the labelled rows of ``docs``, doesn't reject."""
    names = [f"column_{c}" for c in docs.columns]  # none of them the operator's own
    told = langid.identify(docs.toDF(*names), langid.train(docs), keep=names, text_col="column_text")
    return told.where("not rejected").select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the smallest doc_id."""
    return rows_that_stay(docs, digest_index.exact_duplicates(docs), "kept")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id (see ``near_duplicates``)."""
    return rows_that_stay(docs, simhash.near_duplicates(docs, shingle=3, max_distance=2), "stays")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (never, once or twice)."""
    mixed = mixing.mix(docs, **MIX).where("mix.copies > 0")
    return mixed.select("row", F.explode(F.expr("sequence(1L, mix.copies)")).alias("nth")).select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row as digests, with the spans' checksum."""
    return piece_codec.encode(docs, public_tokenizers.path(PIECE_MODEL), keep=("doc_id",),
                              outputs=("n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("pieces", pieces)]

#: SQL can express neither the classifier nor the pieces; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
