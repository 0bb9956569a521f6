"""Helpers shared by the operators: staged tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import checkpoint_dir

#: White space of the text rules: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back (a lineage cut that
    survives lost executors)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col="text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def rows_that_stay(docs: DataFrame, answer: DataFrame, stays, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (all its columns) for which a deduplication's ``answer`` (``doc_id,
    text_hash`` for every row) has ``stays`` true.  Rows that agree in id and text cannot be
    told apart: of those one stays, the smallest by its JSON (so columns of any type will do)."""
    key = [F.col(id_col).cast("long").alias("k_id"), F.xxhash64(text_col).alias("k_text")]
    many = answer.groupBy("doc_id", "text_hash").count().where("count > 1")
    keep = answer.where(stays).select(F.col("doc_id").alias("keep_doc"), F.col("text_hash").alias("keep_text")).distinct()
    cols = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *key)
    on = F.col("k_id").eqNullSafe(F.col("keep_doc")) & (F.col("k_text") == F.col("keep_text"))
    kept = inner.join(keep, on, "left_semi")
    if not many.isEmpty():
        kept = kept.groupBy("k_id", "k_text").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row.*")
