"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a table of ``(digest, keep_id, batch)``, one row per distinct text seen so far,
bucketed and sorted by digest.  A batch is reduced to its distinct digests (partial
aggregation, so a group with a third of all rows costs one row a task), anti-joined with the
index by sort-merge on the buckets (the index is not shuffled) and the new digests are
appended as further sorted files of the same buckets.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import SPACE, shared_path, staged, text_or_empty

#: Distinct texts for one bucket of an index that a whole table fills (some 200 MB).
BUCKET_ROWS = 4_000_000


def normal_text(col="text"):
    """Text with every run of white space as one space; null as empty."""
    return F.regexp_replace(text_or_empty(col), SPACE, " ")


def digests(batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash`` (of the raw text), ``digest`` and a number ``row`` for every row, staged."""
    return staged(batch.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                               F.unhex(F.sha2(normal_text(text_col), 256)).alias("digest"))
                  .withColumn("row", F.monotonically_increasing_id()), "digests")


class DigestIndex:
    """``index = DigestIndex(spark, "seen_texts", path=folder)``; ``index.add(batch)`` for each batch.

    ``path`` is a folder that driver and executors share.  The index lives there and outlives
    the session: a later one opens it by the same path, under any table name, and takes the
    number of buckets from the folder.  Without a path the table is the catalogue's own, in the
    session's warehouse.  ``buckets`` of a new index bounds the tasks of a merge; take about
    one for each ``BUCKET_ROWS`` texts.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 16, path: str | None = None):
        self.spark, self.table, self.buckets = spark, table, buckets
        where = ""
        if path is not None:
            path = path.rstrip("/")
            self.buckets = self._layout(f"{path}/layout", buckets)
            where = f" LOCATION '{path}/rows'"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{where}")

    def _layout(self, path: str, buckets: int) -> int:
        try:
            return self.spark.read.schema("buckets int").parquet(path).first().buckets
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        self.spark.range(1, numPartitions=1).select(F.lit(buckets).alias("buckets")).write.parquet(path)
        return buckets

    def _write(self, df: DataFrame) -> None:
        df.repartition(self.buckets, "digest").write.mode("append").format("parquet") \
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def tell(self, seen: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Add a batch of :func:`digests`; one row per distinct text: ``digest, stays`` (number of the
        row that stays, -1 if an earlier batch has the text), ``group_size, keep_id``.

        A ``batch_id`` makes the batch repeatable: after a failure, whether its texts reached
        the index or not, the same rows under the same id have the same answer."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
        groups = staged(seen.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
                        .select("digest", "first.doc_id", F.col("first.row").alias("stays"), "group_size"), "digest-groups")
        batch = uuid.uuid4().hex if batch_id is None else batch_id
        earlier = self.rows().where(F.col("batch") != batch).select("digest", "keep_id")
        known = groups.hint("merge").join(earlier, "digest") \
            .select("digest", F.lit(-1).cast("long").alias("stays"), "group_size", "keep_id")
        fresh = groups.hint("merge").join(earlier, "digest", "left_anti") \
            .select("digest", "stays", "group_size", F.col("doc_id").alias("keep_id"))
        told = staged(known.unionByName(fresh), "told")
        new = told.where("stays >= 0").select("digest", "keep_id", F.lit(batch).alias("batch"))
        if batch_id is not None:  # what an attempt before this one left there is not written twice
            new = staged(new.hint("merge").join(self.rows().select("digest"), "digest", "left_anti"), "digests-new")
        self._write(new)
        return told

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_id: str | None = None) -> DataFrame:
        """Add a batch; one row per row of it: ``doc_id, keep_id, group_size, kept, digest, text_hash``.

        ``keep_id``: doc_id of the row that stays for this text: the one the index knows, else
        the smallest of the batch.  ``group_size``: rows of the batch with this text.  ``kept``:
        this row stays; one row of each text the index did not know, also where rows repeat
        with one doc_id.  Null texts count as empty and are equal to each other; a null doc_id
        is larger than any number, so it stays only where a text has no other.  An empty batch
        changes nothing.  ``text_hash``: of the raw text, to find the row again.  ``batch_id``:
        see :meth:`tell`; without it a batch that is added again meets its own texts.
        """
        seen = digests(batch, id_col, text_col)
        return _answer(seen, self.tell(seen, batch_id))


def _answer(seen: DataFrame, told: DataFrame) -> DataFrame:
    return seen.join(told, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), "digest", "text_hash")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Deduplicate one table within itself: the lower half of its ids fills a new index in the shared
    folder, the upper half (rows without an id with it) meets that index as new data.

    Columns as of :meth:`DigestIndex.add`, ``group_size`` over the whole table.  ``buckets`` follows
    the number of rows unless it is given."""
    spark = docs.sparkSession
    seen = digests(docs, id_col, text_col)
    size = seen.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", 0.5).alias("middle")).first()
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets or max(16, -(-size.n // BUCKET_ROWS)),
                        shared_path(spark, "digest-index"))
    lower = F.coalesce(F.col("doc_id") <= F.lit(size.middle).cast("long"), F.lit(False))
    told = index.tell(seen.where(lower), "lower").unionByName(index.tell(seen.where(~lower), "upper"))
    # a text in both halves: the lower one's row stays
    told = told.groupBy("digest").agg(F.max("stays").alias("stays"), F.sum("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"))
    spark.sql(f"DROP TABLE {index.table}")
    return _answer(seen, told)
