"""Token counts of documents in flat token files, by scanning for the end id.

A flat file is nothing but 16- or 32-bit little-endian ids, one document after the other,
each ended by the end id; it has no index.  Files are cut into blocks of fixed size that
tasks read by range, whatever the file's size.  Within a block the end ids are found by one
vectorised comparison; the document that a block's first end id closes may have begun any
number of blocks before, so each block also reports its last end id and its number of end
ids, and a prefix scan over blocks (in two levels, so that no task scans all blocks of a
large file) carries both forward.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import shared_path, staged, text_or_empty
from weft.llm.files import filesystem
from weft.llm.subword_units import byte_bpe, slices

BLOCK_IDS = 1 << 20
SPAN = 1024  # blocks whose totals are scanned together


def write_flat(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every row into flat files of uint16 (if all ids fit) or uint32 below the shared
    folder.  Returns the list of what was written, ``(file, nth, doc_id, width)``, itself staged.

    Each attempt of a task writes a file of its own name, and the list comes from the attempt
    that was committed, so a repeated or lost task leaves at most a file that nothing names.
    Null texts count as empty documents (the end id alone).
    """
    folder = shared_path(docs.sparkSession, "flat")

    def run(batches):
        bpe = byte_bpe(tokenizer_path)
        width = 2 if max(bpe.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        name, nth, sink = f"{uuid.uuid4().hex}.bin", 0, None
        tail = np.array([end_id], f"<u{width}").tobytes()
        for b in batches:
            sink = sink or fs.open_output_stream(f"{path}/{name}")
            for part in slices(b, 1):
                for ids in bpe.ids(part.column(1)):
                    sink.write(ids.astype(f"<u{width}").tobytes() + tail)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"] * n), pa.array(np.arange(nth, nth + n)), b.column(0), pa.array([width] * n, pa.int32())],
                names=["file", "nth", "doc_id", "width"])
            nth += n
        if sink:
            sink.close()

    return staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
                  .mapInArrow(run, "file string, nth long, doc_id long, width int"), "flat-list")


def scan_flat(spark: SparkSession, files: DataFrame, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``files(file, width)`` -> ``(file, nth, start, n_tokens)`` for every document: its place in the
    file, the place of its first id and its ids without the end id.

    Ids after a file's last end id are one more document; an empty file has none; equal end
    ids side by side bound empty documents.  A file that is not there is an error.
    """
    def sizes(batches):
        for b in batches:
            got = [filesystem(f) for f in b.column(0).to_pylist()]
            info = [fs.get_file_info(p) for fs, p in got]
            gone = [i.path for i in info if not i.is_file]
            if gone:
                raise FileNotFoundError(f"token files are gone: {gone[:3]}")
            size = [i.size for i in info]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size, pa.int64())], names=["file", "width", "bytes"])

    blocks = (files.select("file", "width").mapInArrow(sizes, "file string, width int, bytes long")
              .withColumn("n_ids", F.expr("bytes div width")).where("n_ids > 0")
              .withColumn("block", F.explode(F.expr(f"sequence(0L, (n_ids - 1) div {block_ids}L)")))
              .select("file", "width", "n_ids", "block").repartition("file", "block"))

    def scan(batches):
        for b in batches:
            for file, width, n_ids, block in zip(*(c.to_pylist() for c in b.columns)):
                fs, path = filesystem(file)
                at, n = block * block_ids, min(block_ids, n_ids - block * block_ids)
                with fs.open_input_file(path) as f:
                    f.seek(at * width)
                    ids = np.frombuffer(f.read(n * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + at
                open_end = at + n == n_ids and (not len(ends) or ends[-1] != n_ids - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block]), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()),
                     pa.array([len(ends)], pa.int64()),
                     pa.array([np.append(ends, n_ids) if open_end else ends], pa.list_(pa.int64()))],
                    names=["file", "block", "last_end", "n_ends", "ends"])

    got = staged(blocks.mapInArrow(scan, "file string, block long, last_end long, n_ends long, ends array<long>"), "ends")
    span = F.expr(f"block div {SPAN}").alias("span")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    tops = got.groupBy("file", span).agg(F.max("last_end").alias("last_end"), F.sum("n_ends").alias("n_ends"))
    w = before("file").orderBy("span")
    tops = tops.select("file", "span", F.max("last_end").over(w).alias("top_end"), F.sum("n_ends").over(w).alias("top_ends"))
    w = before("file", "span").orderBy("block")
    carry = (got.select("file", "block", span, "last_end", "n_ends")
             .select("file", "block", "span", F.max("last_end").over(w).alias("in_end"), F.sum("n_ends").over(w).alias("in_ends"))
             .join(tops, ["file", "span"])
             .select("file", "block", F.greatest("in_end", "top_end", F.lit(-1).cast("long")).alias("prior_end"),
                     (F.coalesce("in_ends", F.lit(0)) + F.coalesce("top_ends", F.lit(0))).alias("prior")))
    ends = got.join(carry, ["file", "block"]).select(
        "file", "prior", F.posexplode(F.transform("ends", lambda e, i: F.struct(
            (F.when(i == 0, F.col("prior_end")).otherwise(F.element_at("ends", i)) + 1).alias("start"), e.alias("end")))))
    return ends.select("file", (F.col("prior") + F.col("pos")).alias("nth"), "col.start",
                       (F.col("col.end") - F.col("col.start")).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` (ids without the end id) of every row, by writing flat files and scanning
    them.  Null and empty texts have 0; repeated rows count each; an empty table gives no rows."""
    wrote = write_flat(docs, tokenizer_path, end_id, id_col, text_col)
    found = scan_flat(docs.sparkSession, wrote.select("file", "width").distinct(), end_id)
    return wrote.select("file", "nth", "doc_id").join(found, ["file", "nth"]).select("doc_id", "n_tokens")
