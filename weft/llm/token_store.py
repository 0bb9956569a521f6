"""Token ids as Parquet list columns that can be read in parts.

Files follow each other by document id; within a file rows ascend.  Ids are a list column in
delta-packed pages, ids of documents and counts have dictionaries or deltas; row groups and
pages have set sizes, and every column has a page index.  A reader that asks for the ids of
a few documents reads the pages of these only; one that asks for counts reads no ids.

The text is shuffled once, to its place in the order; tokenising follows the sort, so one
pass over a sorted partition also numbers the tokens within the file.  A task writes its
file under a name of its own and reports it; only files reported by the attempts that were
committed are in the list of files, so lost and repeated tasks leave nothing that is read.
Offsets over all files come from that list, one row a file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import shared_path, staged, text_or_empty
from weft.llm.files import filesystem
from weft.llm.subword_units import byte_bpe, slices

#: Ids of a row group (about; a row is never cut), and bytes of a page.
GROUP_IDS, PAGE = 1 << 20, 64 << 10
COLUMNS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32()))), ("n_tokens", pa.int64()),
                     ("file_start", pa.int64())])
FORMAT = {
    "version": "2.6", "data_page_version": "2.0", "data_page_size": PAGE, "write_page_index": True, "compression": "snappy",
    "use_dictionary": ["n_tokens"],
    "column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED", "doc_id": "DELTA_BINARY_PACKED", "file_start": "DELTA_BINARY_PACKED"},
}


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, files: int = 0, folder: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", specials: bool = False) -> DataFrame:
    """Write ``(doc_id, ids, n_tokens, file_start)`` for every row, ids ending with ``end_id``; returns
    the staged list of files, ``(file, file_no, base, n_docs, n_ids)`` with the ids before each file.

    Null texts count as empty (the end id alone; without end id an empty list).  Null ids come
    first; rows with one id follow each other by text.  ``files``: how many ranges of ids, by
    default the session's shuffle partitions.  ``specials``: special tokens' strings inside texts
    become their ids, the library's default.  An empty table writes no file.
    """
    import pyarrow.parquet as pq

    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or shared_path(spark, "tokens")

    def run(batches):
        bpe, start, sink, rows = byte_bpe(tokenizer_path, specials), 0, None, 0
        tail = np.array([] if end_id is None else [end_id], "<u4")
        no = TaskContext.get().partitionId()
        fs, path = filesystem(folder)
        name = f"part-{no:05d}-{uuid.uuid4().hex}.parquet"
        for b in batches:
            for part in slices(b, 1):
                ids = [x for t in bpe.ids(part.column(1)) for x in (t, tail)]
                sizes = np.array([len(x) for x in ids[::2]], np.int64) + len(tail)
                ends = np.append(0, np.cumsum(sizes))
                flat = pa.array(np.concatenate(ids).view("<i4"))
                if sink is None:
                    fs.create_dir(path, recursive=True)
                    sink = pq.ParquetWriter(fs.open_output_stream(f"{path}/{name}"), COLUMNS, **FORMAT)
                table = pa.Table.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat).cast(COLUMNS.types[1]),
                                              pa.array(sizes), pa.array(start + ends[:-1])], schema=COLUMNS)
                # groups of whole rows with about GROUP_IDS ids
                cuts = [0, *(np.flatnonzero(np.diff((ends[1:] - 1) // GROUP_IDS)) + 1).tolist(), len(table)]
                for i, j in zip(cuts[:-1], cuts[1:]):
                    sink.write_table(table.slice(i, j - i), row_group_size=max(1, j - i))
                start, rows = start + int(ends[-1]), rows + len(table)
        if sink:
            handle = sink.file_handle
            sink.close()
            if handle is not None:
                handle.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([no], pa.int32()), pa.array([rows]), pa.array([start])],
                                             names=["file", "file_no", "n_docs", "n_ids"])

    wrote = (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
             .repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "t")
             .mapInArrow(run, "file string, file_no int, n_docs long, n_ids long"))
    ahead = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return staged(staged(wrote, "written").select("file", "file_no", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("base"),
                                                  "n_docs", "n_ids"), "token-files")


def _paths(files: DataFrame) -> list:
    return [r.file for r in files.select("file").collect()]  # the list that a Spark scan holds anyway


def read_rows(spark: SparkSession, files: DataFrame, doc_ids=None) -> DataFrame:
    """``doc_id, ids, n_tokens, file_start`` of the given documents (a short list; default all) with Spark's
    own reader: a filter skips row groups and pages, unused columns are not read."""
    paths = _paths(files)
    if not paths:
        return spark.createDataFrame([], "doc_id long, ids array<int>, n_tokens long, file_start long")
    rows = spark.read.parquet(*paths)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def read_back(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, all from the files: ``start`` counts the
    ids of all documents before it, ``ids_crc32`` is the CRC-32 of the ids as little-endian uint32.
    A file is read by one task, one row group at a time."""
    import pyarrow.parquet as pq

    def run(batches):
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    rows = pq.ParquetFile(f)
                    for g in range(rows.num_row_groups):
                        t = rows.read_row_group(g, use_threads=False).combine_chunks()
                        lists = t.column("ids").chunk(0)
                        flat, at = np.asarray(lists.flatten()).astype("<u4"), np.append(0, np.cumsum(t.column("n_tokens").to_numpy()))
                        crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:])]
                        if at[-1] != len(flat):
                            raise ValueError(f"counts and ids of {file} disagree")
                        yield pa.RecordBatch.from_arrays(
                            [t.column("doc_id").chunk(0), pa.array(t.column("file_start").to_numpy() + base), t.column("n_tokens").chunk(0),
                             pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return files.select("file", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
