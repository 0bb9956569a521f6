"""File sources and sinks: raw text, binary token shards, .npy tensors (A-01, A-32, A-33, C-99).

Files are read with Spark's ``binaryFile`` source (one row per file, split across
tasks) and parsed with Arrow-batched pandas functions; writers run inside tasks
(``mapInPandas``) through ``pyarrow.fs`` so any shared file system URI works.
"""

from __future__ import annotations

import io
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.corpus import SHARD_HEADER_INTS, SHARD_MAGIC, SHARD_VERSION


def _fs(path: str):
    """(filesystem, path) for plain paths, ``file:`` paths and any URI pyarrow knows."""
    import pyarrow.fs as pafs
    from urllib.parse import urlparse
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(path).path
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    """A whole file at ``path``: written under a name of its own and then renamed, so that a task that dies
    or runs twice leaves no part of a file where readers look."""
    import uuid
    fs, at = _fs(path)
    folder, name = os.path.split(at)
    fs.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, at)


#: Folders of written text files, and bytes of file content in one Arrow batch.
TEXT_FOLDERS, BATCH_BYTES = 256, 4_000_000


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return [s.getPath().toString() for s in found if s.isDirectory()]


def read_text_corpus(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """A-01: whole files decoded as UTF-8 (malformed bytes -> U+FFFD), optionally cut to
    the first ``max_chars`` code points.  Returns (path, text).

    For a pattern of files (``folder/*.txt``, ``*/*.txt``) the driver looks up the folders only and every task lists
    and reads the files of its folders, so small files cost neither driver memory nor a task for a few of them.
    Hidden files (``.`` and ``_``) and empty ones are left out, as by Spark.  Other paths, and file systems that
    only Spark knows, go through Spark's own file source."""
    folder, _, names = path.rpartition("/")
    plain = set("*?").isdisjoint
    if folder and not plain(names) and not set(names) & set("[]{}\\") and _known(folder):
        b = _read_files(spark, _folders(spark, folder), names)
    else:
        b = spark.read.format("binaryFile").load(path)
    t = F.decode(F.col("content"), "UTF-8")
    if max_chars is not None:
        t = F.substring(t, 1, max_chars)
    return b.select("path", t.alias("text"))


def _known(path: str) -> bool:
    """Whether pyarrow can open files there."""
    try:
        _fs(path.split("*")[0])
        return True
    except Exception:  # noqa: BLE001 - pyarrow has an error of its own for each cause
        return False


def _read_files(spark: SparkSession, folders: list[str], names: str) -> DataFrame:
    """``(path, content)`` of the files named so in the folders, which tasks list and read."""
    def read(batches):
        from fnmatch import fnmatchcase
        import pyarrow as pa
        import pyarrow.fs as pafs

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], names=["path", "content"])

        rows, size = [], 0
        for b in batches:
            for folder in b.column(0).to_pylist():
                fs, at = _fs(folder)
                for f in fs.get_file_info(pafs.FileSelector(at)):
                    if not f.is_file or not f.size or f.base_name[0] in "._" or not fnmatchcase(f.base_name, names):
                        continue
                    with fs.open_input_file(f.path) as stream:
                        rows.append((f"{folder}/{f.base_name}", stream.read()))
                    size += len(rows[-1][1])
                    if size > BATCH_BYTES or len(rows) >= 10_000:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    there = spark.createDataFrame([(f,) for f in folders], "folder string")
    return there.repartition(max(1, len(folders))).mapInArrow(read, "path string, content binary")


def shard_bytes(tokens) -> bytes:
    """Header of 256 little-endian int32 (magic, version, count, zeros) + uint16 tokens."""
    arr = np.asarray(tokens, dtype=np.int64)
    if arr.size == 0:
        raise ValueError("empty shard")
    if arr.min() < 0 or arr.max() > 65535:
        raise ValueError("token id does not fit in uint16")
    header = np.zeros(SHARD_HEADER_INTS, dtype="<i4")
    header[:3] = (SHARD_MAGIC, SHARD_VERSION, arr.size)
    return header.tobytes() + arr.astype("<u2").tobytes()


def parse_shard(data: bytes) -> tuple[np.ndarray | None, str]:
    """(tokens, status) with status ok / short / bad_magic / bad_version / bad_count."""
    hb = SHARD_HEADER_INTS * 4
    if len(data) < hb:
        return None, "short"
    header = np.frombuffer(data[:hb], dtype="<i4")
    if header[0] != SHARD_MAGIC:
        return None, "bad_magic"
    if header[1] != SHARD_VERSION:
        return None, "bad_version"
    n = int(header[2])
    if len(data) != hb + 2 * n:
        return None, "bad_count" if len(data) > hb + 2 * n else "short"
    return np.frombuffer(data[hb:], dtype="<u2").astype(np.int32), "ok"


def write_bin_shards(shards: DataFrame, root: str, keys=("dataset", "split", "shard")) -> DataFrame:
    """A-32: one ``{split}-{shard:04d}.bin`` file per shard row under ``root/<partition keys>``;
    every task writes its own rows.  Returns (path, n_tokens)."""
    keys = list(keys)

    def write(it):
        for pdf in it:
            paths, counts = [], []
            for _, r in pdf.iterrows():
                sub = "/".join(f"{k}={r[k]}" for k in keys[:-2])
                d = f"{root.rstrip('/')}/{sub}" if sub else root.rstrip("/")
                p = f"{d}/{r[keys[-2]]}-{int(r[keys[-1]]):04d}.bin"
                _put(p, shard_bytes(r["tokens"]))
                paths.append(p)
                counts.append(len(r["tokens"]))
            yield pd.DataFrame({"path": paths, "n_tokens": counts})
    return shards.select(*keys, "tokens").mapInPandas(write, "path string, n_tokens long")


def read_bin_shards(spark: SparkSession, root: str) -> DataFrame:
    """A-33: validated shards: (path, split, shard, tokens, status)."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(root)

    def parse(it):
        for pdf in it:
            out = [parse_shard(bytes(c)) for c in pdf["content"]]
            names = pdf["path"].str.rsplit("/", n=1).str[-1].str.replace(".bin", "", regex=False)
            yield pd.DataFrame({"path": pdf["path"], "split": names.str.rsplit("-", n=1).str[0],
                                "shard": names.str.rsplit("-", n=1).str[-1].astype("int64"),
                                "tokens": [None if t is None else t.tolist() for t, _ in out],
                                "status": [s for _, s in out]})
    return b.select("path", "content").mapInPandas(parse, "path string, split string, shard long, tokens array<int>, status string")


def write_npy(tensors: DataFrame, root: str) -> DataFrame:
    """C-99: one ``{name}.npy`` per row of (name, shape ARRAY<LONG>, values ARRAY<DOUBLE>)."""
    def write(it):
        for pdf in it:
            paths = []
            for _, r in pdf.iterrows():
                arr = np.asarray(r["values"], dtype=np.float32).reshape([int(s) for s in r["shape"]])
                buf = io.BytesIO()
                np.save(buf, arr)
                p = f"{root.rstrip('/')}/{r['name']}.npy"
                _put(p, buf.getvalue())
                paths.append(p)
            yield pd.DataFrame({"path": paths})
    return tensors.select("name", "shape", "values").mapInPandas(write, "path string")


def read_npy(spark: SparkSession, root: str) -> DataFrame:
    """C-99: (name, shape, values) from every ``.npy`` file (float32/float64/int arrays)."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(root)

    def parse(it):
        for pdf in it:
            arrs = [np.load(io.BytesIO(bytes(c))) for c in pdf["content"]]
            yield pd.DataFrame({"name": pdf["path"].str.rsplit("/", n=1).str[-1].str[:-4],
                                "shape": [list(a.shape) for a in arrs],
                                "values": [a.astype(np.float64).ravel().tolist() for a in arrs]})
    return b.select("path", "content").mapInPandas(parse, "name string, shape array<long>, values array<double>")


def write_text_files(df: DataFrame, root: str, name: str, text: str) -> DataFrame:
    """One UTF-8 file ``{root}/{folder}/{name}.txt`` per row, written by the task that holds the row; the names
    are spread over ``TEXT_FOLDERS`` folders, so no folder holds all files of a large table."""
    def write(it):
        from zlib import crc32
        for pdf in it:
            paths = []
            for n, t in zip(pdf[name], pdf[text]):
                p = f"{root.rstrip('/')}/{crc32(str(n).encode()) % TEXT_FOLDERS:03d}/{n}.txt"
                _put(p, (t or "").encode("utf-8"))
                paths.append(p)
            yield pd.DataFrame({"path": paths})
    return df.select(F.col(name).cast("string").alias(name), text).mapInPandas(write, "path string")
