"""A-39: token shards of every dataset under every vocabulary, with a manifest committed last."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import bpe as B
from weft.operators import corpus as C
from weft.operators import tokenizer as TK
from weft.session import stage_table, staged_until
from weft.sources.files import write_bin_shards

MANIFEST = "dataset string, vocab string, split string, n_shards long, n_tokens long, vocab_size int"


def done_pairs(spark, root: str) -> DataFrame:
    """The manifest rows of all pairs whose files are complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/pair=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    paths = [s.getPath().getParent().toString() for s in found]
    return spark.read.schema(MANIFEST).parquet(*paths) if paths else spark.createDataFrame([], MANIFEST)


def _char_stream(docs: DataFrame, names: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    own = docs.where(F.col("dataset").isin(list(names)))
    return C.encoded_stream(C.paragraph_pieces(own), ["dataset"], [*order, "para_idx", "chunk_idx"]), dict.fromkeys(names, T.CHAR_EOS + 1)


def _bpe_stream(docs: DataFrame, names: Sequence[str], order: Sequence[str], size: int) -> tuple[DataFrame, dict[str, int]]:
    """Byte-level BPE trained for each dataset on its documents; every document is ``<bos> ids <eos>``."""
    enc, sizes = [], {}
    for name in names:
        own = docs.where(F.col("dataset") == name)
        with staged_until(docs.sparkSession):
            vocab, merges = B.train_bpe(B.byte_level_word_counts(own), vocab_size=size)
        sizes[name] = len(vocab)
        enc.append(TK.encode(own, "text", TK.BpeModel(tuple(vocab), tuple(merges)), ("dataset", *order),
                             parts=(([B.BOS_ID], 0), ("A", 0), ([B.EOS_ID], 0))).select("dataset", *order, "ids"))
    return C.flatten_tokens(reduce(DataFrame.unionByName, enc), ["dataset"], list(order), eos=None), sizes


def prepare_datasets(docs: DataFrame, vocabs: Sequence[str], root: str, dataset: str, order: Sequence[str], text: str = "text",
                     per_shard: int = C.TOKENS_PER_SHARD, datasets: Sequence[str] | None = None) -> DataFrame:
    """Write ``{root}/shards/dataset=D/vocab=V/{split}-NNNN.bin`` for every dataset and vocabulary (``char`` or
    the size of a BPE vocabulary, which is trained for each dataset) and return the manifest.

    A vocabulary's pairs are ordered, cut and written in one distributed pass over all datasets; a
    pair's manifest rows are written after all files of the pass: a pair that fails has none and is made again by
    the next call, which skips the pairs that are done.  Tables staged for a pass are deleted at its end.  Only the training of a BPE vocabulary loops
    over the datasets.  A dataset's name is part of its folder's name.  Blank documents are left out; a dataset without text has no pair; a null dataset is no dataset."""
    spark = docs.sparkSession
    rows = C.drop_blank(docs.where(F.col(dataset).isNotNull()).select(F.col(dataset).cast("string").alias("dataset"), *order, F.col(text).alias("text")))
    with staged_until(spark):
        rows = stage_table(rows, "prepare")
        names = sorted(r[0] for r in rows.select("dataset").distinct().collect())
        names = [n for n in names if datasets is None or n in set(datasets)]
        done = {(r[0], r[1]) for r in done_pairs(spark, root).select("dataset", "vocab").distinct().collect()}
        for vocab in vocabs:
            todo = [n for n in names if (n, vocab) not in done]
            if not todo:
                continue
            with staged_until(spark):
                stream, sizes = _char_stream(rows, todo, order) if vocab == "char" else _bpe_stream(rows, todo, order, int(vocab))
                stream = stage_table(stream.withColumn("n_tokens", F.col("n_tokens").cast("long")), "stream")
                shards = C.assemble_shards(C.shard_pieces(C.train_val_split(stream, ["dataset"]), per_shard), ["dataset", "split"])
                wrote = write_bin_shards(shards.withColumn("vocab", F.lit(vocab)), f"{root}/shards", keys=("dataset", "vocab", "split", "shard"))
                told = stage_table(wrote.select(F.regexp_extract("path", "/dataset=(.*)/vocab=", 1).alias("dataset"),
                                                F.regexp_extract("path", "/([a-z]+)-[0-9]+[.]bin$", 1).alias("split"), "n_tokens"), "wrote")
                counts = told.groupBy("dataset", "split").agg(F.count("*").alias("n_shards"), F.sum("n_tokens").alias("n_tokens")).collect()  # two a pair
                for name in todo:
                    mine = [(name, vocab, r["split"], r["n_shards"], r["n_tokens"], sizes[name]) for r in counts if r["dataset"] == name]
                    spark.createDataFrame(mine, MANIFEST).write.mode("overwrite").parquet(f"{root}/manifest/pair={name.encode().hex()}-{vocab}")
    return done_pairs(spark, root)
