"""Work that has to stay bounded on large tables: draws by batch, dealt samples, narrow scans, compact streams."""
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.functions.hashing import draws, uniform, uniform_array
from weft.operators import bpe as B
from weft.operators import corpus as C
from weft.operators import ordering as O
from weft.operators import tasks as TK
from weft.operators import tokenizer as TK2
from weft.plans import batching_q as BQ
from weft.sources.files import read_text_corpus, write_text_files


def test_draws_are_the_uniforms_of_the_column_expression(spark):
    ids = [0, 1, 7, 2**31, 2**32 + 5, -3, 2**62, None]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    cols = [uniform(9, F.col("id"), F.lit(k)) for k in (0, 3, 1002)]
    for r in df.select("id", draws(9, F.col("id"), (0, 3, 1002)).alias("u"), F.array(*cols).alias("want"),
                       draws(9, F.col("id"), (0, 3), 10).alias("n"), TK.slapjack(F.col("id"), 9)[1].alias("acts")).collect():
        assert r.u == r.want and len(r.acts) == 5
        assert r.n == [None if x is None else int(x * 10) for x in r.want[:2]]
    assert uniform_array(9, np.array([], np.int64), np.arange(3)).shape == (0, 3)


def test_samples_of_a_small_file_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(BQ, "SAMPLES_A_TASK", 100)
    for query, n in ((BQ.b23_toy_tasks, 12), (BQ.b38_task_switches, len(BQ.SWITCHED))):
        out = query(spark, str(tmp_path))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 10 and max(sizes) <= 150 * n and sum(sizes) == 1000 * n


def test_unicode_forms_of_more_texts_than_are_strings_at_once(spark):
    texts = [None if k % 7 == 0 else "é" * k + "Å" for k in range(2 * T.TEXTS_AT_ONCE + 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    for r in df.select("k", "t", T.unicode_form("t", "NFC").alias("n")).collect():
        assert r.n == (None if r.t is None else unicodedata.normalize("NFC", r.t))


def test_char_ids_of_a_text_with_many_breaks(spark):
    text = "a\n\n\U0001f600\xffĀ\n" * 4000 + "\n\n"
    want = []
    for k, ch in enumerate(text):
        want.append(ord(ch) if ord(ch) < 256 else 63)
        want += [256] if ch == "\n" and text[k + 1: k + 2] == "\n" else []
    df = spark.createDataFrame([(text,)], "t string")
    plans = df.select(T.encode_char("t").alias("e"))
    assert plans.first().e == want + [256]
    assert plans._jdf.queryExecution().analyzed().toString().count("split(") == 1  # once, not again in the lambda


def test_bytes_are_translated(spark):
    text = "".join(map(chr, range(300))) + "€\U0001f600"
    df = spark.createDataFrame([(text,)], "t string")
    pieces = df.select(B.byte_level_pieces("t", use_regex=False).alias("p"))
    table = B.byte_to_unicode()
    assert pieces.first().p == ["".join(table[b] for b in text.encode())]
    assert "conv(" not in pieces._jdf.queryExecution().analyzed().toString()


def test_batches_are_worked_on_in_slices():
    b = pa.RecordBatch.from_arrays([pa.array(range(2 * TK2.ROWS_AT_ONCE + 1))], names=["x"])
    assert [s.num_rows for s in TK2._slices([b])] == [TK2.ROWS_AT_ONCE, TK2.ROWS_AT_ONCE, 1]


def test_texts_are_not_put_in_order_with_their_sums(spark, monkeypatch):
    seen, blocked = [], O.blocked
    monkeypatch.setattr(O, "blocked", lambda df, *a: seen.append(df.columns) or blocked(df, *a))
    df = spark.createDataFrame([(k % 3 or None, k, "x" * k) for k in range(50)], "g int, k int, t string")
    got = {r.k: (r.at, len(r.t)) for r in O.prefix_sum(df, ["g"], ["k"], "k", "at", exclusive=True).collect()}
    assert got == {k: (sum(j for j in range(k) if j % 3 == k % 3), k) for k in range(50)}
    assert all("t" not in c for c in seen)


def test_streams_kept_as_text_have_the_same_shards_and_windows(spark):
    df = spark.createDataFrame([("a", k, "é€x\U0001f600" * (k % 5 + 1)) for k in range(30)] + [("b", 0, "xy")], "s string, k int, piece string")
    text = C.encoded_stream(df, ["s"], ["k"])
    assert text.schema["ids"].dataType.simpleString() == "string"
    ids = C.flatten_tokens(df.withColumn("ids", T.char_ids("piece")).drop("piece"), ["s"], ["k"])
    for of in (lambda x: C.assemble_shards(C.shard_pieces(C.train_val_split(x, ["s"]), 50), ["s", "split"]),
               lambda x: C.context_windows(C.shard_pieces(x, 50), ["s"], 8).select("s", "shard", "win", "tokens"),
               lambda x: C.next_token_windows(C.shard_pieces(x, 50), ["s"], 8).select("s", "shard", "win", "tokens")):
        assert sorted(map(tuple, of(text).collect())) == sorted(map(tuple, of(ids).collect()))


def test_text_files_are_listed_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([(k, "ü" * (k % 4)) for k in range(300)], "k int, t string")
    write_text_files(df, f"{tmp_path}/c", "k", "t").collect()
    folders = {p.parent for p in tmp_path.glob("c/*/*.txt")}
    assert len(folders) > 100
    back = read_text_corpus(spark, f"{tmp_path}/c/*/*.txt")
    assert back.rdd.getNumPartitions() == len(folders)
    assert sorted(r.text for r in back.collect()) == sorted("ü" * (k % 4) for k in range(300) if k % 4)  # empty files: none, as by Spark
    one = read_text_corpus(spark, f"{next(iter(folders))}/*.txt").collect()
    assert one and all(r.path.startswith("file:") for r in one)
