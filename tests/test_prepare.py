"""Datasets under several vocabularies: files, manifest, a failed pair."""
import pytest
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import batching as B
from weft.operators import bpe, prepare
from weft.sources.files import read_bin_shards


def test_pairs_are_prepared_once_and_a_failed_pair_has_no_row(spark, tmp_path, monkeypatch):
    rows = [("a", 2, "second one\n\nwith two parts"), ("a", 1, "the first one"), ("b", 3, "the third one, the third"), ("b", 4, " \n"), (None, 5, "no set"), ("c", 6, "")]
    docs, root = spark.createDataFrame(rows, "set string, id long, text string"), f"{tmp_path}/out"
    run = lambda: prepare.prepare_datasets(docs, ["280", "char"], root, "set", ["id"], per_shard=10)
    real = prepare.write_bin_shards

    def failing(shards, *a, **k):
        if shards.select("vocab").first()[0] == "char":
            raise RuntimeError("lost")
        return real(shards, *a, **k)

    monkeypatch.setattr(prepare, "write_bin_shards", failing)
    with pytest.raises(RuntimeError, match="lost"):
        run()
    before = {(r.dataset, r.vocab) for r in prepare.done_pairs(spark, root).collect()}
    assert before == {("a", "280"), ("b", "280")}
    monkeypatch.setattr(prepare, "write_bin_shards", real)
    m = {(r.dataset, r.vocab, r.split): (r.n_shards, r.n_tokens, r.vocab_size) for r in run().collect()}
    assert {k[:2] for k in m} == {("a", "char"), ("a", "280"), ("b", "char"), ("b", "280")}
    char = [ord(c) for c in "the first one"] + [256] + [ord(c) for c in "second one"] + [256] + [ord(c) for c in "with two parts"] + [256]
    files = {(*r.path.split("/")[-3:-1], r.split, r.shard): list(r.tokens) for r in read_bin_shards(spark, f"{root}/shards").collect()}
    got = [t for k in sorted(files) if k[:3] == ("dataset=a", "vocab=char", "train") for t in files[k]]
    cut = max(1, int(len(char) * 0.95))
    assert got == char[:cut] and m["a", "char", "train"] == (-(-cut // 10), cut, 257)
    assert m["a", "char", "val"] == (1, len(char) - cut, 257)
    own = spark.createDataFrame([r for r in rows if r[0] == "b" and r[2].strip()], docs.schema)
    vocab, _ = bpe.train_bpe(bpe.word_counts(own, bpe.byte_level_pieces), vocab_size=280)
    first = files["dataset=b", "vocab=280", "train", 0]
    assert first[0] == bpe.BOS_ID and max(first) < len(vocab) == m["b", "280", "train"][2]
    assert not [p for p in (tmp_path / "out" / "shards").rglob(".*") if not p.name.endswith(".crc")]  # nothing half written


def test_char_keys_are_equal_where_sequences_are(spark):
    texts = ["", "a", "é", "ÿ", "ā", "中", "?", "??", "中ā", "a\nb", "a b", "a\x00b", "\U0001F600", "?\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", B.char_sequence_key(F.lit("d"), "t").alias("k"),
                     B.sequence_key(F.lit("d"), F.array().cast("array<int>"), T.char_ids(F.col("t"))).alias("s")).collect()
    assert all(len(r.k) == 16 for r in rows)
    for x in rows:
        for y in rows:
            assert (x.k == y.k) == (x.s == y.s), (x.t, y.t)


def test_passes_leave_shards_and_manifest_but_no_staged_tables(spark, tmp_path):
    import glob

    from weft.session import checkpoint_dir
    staged = lambda: set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/stage/*"))
    docs = spark.createDataFrame([(i, "ab"[i % 2], f"one two three {i} " * 20) for i in range(8)], "id long, lang string, text string")
    were = staged()
    made = prepare.prepare_datasets(docs, ("char", "270"), f"{tmp_path}/out", "lang", ["id"]).collect()
    assert staged() == were
    files = glob.glob(f"{tmp_path}/out/shards/*/*/*.bin")
    assert {(r.dataset, r.vocab) for r in made} == {(d, v) for d in "ab" for v in ("char", "270")} and sum(r.n_shards for r in made) == len(files)
