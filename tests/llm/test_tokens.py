"""SentencePiece codec, token files and the separator scan against the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import ODD, docs
from weft.llm import piece_codec, queries, token_scan, token_store

SF = "/root/testdata/sf0.001"
MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def bpe():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_pieces(sp, rows):
    out = []
    for i, t in rows:
        ids = sp.encode(t or "") + [sp.eos_id()]
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    return out


def test_pieces_whole_table(spark, sp):
    got = [tuple(r)[:4] for r in queries.op2_sentencepiece(spark, SF).collect()]
    assert sorted(got) == sorted(plain_pieces(sp, texts(spark)))


def test_pieces_odd_rows(spark, sp):
    df = piece_codec.encode(docs(spark, ODD).drop("ids"), MODEL, outputs=("ids", "starts", "ends", "decoded"), keep=("doc_id", "text"))
    rows = df.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = r.text or ""
        assert r.ids == sp.encode(text) + [sp.eos_id()] and r.decoded == sp.decode(r.ids)
        raw = text.encode()
        spans = list(zip(r.starts, r.ends))[:-1]
        assert [s for s, _ in spans] == [0, *[e for _, e in spans]][:len(spans)]  # spans tile the text
        assert not spans or spans[-1][1] == len(raw)
        for i, (s, e) in zip(r.ids, spans):
            if not sp.is_byte(i):
                assert sp.id_to_piece(i).removeprefix("▁" if s == 0 and not raw[:1] in (b" ",) else "").replace("▁", " ") \
                    == raw[s:e].decode().replace("▁", " ") or s == 0
            else:
                assert raw[s:e] == bytes([int(sp.id_to_piece(i)[3:5], 16)])
    again = piece_codec.decode(df.select("ids"), MODEL).collect()
    assert [r.decoded for r in again] == [r.decoded for r in rows]
    assert piece_codec.encode(docs(spark, []), MODEL).count() == 0
    with pytest.raises(ValueError):
        piece_codec.encode(docs(spark, ODD), MODEL, keep=("doc_id", "ids"))


def test_unit_cache_overflow(monkeypatch, sp):
    monkeypatch.setattr(piece_codec, "UNITS", 3)
    c = piece_codec.PieceCodec(MODEL)
    assert c.units is not None
    texts = [t or "" for _, t in ODD]
    for _ in range(2):
        for t, (ids, decimal) in zip(texts, c.encode(pa.array(texts))):
            assert ids.tolist() == sp.encode(t) + [2] and decimal == " ".join(map(str, ids.tolist()))
        assert len(c.cache.young) <= 3 and len(c.cache.older) <= 3


def test_byte_units(bpe):
    """Texts made of hard pieces: units must never be cut where a token could cross."""
    import random

    from weft.llm import subword_units
    b, rng = subword_units.ByteBpe(BPE), random.Random(2)
    bits = ["a", "B9", "é", "ß", "'s", "'", "’s", ",", "...", "_", "x_y", "½", "Ⅷ", "日本", "\u0301", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c",
            "\x85", "-", "$", "%%%", "👩‍👧", "<|endoftext|>", "we'll", "I'M", "\u200b", "ΑΒ", "12"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(3000)]
    for t, ids in zip(texts, b.ids(pa.array(texts))):
        assert ids.tolist() == bpe.encode(t, add_special_tokens=False).ids, t


def test_slices():
    from weft.llm import subword_units
    n, old = [0, 5, 3, 40, 1, 1, 0, 9], subword_units.SLICE_BYTES
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["é"[:0] + "x" * k for k in n])], names=["i", "t"])
    subword_units.SLICE_BYTES = 9
    got = [s.column(0).to_pylist() for s in subword_units.slices(batch, 1)]
    subword_units.SLICE_BYTES = old
    assert sum(got, []) == list(range(8)) and len(got) > 2 and list(subword_units.slices(batch.slice(0, 0), 1)) == []


def test_piece_units(sp):
    import random
    c, rng = piece_codec.PieceCodec(MODEL), random.Random(3)
    bits = ["a", "the", " ", "  ", "▁", "\n", ",", "日", "é", "\u0301", "👩‍👧", "x", "ing", "\t", "\u00a0", "</s>", "1"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 14))) for _ in range(3000)]
    for t, (ids, _) in zip(texts, c.encode(pa.array(texts))):
        assert ids.tolist() == sp.encode(t) + [2], t


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_longest_prefix_normalisation_with_a_real_map(rule):
    """The compiled character maps that the library carries, with their offsets."""
    from sentencepiece import sentencepiece_model_pb2
    norm = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.ModelProto.FromString(norm.serialized_model_proto()).normalizer_spec
    c = object.__new__(piece_codec.PieceCodec)
    c.spec, c.map, c.plain = spec, piece_codec.CharMap(spec.precompiled_charsmap), False
    for text in ["Ｆｕｌｌ　ｗｉｄｔｈ ﬁne ½ ①", "é é Å ﷺ", "  two  spaces ", "", "   ", "한글 ｶﾞ x", *[t for _, t in ODD if t and "\x00" not in t]]:
        for squeeze, prefix in [(True, False), (False, False), (True, True)]:
            spec.remove_extra_whitespaces, spec.add_dummy_prefix = squeeze, prefix
            lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze,
                                                        escape_whitespaces=spec.escape_whitespaces)
            want, offsets = lib.normalize(text, with_offsets=True)
            got, align = c.normalize(text)
            assert got.decode() == want, (text, squeeze, prefix)
            starts = [len(want[:k].encode()) for k in range(len(want))]
            chars = [len(text.encode()[:align[s]].decode()) for s in starts]
            assert chars == list(offsets)[:len(want)], (text, squeeze, prefix)


def plain_ids(bpe, rows):
    return [(i, bpe.encode(t or "", add_special_tokens=False).ids) for i, t in rows]


def test_token_files_whole_table(spark, bpe):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op4_token_output(spark, SF).collect()}
    start = 0
    for i, ids in sorted(plain_ids(bpe, texts(spark))):
        ids = ids + [0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_odd_rows(spark, bpe):
    files = token_store.write_tokens(docs(spark, ODD), BPE, 0, files=3)
    want = sorted(((i, [*ids, 0]) for i, ids in plain_ids(bpe, ODD)), key=str)
    assert sorted(((r.doc_id, r.ids) for r in token_store.read_rows(spark, files).collect()), key=str) == want
    back = sorted(token_store.read_back(files).collect(), key=lambda r: r.start)
    assert [r.start for r in back] == np.cumsum([0] + [r.n_tokens for r in back[:-1]]).tolist()
    assert [r.doc_id for r in back] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    assert [r.ids for r in token_store.read_rows(spark, files, [6]).collect()] == [[*bpe.encode("one").ids, 0]]
    none = token_store.write_tokens(docs(spark, []), BPE, 0, files=2)
    assert token_store.read_back(none).count() == 0 and token_store.read_rows(spark, none).count() == 0


def test_token_files_recognise_added_tokens(spark, tmp_path):
    """Against the library with nothing set: op4's ids of texts that hold an added token's content."""
    rows = [*ODD, (20, "a <|endoftext|> b"), (21, "<|endoftext|>"), (22, "x<|endoftext|><|endoftext|>\n y  <|endoftext"), (23, "after it all")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    lib, start = Tokenizer.from_file(BPE), 0
    assert lib.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = sorted(queries.op4_token_output(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")), strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_file_format(spark, monkeypatch):
    """Delta pages without dictionary for ids, row groups of about the set size, page indexes, pruned reads."""
    import pyarrow.parquet as pq
    monkeypatch.setattr(token_store, "GROUP_IDS", 20_000)
    files = token_store.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), BPE, 0, files=1)
    meta = pq.ParquetFile(files.first().file.removeprefix("file:")).metadata
    assert meta.num_rows == 200 and meta.num_row_groups > 3
    cols = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids = cols["ids.list.element"]
    assert "DELTA_BINARY_PACKED" in ids.encodings and not ids.has_dictionary_page and all(c.has_offset_index for c in cols.values())
    plan = token_store.read_rows(spark, files, [5]).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan


def test_counts_whole_table(spark, bpe):
    got = sorted(tuple(r) for r in queries.op8_token_counts(spark, SF).collect())
    assert got == sorted((i, len(ids)) for i, ids in plain_ids(bpe, texts(spark)))


def test_scan_stitches_blocks(spark, bpe, monkeypatch):
    monkeypatch.setattr(token_scan, "SPAN", 3)
    wrote = token_scan.write_flat(docs(spark, ODD).repartition(2), BPE, 50256)
    for block in (1, 7, 64):
        found = token_scan.scan_flat(spark, wrote.select("file", "width").distinct(), 50256, block_ids=block)
        got = sorted(((r.doc_id, r.n_tokens) for r in wrote.join(found, ["file", "nth"]).collect()), key=str)
        assert got == sorted(((i, len(ids)) for i, ids in plain_ids(bpe, ODD)), key=str)
    assert token_scan.token_counts(docs(spark, []), BPE, 50256).count() == 0


def test_scan_of_foreign_files(spark, tmp_path):
    """32-bit ids, an open last document, empty documents and an empty file."""
    (tmp_path / "a.bin").write_bytes(np.array([9, 9, 5, 9, 1, 2, 3], "<u4").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}.bin", 4) for n in "ab"], "file string, width int")
    for block in (1, 2, 100):
        got = sorted((r.nth, r.start, r.n_tokens) for r in token_scan.scan_flat(spark, files, 9, block).collect())
        assert got == [(0, 0, 0), (1, 1, 0), (2, 2, 1), (3, 4, 3)]
    gone = spark.createDataFrame([(f"file://{tmp_path}/none.bin", 4)], "file string, width int")
    with pytest.raises(Exception, match="token files are gone"):
        token_scan.scan_flat(spark, gone, 9)
