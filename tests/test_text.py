"""Corpus text functions on the hand-made fixture (FIXTURES.md section 3)."""
from pyspark.sql import functions as F

from weft.functions import text as T

TINY = "Hello\r\n\r\nwörld 😀\n\n\nNBSP here\n\n   \n\nlast"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_split_paragraphs(spark):
    assert one(spark, T.split_paragraphs(F.lit(TINY))) == ["Hello", "wörld 😀", "NBSP here", "last"]


def test_chunk_text(spark):
    assert one(spark, T.chunk_text(F.lit(""), 4)) == [""]
    assert one(spark, T.chunk_text(F.lit("abcdefghij"), 4)) == ["abcd", "efgh", "ij"]
    assert one(spark, T.chunk_text(F.lit("a😀bc"), 2)) == ["a😀", "bc"]  # code points


def test_encode_char_eos_rules(spark):
    ids = one(spark, T.encode_char(F.lit("a\n\nb€")))
    assert ids == [97, 10, 256, 10, 98, 63, 256]
    assert one(spark, T.encode_char(F.lit("x\n\n"))) == [120, 10, 256, 10, 256]


def test_decode_char(spark):
    assert one(spark, T.decode_char(F.array(*[F.lit(i) for i in [72, 32, 105, 256, 300]]))) == "H␣i<eos><unk>"


def test_pretokenizers(spark):
    s = F.lit("Hi, you there!")
    assert one(spark, T.pretokenize_whitespace_split(s)) == ["Hi,", "you", "there!"]
    assert one(spark, T.pretokenize_whitespace(F.lit("Hi, you!"))) == ["Hi", ",", "you", "!"]
    assert one(spark, T.pretokenize_metaspace(F.lit("a b"))) == ["▁a▁b"]
    assert one(spark, T.pretokenize_metaspace(F.lit("a"), prepend_scheme="first", section_index=1)) == ["a"]


def test_split_lines_fallback(spark):
    assert one(spark, T.split_lines(F.lit("a\r\n \nb"))) == ["a", "b"]
    assert one(spark, T.split_lines(F.lit("  "))) == ["  "]
