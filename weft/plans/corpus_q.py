"""Registered corpus-preparation queries (section A) over ``documents`` / ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators import corpus as C
from weft.operators import bpe as B
from weft.operators import tokenizer as TK
from weft.plans import sqlfrag as Q
from weft.plans.catalog import REGISTRY, register
from weft.session import checkpoint_dir, stage_table, staged_until
from weft.sources.tables import Tables

KEYS = ["source"]
ORDER = ["doc_id", "para_idx", "chunk_idx"]
CONTEXT = 64
SEQ_LEN = 128
SHARD = C.TOKENS_PER_SHARD_UPLOAD


def ids_md5(c):
    """md5 of the comma-joined ids (same text as DuckDB's array_to_string)."""
    return F.md5(F.array_join(c.cast("array<string>"), ","))


def docs(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", "source", "text")


def char_stream(spark, sf_dir, eos=T.CHAR_EOS):
    """documents -> non-blank -> paragraphs -> 4000-char chunks -> char ids -> stream offsets.

    The token stream is the staging table of the corpus pipeline: it is written
    once to the checkpoint folder and every shard / window / split reads it."""
    pieces = C.paragraph_pieces(C.drop_blank(docs(spark, sf_dir)))
    return stage_table(C.encoded_stream(pieces, KEYS, ORDER, eos=eos), "token-stream")


@register("corpus_windows", "A-03 A-05 A-06 A-08 A-28 A-29 A-31 A-36 B-11", sql=f"""
WITH {Q.pieces_cte()}, {Q.stream_cte()},
sh AS (SELECT source, pos // {SHARD} AS shard, pos % {SHARD} AS off, tok FROM toks),
shl AS (SELECT *, COUNT(*) OVER (PARTITION BY source, shard) AS shard_len FROM sh),
win AS (SELECT source, shard, off // {CONTEXT} AS win, tok FROM shl WHERE off // {CONTEXT} < shard_len // {CONTEXT}),
s1 AS (SELECT source, CAST(COUNT(*) AS BIGINT) AS n_pieces, CAST(SUM(n_tokens) AS BIGINT) AS n_stream_tokens
       FROM stream GROUP BY source),
s2 AS (SELECT source, CAST(COUNT(DISTINCT shard) AS BIGINT) AS n_shards FROM sh GROUP BY source),
s3 AS (SELECT source, CAST(COUNT(DISTINCT (shard, win)) AS BIGINT) AS n_windows,
              CAST(COUNT(*) AS BIGINT) AS n_window_tokens, CAST(COUNT(DISTINCT tok) AS BIGINT) AS n_distinct_ids
       FROM win GROUP BY source)
SELECT s1.source, n_pieces, n_stream_tokens, n_shards, COALESCE(n_windows, 0) AS n_windows,
       COALESCE(n_window_tokens, 0) AS n_window_tokens, COALESCE(n_distinct_ids, 0) AS n_distinct_ids,
       CAST(COALESCE(n_window_tokens, 0) - COALESCE(n_windows, 0) AS BIGINT) AS n_target_tokens
FROM s1 JOIN s2 USING (source) LEFT JOIN s3 USING (source)
""")
def corpus_windows(spark, sf_dir):
    """Flagship: text -> pieces -> char ids -> stream -> 100k-token shards -> 64-token
    windows -> (input, target) examples; per-dataset counts."""
    stream = char_stream(spark, sf_dir)
    shards = C.shard_pieces(stream, SHARD)
    win = C.context_windows(shards, KEYS, CONTEXT)
    inp, tgt = C.shift_targets("tokens")
    ex = win.select("source", "shard", "win", inp.alias("input"), tgt.alias("target"), "tokens")
    s1 = stream.groupBy("source").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_stream_tokens"))
    s2 = shards.groupBy("source").agg(F.countDistinct("shard").alias("n_shards"))
    s3 = ex.groupBy("source").agg(F.count("*").alias("n_windows"),
                                   F.sum(F.size("input") + 1).cast("long").alias("n_window_tokens"),
                                   F.sum(F.size("target")).cast("long").alias("n_target_tokens"))
    ids = (ex.select("source", F.explode("tokens").alias("tok")).groupBy("source", "tok").count()
           .groupBy("source").agg(F.count("*").alias("n_distinct_ids")))
    return (s1.join(s2, "source").join(s3, "source", "left").join(ids, "source", "left")
            .select("source", "n_pieces", "n_stream_tokens", "n_shards",
                    F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
                    F.coalesce("n_window_tokens", F.lit(0)).cast("long").alias("n_window_tokens"),
                    F.coalesce("n_distinct_ids", F.lit(0)).cast("long").alias("n_distinct_ids"),
                    F.coalesce("n_target_tokens", F.lit(0)).cast("long").alias("n_target_tokens")))


MAX_CHARS = 20000


@register("a02_sample_until_chars", "A-02 A-03", sql=f"""
SELECT source, doc_id, CAST(running_chars AS BIGINT) AS running_chars,
       CAST(length({Q.js_trim('text')}) AS BIGINT) AS kept_chars
FROM (SELECT *, SUM(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS running_chars
      FROM documents WHERE {Q.not_blank('text')})
WHERE running_chars - length(text) < {MAX_CHARS}
""")
def a02_sample_until_chars(spark, sf_dir):
    d = C.sample_until_chars(docs(spark, sf_dir), KEYS, ["doc_id"], MAX_CHARS)
    return d.select("source", "doc_id", "running_chars", F.length("text").cast("long").alias("kept_chars"))


@register("a04_assemble_corpus", "A-02 A-04", sql=f"""
WITH s AS (SELECT source, doc_id, {Q.js_trim('text')} AS t FROM documents WHERE {Q.not_blank('text')}),
o AS (SELECT *, COALESCE(SUM(length(t) + 2) OVER (PARTITION BY source ORDER BY doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start,
             doc_id = MAX(doc_id) OVER (PARTITION BY source) AS last_doc FROM s),
p AS (SELECT source, doc_id, char_start, CASE WHEN last_doc THEN t ELSE t || chr(10) || chr(10) END AS piece FROM o)
SELECT source, doc_id, CAST(char_start AS BIGINT) AS char_start, CAST(length(piece) AS BIGINT) AS piece_chars,
       md5(piece) AS piece_md5 FROM p
""")
def a04_assemble_corpus(spark, sf_dir):
    d = C.drop_blank(docs(spark, sf_dir)).withColumn("text", T.js_trim(F.col("text")))
    a = C.assemble_corpus(d, KEYS, ["doc_id"])
    return a.select("source", "doc_id", "char_start", F.length("piece").cast("long").alias("piece_chars"),
                    F.md5("piece").alias("piece_md5"))


@register("a05_split_paragraphs", "A-05", sql=f"""
SELECT doc_id, CAST(para_idx AS INTEGER) AS para_idx, CAST(length(para) AS INTEGER) AS para_chars, md5(para) AS para_md5
FROM (SELECT doc_id, unnest(l) AS para, unnest(range(len(l))) AS para_idx
      FROM (SELECT doc_id, {Q.split_paragraphs('text')} AS l FROM documents))
""")
def a05_split_paragraphs(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_paragraphs(F.col("text"))).alias("para_idx", "para"))
    return d.select("doc_id", "para_idx", F.length("para").alias("para_chars"), F.md5("para").alias("para_md5"))


@register("a06_chunk_text", "A-06", sql=f"""
SELECT doc_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(length(chunk) AS INTEGER) AS chunk_chars, md5(chunk) AS chunk_md5
FROM (SELECT doc_id, unnest(c) AS chunk, unnest(range(len(c))) AS chunk_idx
      FROM (SELECT doc_id, {Q.chunk_text('text', 1000)} AS c FROM documents))
""")
def a06_chunk_text(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(T.chunk_text(F.col("text"), 1000)).alias("chunk_idx", "chunk"))
    return d.select("doc_id", "chunk_idx", F.length("chunk").alias("chunk_chars"), F.md5("chunk").alias("chunk_md5"))


@register("a07_split_lines", "A-07", sql=f"""
SELECT doc_id, CAST(line_idx AS INTEGER) AS line_idx, md5(line) AS line_md5
FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_idx
      FROM (SELECT doc_id, CASE WHEN len(f) > 0 THEN f ELSE [text] END AS l
            FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\\r\\n|\\n|\\r'),
                         lambda x: length({Q.js_trim('x')}) > 0) AS f FROM documents)))
""")
def a07_split_lines(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_lines(F.col("text"))).alias("line_idx", "line"))
    return d.select("doc_id", "line_idx", F.md5("line").alias("line_md5"))


@register("a08_encode_char", "A-08", sql=f"""
WITH c AS (SELECT doc_id, string_split(text, '') AS ch FROM documents),
e AS (SELECT doc_id, flatten(list_transform(ch, lambda x, i:
        CASE WHEN x = chr(10) AND i < len(ch) AND ch[i + 1] = chr(10) THEN [10, 256]
             ELSE [CASE WHEN unicode(x) < 256 THEN unicode(x) ELSE 63 END] END)) AS ids FROM c),
f AS (SELECT doc_id, CASE WHEN len(ids) > 0 AND ids[-1] = 256 THEN ids ELSE list_concat(ids, [256]) END AS ids FROM e)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_ids, CAST(list_sum(ids) AS BIGINT) AS id_sum,
       CAST(len(list_filter(ids, lambda x: x = 256)) AS INTEGER) AS n_eos, md5(array_to_string(ids, ',')) AS ids_md5
FROM f
""")
def a08_encode_char(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.encode_char(F.col("text")).alias("ids"))
    return d.select("doc_id", F.size("ids").alias("n_ids"),
                    F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
                    (F.size("ids") - F.size(F.array_remove("ids", 256))).alias("n_eos"), ids_md5(F.col("ids")).alias("ids_md5"))


@register("a09_normalize_text", "A-09", sql=f"""
SELECT doc_id, md5('▁' || regexp_replace(regexp_replace(lower(text), '^{Q.JS_SPACE}+', ''), '{Q.JS_SPACE}+$', '')) AS norm_md5
FROM documents
""")
def a09_normalize_text(spark, sf_dir):
    n = T.normalize_text(F.col("text"), lowercase=True, strip_left=True, strip_right=True, prepend="▁")
    return docs(spark, sf_dir).select("doc_id", F.md5(n).alias("norm_md5"))


@register("a09_unicode_forms", "A-09", sql=f"""
WITH n AS (SELECT doc_id, nfc_normalize('e' || chr(769) || coalesce(text, '') || chr(8491)) AS c FROM documents)
SELECT doc_id, md5(c) AS nfc_md5, md5(c) AS through_nfd_md5, md5('▁' || regexp_replace(lower(c), '^{Q.JS_SPACE}+', '')) AS steps_md5 FROM n
""")
def a09_unicode_forms(spark, sf_dir):
    """Documents between two composable characters: composed, decomposed and composed again, and a sequence of steps."""
    t = F.concat(F.lit("e\u0301"), F.coalesce("text", F.lit("")), F.lit("\u212b"))
    return docs(spark, sf_dir).select("doc_id", F.md5(T.unicode_form(t, "NFC")).alias("nfc_md5"),
                                      F.md5(T.normalize_sequence(t, ["NFD", "NFC"])).alias("through_nfd_md5"),
                                      F.md5(T.normalize_sequence(t, ["NFC", "lower", "strip_left", ("prepend", "▁")])).alias("steps_md5"))


def _pieces_sql(expr):
    return f"SELECT doc_id, CAST(len(p) AS INTEGER) AS n_pieces, md5(array_to_string(p, '|')) AS pieces_md5 FROM (SELECT doc_id, {expr} AS p FROM documents)"


def _pieces(spark, sf_dir, fn):
    d = docs(spark, sf_dir).select("doc_id", fn(F.col("text")).alias("p"))
    return d.select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "|")).alias("pieces_md5"))


@register("a11_pretokenize_whitespace", "A-11", sql=_pieces_sql("regexp_extract_all(text, '\\w+|[^\\w\\s]+')"))
def a11_pretokenize_whitespace(spark, sf_dir):
    return _pieces(spark, sf_dir, T.pretokenize_whitespace)


@register("a12_pretokenize_whitespace_split", "A-12",
          sql=_pieces_sql(f"regexp_extract_all(text, '[^{Q.JS_SPACE[1:-1]}]+')"))
def a12_pretokenize_whitespace_split(spark, sf_dir):
    return _pieces(spark, sf_dir, T.pretokenize_whitespace_split)


@register("a13_pretokenize_metaspace", "A-13", sql=_pieces_sql(
    "[CASE WHEN starts_with(replace(text, ' ', '▁'), '▁') THEN replace(text, ' ', '▁') ELSE '▁' || replace(text, ' ', '▁') END]"))
def a13_pretokenize_metaspace(spark, sf_dir):
    return _pieces(spark, sf_dir, T.pretokenize_metaspace)


@register("a14_pretokenize_sequence", "A-14", sql=_pieces_sql(
    f"flatten(list_transform(regexp_extract_all(text, '[^{Q.JS_SPACE[1:-1]}]+'), "
    "lambda w: regexp_extract_all(w, '\\w+|[^\\w\\s]+')))"))
def a14_pretokenize_sequence(spark, sf_dir):
    return _pieces(spark, sf_dir, lambda c: T.pretokenize_sequence(c, T.pretokenize_whitespace_split,
                                                                    T.pretokenize_whitespace))


WORDS_SQL = "(SELECT unnest(regexp_extract_all(text, '\\w+|[^\\w\\s]+')) AS word FROM documents)"


@register("a16_word_counts", "A-16", sql=f"SELECT word, CAST(COUNT(*) AS BIGINT) AS freq FROM {WORDS_SQL} GROUP BY word")
def a16_word_counts(spark, sf_dir):
    return B.word_counts(docs(spark, sf_dir), T.pretokenize_whitespace)


@register("a17_pair_counts", "A-17", sql=f"""
WITH w AS (SELECT word, COUNT(*) AS freq FROM {WORDS_SQL} GROUP BY word),
s AS (SELECT string_split(word, '') AS sym, freq FROM w),
p AS (SELECT unnest(list_transform(range(1, len(sym)), lambda i: sym[i])) AS a,
             unnest(list_transform(range(1, len(sym)), lambda i: sym[i + 1])) AS b, freq FROM s WHERE len(sym) > 1)
SELECT a AS left_sym, b AS right_sym, CAST(SUM(freq) AS BIGINT) AS freq FROM p GROUP BY a, b
""")
def a17_pair_counts(spark, sf_dir):
    wc = B.word_counts(docs(spark, sf_dir), T.pretokenize_whitespace)
    return B.pair_counts(wc.withColumn("symbols", F.split("word", "")))


@register("a22_tokens_to_ids", "A-22 A-23 B-01", sql=f"""
WITH w AS (SELECT word, COUNT(*) AS freq FROM {WORDS_SQL} GROUP BY word),
v AS (SELECT word, CAST(ROW_NUMBER() OVER (ORDER BY freq DESC, word) - 1 + 5 AS BIGINT) AS id FROM w WHERE freq >= 20),
d AS (SELECT doc_id, unnest(p) AS word, unnest(range(len(p))) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '\\w+|[^\\w\\s]+') AS p FROM documents)),
j AS (SELECT doc_id, pos, COALESCE(v.id, 0) AS id FROM d LEFT JOIN v USING (word))
SELECT doc_id, CAST(COUNT(*) + 2 AS INTEGER) AS n_ids, CAST(SUM(CASE WHEN id = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_unk,
       md5(array_to_string(list_concat([2], list(id ORDER BY pos), [3]), ',')) AS ids_md5
FROM j GROUP BY doc_id
""")
def a22_tokens_to_ids(spark, sf_dir):
    d = docs(spark, sf_dir)
    wc = B.word_counts(d, T.pretokenize_whitespace)
    vocab = B.frequency_vocab(wc, min_freq=20, first_id=5)
    pieces = d.select("doc_id", F.posexplode(T.pretokenize_whitespace(F.col("text"))).alias("pos", "word"))
    ids = B.tokens_to_ids(pieces, vocab, unk_id=0)
    enc = ids.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_p"),
                                    F.sum(F.when(F.col("id") == 0, 1).otherwise(0)).cast("long").alias("n_unk"))
    enc = enc.withColumn("ids", B.post_process(F.col("_p.id"), bos=2, eos=3))
    return enc.select("doc_id", F.size("ids").alias("n_ids"), "n_unk", ids_md5(F.col("ids")).alias("ids_md5"))


PAD_LEN = 48


@register("a24_pad_truncate", "A-24", sql=f"""
WITH c AS (SELECT doc_id, {Q.char_ids('text')} AS ids FROM documents),
r AS (SELECT doc_id, CASE WHEN len(ids) >= {PAD_LEN} THEN ids[1:{PAD_LEN}]
                     ELSE list_concat(ids, list_transform(range({PAD_LEN} - len(ids)), lambda i: 1)) END AS right_ids,
             CASE WHEN len(ids) >= {PAD_LEN} THEN ids[1:{PAD_LEN}]
                  ELSE list_concat(list_transform(range({PAD_LEN} - len(ids)), lambda i: 1), ids) END AS left_ids,
             CASE WHEN len(ids) >= {PAD_LEN} THEN {PAD_LEN} ELSE len(ids) END AS n_real FROM c)
SELECT doc_id, md5(array_to_string(right_ids, ',')) AS right_md5, md5(array_to_string(left_ids, ',')) AS left_md5,
       CAST(n_real AS INTEGER) AS n_attended FROM r
""")
def a24_pad_truncate(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.char_ids(F.col("text")).alias("ids"))
    r_ids, r_mask = B.pad_truncate(F.col("ids"), PAD_LEN, pad_id=1, side="right")
    l_ids, _ = B.pad_truncate(F.col("ids"), PAD_LEN, pad_id=1, side="left")
    return d.select("doc_id", ids_md5(r_ids).alias("right_md5"), ids_md5(l_ids).alias("left_md5"),
                    F.aggregate(r_mask, F.lit(0), lambda a, x: a + x).alias("n_attended"))


@register("a26_decode_char", "A-26", sql=f"""
SELECT doc_id, md5(array_to_string(list_transform({Q.char_ids('text')},
        lambda i: CASE WHEN i = 32 THEN '␣' ELSE chr(i) END), '')) AS decoded_md5 FROM documents
""")
def a26_decode_char(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", T.char_ids(F.col("text")).alias("ids"))
    return d.select("doc_id", F.md5(T.decode_char(F.col("ids"))).alias("decoded_md5"))


@register("a27_chat_format", "A-27", sql="""
WITH p AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece
           FROM conversations
           UNION ALL SELECT conv_id, CAST(MAX(turn) + 1 AS BIGINT), '<|assistant|>' || chr(10) FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, CAST(COALESCE(SUM(length(piece)) OVER (PARTITION BY conv_id ORDER BY turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, md5(piece) AS piece_md5 FROM p
""")
def a27_chat_format(spark, sf_dir):
    c = C.chat_format(Tables(spark, sf_dir).conversations, add_generation_prompt=True)
    return c.select("conv_id", "turn", "char_start", F.md5("piece").alias("piece_md5"))


SPLIT_SQL = f"""
WITH {Q.pieces_cte()}, {Q.stream_cte()},
n AS (SELECT source, COUNT(*) AS n, GREATEST(1, CAST(FLOOR(COUNT(*) * 0.95) AS BIGINT)) AS cut FROM toks GROUP BY source),
vr AS (SELECT source, n, cut, CASE WHEN cut < n THEN cut ELSE n - LEAST(1024, n) END AS vlo FROM n),
sp AS (SELECT t.source, 'train' AS split, pos AS spos, tok FROM toks t JOIN vr USING (source) WHERE pos < cut
       UNION ALL
       SELECT t.source, 'val', pos - vlo, tok FROM toks t JOIN vr USING (source) WHERE pos >= vlo AND pos < n)"""


@register("a30_train_val_split", "A-30", sql=f"""{SPLIT_SQL}
SELECT source, split, CAST(COUNT(*) AS BIGINT) AS n_tokens, CAST(SUM(tok) AS BIGINT) AS token_sum FROM sp GROUP BY source, split
""")
def a30_train_val_split(spark, sf_dir):
    s = C.train_val_split(char_stream(spark, sf_dir), KEYS)
    return s.groupBy("source", "split").agg(F.sum("n_tokens").alias("n_tokens"),
                                            F.sum(F.aggregate(T.code_points("ids"), F.lit(0).cast("long"), lambda a, x: a + x)).alias("token_sum"))


@register("a31_shard_tokens", "A-31", sql=f"""{SPLIT_SQL}
SELECT source, split, CAST(spos // {SHARD} AS BIGINT) AS shard, CAST(COUNT(*) AS BIGINT) AS n_tokens,
       md5(array_to_string(list(tok ORDER BY spos), ',')) AS tokens_md5
FROM sp GROUP BY source, split, spos // {SHARD}
""")
def a31_shard_tokens(spark, sf_dir):
    s = C.shard_pieces(C.train_val_split(char_stream(spark, sf_dir), KEYS), SHARD)
    sh = C.assemble_shards(s, ["source", "split"])
    return sh.select("source", "split", "shard", F.size("tokens").cast("long").alias("n_tokens"),
                     ids_md5(F.col("tokens")).alias("tokens_md5"))


@register("a34_corpus_manifest", "A-34", sql=f"""{SPLIT_SQL},
b AS (SELECT source, CAST(SUM(octet_length(encode(text))) AS BIGINT) AS byte_length FROM documents GROUP BY source)
SELECT source, CAST(COUNT(DISTINCT CASE WHEN split = 'train' THEN spos // {SHARD} END) AS BIGINT) AS n_train_shards,
       CAST(SUM(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train_tokens,
       CAST(COUNT(DISTINCT CASE WHEN split = 'val' THEN spos // {SHARD} END) AS BIGINT) AS n_val_shards,
       CAST(SUM(CASE WHEN split = 'val' THEN 1 ELSE 0 END) AS BIGINT) AS n_val_tokens,
       257 AS vocab_size, byte_length
FROM sp JOIN b USING (source) GROUP BY source, byte_length
""")
def a34_corpus_manifest(spark, sf_dir):
    s = C.shard_pieces(C.train_val_split(char_stream(spark, sf_dir), KEYS), SHARD)
    b = docs(spark, sf_dir).groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("byte_length"))
    return C.corpus_manifest(s, KEYS, vocab_size=257, byte_lengths=b)


@register("a35_corpus_limits", "A-35", sql=f"""
SELECT source, byte_length, CASE WHEN byte_length > {C.MAX_CORPUS_BYTES} THEN 'reject_too_large'
       WHEN has_text = 0 THEN 'reject_empty' WHEN byte_length > {C.WARN_CORPUS_BYTES} THEN 'warn_large' ELSE 'ok' END AS status
FROM (SELECT source, CAST(SUM(octet_length(encode(text))) AS BIGINT) AS byte_length,
             MAX(CASE WHEN {Q.not_blank('text')} THEN 1 ELSE 0 END) AS has_text FROM documents GROUP BY source)
""")
def a35_corpus_limits(spark, sf_dir):
    return C.corpus_limits(docs(spark, sf_dir), KEYS)


WIN_SQL = f"""
WITH {Q.pieces_cte()}, {Q.stream_cte()},
sh AS (SELECT source, pos // {SHARD} AS shard, pos % {SHARD} AS off, tok FROM toks),
shl AS (SELECT *, COUNT(*) OVER (PARTITION BY source, shard) AS shard_len FROM sh)"""


@register("a36_context_windows", "A-36", sql=f"""{WIN_SQL}
SELECT source, CAST(shard AS BIGINT) AS shard, CAST(off // {CONTEXT} AS BIGINT) AS win,
       md5(array_to_string(list(tok ORDER BY off), ',')) AS tokens_md5
FROM shl WHERE off // {CONTEXT} < shard_len // {CONTEXT} GROUP BY source, shard, off // {CONTEXT}
""")
def a36_context_windows(spark, sf_dir):
    w = C.context_windows(C.shard_pieces(char_stream(spark, sf_dir), SHARD), KEYS, CONTEXT)
    return w.select("source", "shard", "win", ids_md5(F.col("tokens")).alias("tokens_md5"))


@register("a37_next_token_windows", "A-37", sql=f"""{WIN_SQL},
ww AS (SELECT source, shard, off // {SEQ_LEN} AS win, off, tok FROM shl WHERE off // {SEQ_LEN} * {SEQ_LEN} < shard_len - {SEQ_LEN}
       UNION ALL
       SELECT source, shard, off // {SEQ_LEN} - 1, off, tok FROM shl
       WHERE off % {SEQ_LEN} = 0 AND off > 0 AND (off // {SEQ_LEN} - 1) * {SEQ_LEN} < shard_len - {SEQ_LEN})
SELECT source, CAST(shard AS BIGINT) AS shard, CAST(win AS BIGINT) AS win,
       md5(array_to_string((list(tok ORDER BY off))[1:{SEQ_LEN}], ',')) AS input_md5,
       md5(array_to_string((list(tok ORDER BY off))[2:{SEQ_LEN} + 1], ',')) AS target_md5
FROM ww GROUP BY source, shard, win
""")
def a37_next_token_windows(spark, sf_dir):
    w = C.next_token_windows(C.shard_pieces(char_stream(spark, sf_dir), SHARD), KEYS, SEQ_LEN, seed=7)
    return w.select("source", "shard", "win", ids_md5(F.col("input")).alias("input_md5"),
                    ids_md5(F.col("target")).alias("target_md5"))


@register("a38_resume_cursor", "A-38", sql=f"""{WIN_SQL}
SELECT source, CAST(COUNT(DISTINCT (shard, off // {CONTEXT})) AS BIGINT) AS n_remaining
FROM shl WHERE off // {CONTEXT} < shard_len // {CONTEXT} AND (shard > 0 OR off // {CONTEXT} >= 100) GROUP BY source
""")
def a38_resume_cursor(spark, sf_dir):
    w = C.context_windows(C.shard_pieces(char_stream(spark, sf_dir), SHARD), KEYS, CONTEXT)
    return C.resume_from(w, 0, 100).groupBy("source").agg(F.count("*").alias("n_remaining"))


# --- byte-level BPE: pieces in SQL; training and encoding against `tokenizers` in tests ---

#: Vocabulary size that the query asks for (specials, alphabet and merges), a parameter of ``train_bpe``.
BPE_VOCAB = 1024

# RE2 has no look-ahead: a mark before the last white space of a run stands for it
_SQL_TABLE = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in B.byte_to_unicode()) + "]"
_SQL_PIECES = (r"regexp_extract_all(regexp_replace(text, '(\s)(\s[^\s])', '\1' || chr(1) || '\2', 'g'), "
               r"'''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+')")
_SQL_BYTES = (f"list_transform({_SQL_PIECES}, lambda p: array_to_string(list_transform("
              f"regexp_extract_all(hex(encode(p)), '[0-9A-F][0-9A-F]'), lambda h: {_SQL_TABLE}[CAST('0x' || h AS INT) + 1]), ''))")


def _bpe_model(spark, sf_dir):
    d = docs(spark, sf_dir)
    with staged_until(spark):
        vocab, merges = B.train_bpe(B.byte_level_word_counts(d), vocab_size=BPE_VOCAB)
    return TK.BpeModel(tuple(vocab), tuple(merges), added=tuple(B.SPECIAL_TOKENS))


@register("a10_byte_level_pretokenize", "A-10", sql=f"""
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_pieces, md5(array_to_string(p, '|')) AS pieces_md5
FROM (SELECT doc_id, {_SQL_BYTES} AS p FROM documents)""")
def a10_byte_level_pretokenize(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", B.byte_level_pieces(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "|")).alias("pieces_md5"))


@register("a18_train_bpe", "A-17 A-18")
def a18_train_bpe(spark, sf_dir):
    """Vocabulary of 1,024 tokens (specials, alphabet, merges) trained on every document."""
    model = _bpe_model(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(model.vocab)), "id int, token string")


@register("a20_bpe_encode_decode", "A-19 A-20 A-21 A-23 A-25")
def a20_bpe_encode_decode(spark, sf_dir):
    """Encode every document with the model trained on all of them (bos/eos template) and decode it back;
    a document without a word has the two special ids."""
    model = _bpe_model(spark, sf_dir)
    d = docs(spark, sf_dir).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "text")
    enc = TK.encode(d, "text", model, ("doc_id", "text_md5"), parts=(([B.BOS_ID], 0), ("A", 0), ([B.EOS_ID], 0)))
    enc = enc.select("doc_id", "text_md5", F.size("ids").alias("n_ids"), ids_md5(F.col("ids")).alias("ids_md5"),
                     F.size(F.array_remove("attention_mask", 0)).alias("n_attended"), "ids")
    back = TK.decode_byte_level(enc, model, skip=(B.BOS_ID, B.EOS_ID))
    return back.select("doc_id", "n_ids", "n_attended", "ids_md5", (F.md5("decoded") == F.col("text_md5")).alias("roundtrip_ok"))


@register("a32_shard_files_roundtrip", "A-31 A-32 A-33", sql=REGISTRY["a31_shard_tokens"].sql)
def a32_shard_files_roundtrip(spark, sf_dir):
    """Shards written as header + uint16 files under the checkpoint folder, read back and validated."""
    import uuid
    from weft.sources.files import read_bin_shards, write_bin_shards
    s = C.shard_pieces(C.train_val_split(char_stream(spark, sf_dir), KEYS), SHARD)
    sh = C.assemble_shards(s, ["source", "split"]).withColumnRenamed("source", "dataset")
    root = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex[:8]}"
    write_bin_shards(sh, root).write.format("noop").mode("overwrite").save()
    back = read_bin_shards(spark, root).filter(F.col("status") == "ok")
    src = F.regexp_extract("path", "dataset=([^/]+)/", 1)
    return back.select(src.alias("source"), "split", "shard", F.size("tokens").cast("long").alias("n_tokens"),
                       ids_md5(F.col("tokens")).alias("tokens_md5"))


CHAT_SPECIALS = ["<|user|>", "<|assistant|>", "<|system|>", "<|end|>"]


@register("a15_split_added_tokens", "A-15", sql="""
WITH p AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM conversations),
s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(piece, '(<\\|assistant\\|>|<\\|system\\|>|<\\|user\\|>|<\\|end\\|>)', chr(0) || '\\1' || chr(0), 'g'), chr(0)), lambda x: length(x) > 0) AS secs FROM p)
SELECT conv_id, turn, CAST(len(secs) AS INTEGER) AS n_sections, md5(array_to_string(secs, '|')) AS sections_md5 FROM s""")
def a15_split_added_tokens(spark, sf_dir):
    """Rendered chat pieces split around their special tokens."""
    c = C.chat_format(Tables(spark, sf_dir).conversations)
    secs = T.split_added_tokens(F.col("piece"), CHAT_SPECIALS)
    return c.select("conv_id", "turn", F.size(secs).alias("n_sections"), F.md5(F.array_join(secs, "|")).alias("sections_md5"))


@register("a01_read_text_corpus", "A-01", sql="""
SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM documents""")
def a01_read_text_corpus(spark, sf_dir):
    """Documents written as UTF-8 files (one per document, under the checkpoint folder) and read
    back whole as a text corpus."""
    import uuid
    from weft.sources.files import read_text_corpus, write_text_files
    root = f"{checkpoint_dir(spark)}/text-{uuid.uuid4().hex[:8]}"
    d = docs(spark, sf_dir).select("doc_id", "text")
    write_text_files(d, root, "doc_id", "text").write.format("noop").mode("overwrite").save()
    back = read_text_corpus(spark, f"{root}/*/*.txt")
    did = F.regexp_extract("path", "/([0-9]+)[.]txt$", 1).cast("long")
    return back.select(did.alias("doc_id"), F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


PREPARED = ("char", "384")


@register("a39_prepare_datasets", "A-39")
def a39_prepare_datasets(spark, sf_dir):
    """Documents of each language as a dataset, under the char vocabulary and a BPE vocabulary of 384 tokens trained
    on it: shard files and manifest, checked against the files read back."""
    import uuid
    from weft.operators.prepare import prepare_datasets
    from weft.sources.files import read_bin_shards
    root = f"{checkpoint_dir(spark)}/prepared-{uuid.uuid4().hex[:8]}"
    m = prepare_datasets(Tables(spark, sf_dir).documents.select("doc_id", "lang", "text"), PREPARED, root, "lang", ["doc_id"])
    back = read_bin_shards(spark, f"{root}/shards").where("status = 'ok'")
    pair = [F.regexp_extract("path", f"/{k}=([^/]+)/", 1).alias(k) for k in ("dataset", "vocab")]
    files = back.select(*pair, "split", F.size("tokens").alias("n"), F.array_max("tokens").alias("top")).groupBy("dataset", "vocab", "split").agg(
        F.count("*").alias("n_files"), F.sum("n").alias("n_read"), F.max("top").alias("largest_id"))
    return m.join(files, ["dataset", "vocab", "split"], "left").select(
        "dataset", "vocab", "split", "n_shards", "n_tokens", "vocab_size", ((F.col("n_files") == F.col("n_shards")) & (F.col("n_read") == F.col("n_tokens"))
                                                                     & (F.col("largest_id") < F.col("vocab_size"))).alias("files_ok"))
