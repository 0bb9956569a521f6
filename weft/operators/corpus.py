"""Corpus preparation (section A): documents -> pieces -> token streams -> shards -> windows.

Data layout
-----------
A *token stream* is never materialised as one array.  It is a set of piece
rows ``(keys..., start, ids ARRAY<INT>)`` where ``start`` is the position of
the piece's first token inside the stream of its key (dataset).  Shards and
windows are cut from piece slices and re-assembled with a bounded
``collect_list`` (a shard holds at most ``tokens_per_shard`` tokens, a window
``width`` tokens), so no group grows with the corpus.  The ids of a char-level stream are
kept as text, one code point an id (``T.char_text``), until shards and windows are whole: a byte or two
instead of four for each id written and shuffled.

Shuffles: one range exchange for the stream offsets (two-level prefix sum,
see ``ordering``), one hash exchange to assemble shards or windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.operators.ordering import prefix_sum

# fixed values: sharding and split parameters of the preparation script / upload path
TOKENS_PER_SHARD = 400_000
TOKENS_PER_SHARD_UPLOAD = 100_000
VAL_FRACTION = 0.05
VAL_FALLBACK_TOKENS = 1024
CHUNK_CHARS = 4000
MAX_CORPUS_BYTES = 16 * 1024 * 1024
WARN_CORPUS_BYTES = 2 * 1024 * 1024
SHARD_MAGIC = 20251003
SHARD_VERSION = 1
SHARD_HEADER_INTS = 256


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """A-03: skip null and whitespace-only texts (pushed below any later shuffle)."""
    return df.filter(~T.is_blank(F.col(text)))


def sample_until_chars(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_chars: int,
                       text: str = "text") -> DataFrame:
    """A-02: per key, keep non-blank docs in order until the running *untrimmed*
    length reaches ``max_chars`` (the doc that reaches it is kept); texts are trimmed.

    Adds ``running_chars`` (inclusive running untrimmed length)."""
    d = drop_blank(df, text)
    d = prefix_sum(d, keys, order, F.length(text).cast("long"), "running_chars")
    return (d.filter(F.col("running_chars") - F.length(text) < max_chars)
            .withColumn(text, T.js_trim(F.col(text))))


def _with_key_table(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows joined with a table of one row a key; null keys match each other."""
    t = table.withColumnsRenamed({k: f"_k_{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return df.join(t, on).drop(*[f"_k_{i}" for i in range(len(keys))])


def assemble_corpus(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_chars: int | None = None,
                    text: str = "text", sep: str = "\n\n") -> DataFrame:
    """A-04: the ordered docs of each key joined with ``sep`` and cut at ``max_chars``.

    The joined string is kept as rows: ``piece`` is a doc followed by the
    separator (none after the last doc), ``char_start`` its offset in the
    joined text.  Concatenating ``piece`` in ``char_start`` order gives the
    corpus string; truncation becomes a filter and a ``substring``.
    """
    keys = list(keys)
    d = df.withColumn("_len", F.length(text).cast("long") + len(sep))
    d = prefix_sum(d, keys, order, "_len", "char_start", exclusive=True)
    d = _with_key_table(d, d.groupBy(*keys).agg(F.sum("_len").alias("_total")), keys)
    is_last = F.col("char_start") + F.col("_len") == F.col("_total")
    piece = F.when(is_last, F.col(text)).otherwise(F.concat(F.col(text), F.lit(sep)))
    d = d.withColumn("piece", piece)
    if max_chars is not None:
        d = (d.filter(F.col("char_start") < max_chars)
             .withColumn("piece", F.expr(f"substring(piece, 1, {int(max_chars)} - char_start)")))
    return d.withColumn("is_last", is_last | (F.lit(max_chars is not None) & (
        F.col("char_start") + F.length("piece") >= F.lit(max_chars or 0)))).drop("_len", "_total")


def paragraph_pieces(df: DataFrame, text: str = "text", max_chars: int = CHUNK_CHARS) -> DataFrame:
    """A-05 + A-06: one row per (paragraph, chunk) with ``para_idx``, ``chunk_idx`` and ``piece``."""
    p = df.select("*", F.posexplode(T.split_paragraphs(F.col(text))).alias("para_idx", "_para")).drop(text)
    return (p.select("*", F.posexplode(T.chunk_text(F.col("_para"), max_chars)).alias("chunk_idx", "piece"))
            .drop("_para"))


def flatten_tokens(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], ids: str = "ids",
                   eos: int | None = T.CHAR_EOS) -> DataFrame:
    """A-28 + A-29: append ``eos`` after every piece and give each piece its
    ``start`` position in the token stream of its key.  Adds ``n_tokens``."""
    p, text = pieces, _is_text(pieces, ids)
    if eos is not None:
        p = p.withColumn(ids, F.concat(F.col(ids), F.lit(chr(eos)) if text else F.array(F.lit(eos))))
    p = p.withColumn("n_tokens", (F.char_length if text else F.size)(ids).cast("long"))
    return prefix_sum(p, keys, order, "n_tokens", "start", exclusive=True)


def encoded_stream(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str = "piece",
                   eos: int | None = T.CHAR_EOS) -> DataFrame:
    """A-28 + A-29 of char-level ids: a piece of n characters has n ids (and ``eos``), so the pieces are put
    in order as text and encoded once, where they lie."""
    p = pieces.withColumn("n_tokens", (F.char_length(piece) + (0 if eos is None else 1)).cast("long"))
    p = prefix_sum(p, keys, order, "n_tokens", "start", exclusive=True)
    return p.withColumn("ids", T.char_text(F.col(piece), eos)).drop(piece)


def _is_text(rows: DataFrame, col: str = "ids") -> bool:
    return rows.schema[col].dataType.simpleString() == "string"


def _cut(rows: DataFrame, start: Column, length: Column) -> Column:
    """``length`` ids from place ``start`` (1-based) of the column ``ids``, which is an array or text."""
    return (F.substring if _is_text(rows) else F.slice)("ids", start.cast("int"), length.cast("int"))


def id_arrays(rows: DataFrame, col: str) -> DataFrame:
    """The column as ARRAY<INT>, if it is text."""
    return rows.withColumn(col, T.code_points(F.col(col))) if _is_text(rows, col) else rows


def _whole(parts: DataFrame, rows: DataFrame, keys: Sequence[str], ids: Column) -> DataFrame:
    """(keys..., tokens): the collected pieces ``ids`` one after the other, in the form that ``rows`` has."""
    return parts.select(*keys, (F.array_join(ids, "") if _is_text(rows) else F.flatten(ids)).alias("tokens"))


def stream_lengths(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total tokens per key (one row per key)."""
    return stream.groupBy(*keys).agg(F.sum("n_tokens").alias("n"))


def _slice_rows(stream: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Keep the part of each piece inside the stream range [lo, hi); rebase nothing."""
    s, e = F.col("start"), F.col("start") + F.col("n_tokens")
    a = F.greatest(s, lo)
    b = F.least(e, hi)
    return stream.filter(b > a).withColumns({  # evaluated together, on the input row
        "ids": _cut(stream, a - s + 1, b - a),
        "start": a,
        "n_tokens": b - a})


def train_val_split(stream: DataFrame, keys: Sequence[str], val_fraction: float = VAL_FRACTION,
                    val_fallback: int = VAL_FALLBACK_TOKENS,
                    val_cap: int | None = None) -> DataFrame:
    """A-30: ordered split of each key's stream.

    train = [0, cut) with cut = max(1, floor(n * (1 - val_fraction)));
    val = [cut, n), or the last min(1024, n) tokens when that is empty;
    ``val_cap``, if given, cuts val to so many tokens.  Adds ``split`` and
    rebases ``start`` to the split."""
    keys = list(keys)
    n = stream_lengths(stream, keys)
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(1.0 - val_fraction)).cast("long"))
    n = n.select(*keys, "n", cut.alias("_cut"))
    s = _with_key_table(stream, n, keys)
    train = _slice_rows(s, F.lit(0), F.col("_cut")).withColumn("split", F.lit("train"))
    val_lo = F.when(F.col("_cut") < F.col("n"), F.col("_cut")).otherwise(
        F.col("n") - F.least(F.lit(val_fallback), F.col("n")))
    val_hi = F.col("n") if val_cap is None else F.least(F.col("n"), val_lo + F.lit(val_cap))
    val = (_slice_rows(s.withColumn("_vlo", val_lo), val_lo, val_hi)
           .withColumn("start", F.col("start") - F.col("_vlo")).drop("_vlo")
           .withColumn("split", F.lit("val")))
    return train.unionByName(val).drop("n", "_cut")


def shard_pieces(stream: DataFrame, tokens_per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """A-31: cut piece slices at shard boundaries (shard = position div size).

    Adds ``shard`` and ``offset`` (position of the slice inside the shard)."""
    S = F.lit(tokens_per_shard).cast("long")
    s, e = F.col("start"), F.col("start") + F.col("n_tokens")
    first, last = F.floor(s / S).cast("long"), F.floor((e - 1) / S).cast("long")
    x = stream.filter(F.col("n_tokens") > 0).withColumn("shard", F.explode(F.sequence(first, last)))
    lo = F.greatest(s, F.col("shard") * S)
    hi = F.least(e, (F.col("shard") + 1) * S)
    return x.withColumns({
        "ids": _cut(x, lo - s + 1, hi - lo),
        "offset": lo - F.col("shard") * S,
        "n_tokens": hi - lo}).drop("start")


def assemble_shards(shard_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-31 sink form: one row per (keys, shard) with its ``tokens`` array.

    A group holds at most ``tokens_per_shard`` tokens; slices are ordered by
    their offset before concatenation (collect order is not data order)."""
    return id_arrays(joined_shards(shard_rows, keys), "tokens")


def joined_shards(shard_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`assemble_shards` with the ``tokens`` in the form of the slices, which may be text."""
    parts = shard_rows.groupBy(*keys, "shard").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return _whole(parts, shard_rows, [*keys, "shard"], F.col("_parts.ids"))


def shard_lengths(shard_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return shard_rows.groupBy(*keys, "shard").agg(F.sum("n_tokens").alias("shard_len"))


def slice_windows(shard_rows: DataFrame, keys: Sequence[str], stride: int, width: int,
                  n_windows: Column) -> DataFrame:
    """Windows ``[w*stride, w*stride+width)`` inside each shard, for w < n_windows.

    ``n_windows`` is an expression over ``shard_len``.  Each piece slice is
    routed to the windows it overlaps; a window is re-assembled from at most
    ``width`` tokens, so groups are bounded.  Returns (keys, shard, window, tokens).
    """
    keys = list(keys)
    lens = shard_lengths(shard_rows, keys).withColumn("_nw", n_windows)
    x = shard_rows.join(lens.select(*keys, "shard", "_nw"), [*keys, "shard"]).filter(F.col("_nw") > 0)
    o, e = F.col("offset"), F.col("offset") + F.col("n_tokens")
    w_lo = F.greatest(F.lit(0), F.ceil((o - F.lit(width) + 1) / F.lit(stride)).cast("long"))
    w_hi = F.least(F.floor((e - 1) / F.lit(stride)).cast("long"), F.col("_nw") - 1)
    x = x.filter(w_hi >= w_lo).withColumn("win", F.explode(F.sequence(w_lo, w_hi)))
    ws = F.col("win") * F.lit(stride)
    lo = F.greatest(o, ws)
    hi = F.least(e, ws + F.lit(width))
    x = x.select(*keys, "shard", "win", (lo - ws).alias("_pos"),
                 _cut(x, lo - o + 1, hi - lo).alias("_ids"))
    parts = x.groupBy(*keys, "shard", "win").agg(F.array_sort(F.collect_list(F.struct("_pos", "_ids"))).alias("_parts"))
    return id_arrays(_whole(parts, shard_rows, [*keys, "shard", "win"], F.col("_parts._ids")), "tokens")


def context_windows(shard_rows: DataFrame, keys: Sequence[str], context: int, arrays: bool = True) -> DataFrame:
    """A-36: non-overlapping windows of ``context`` tokens per shard (as text, without ``arrays``, if the stream is); the shard
    tail shorter than ``context`` is dropped and no window crosses shards.

    Of a stream kept as text the shards are put together first and cut where they lie."""
    if not _is_text(shard_rows):
        return slice_windows(shard_rows, keys, context, context, F.floor(F.col("shard_len") / F.lit(context)))
    named = shard_rows.dropna(subset=list(keys))  # as in slice_windows, a null key has no windows
    parts = named.groupBy(*keys, "shard").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    whole = F.array_join("_parts.ids", "")
    w = parts.select(*keys, "shard", F.posexplode(F.regexp_extract_all(whole, F.lit(f"(?s).{{{int(context)}}}"), 0)).alias("win", "tokens"))
    w = w.withColumn("win", F.col("win").cast("long"))
    return id_arrays(w, "tokens") if arrays else w


def next_token_windows(shard_rows: DataFrame, keys: Sequence[str], seq_len: int, seed: int | None = None
                       ) -> DataFrame:
    """A-37: windows of ``seq_len + 1`` tokens starting every ``seq_len`` over
    [0, n - seq_len); ``input`` = first seq_len tokens, ``target`` = last seq_len.
    With ``seed`` an ``order_key`` column gives the deterministic shuffled order."""
    from weft.functions.hashing import hash32
    n_w = F.when(F.col("shard_len") > seq_len,
                 F.ceil((F.col("shard_len") - F.lit(seq_len)) / F.lit(seq_len))).otherwise(F.lit(0)).cast("long")
    w = slice_windows(shard_rows, keys, seq_len, seq_len + 1, n_w)
    w = (w.withColumn("input", F.slice("tokens", 1, seq_len))
         .withColumn("target", F.slice("tokens", 2, seq_len)))
    if seed is not None:
        w = w.withColumn("order_key", hash32(seed, "shard", "win"))
    return w


def shift_targets(seq: str = "tokens") -> tuple[Column, Column]:
    """B-11: input = all but last, target = all but first (length < 2 gives two empties)."""
    c = F.col(seq)
    n = F.size(c)
    empty = F.array().cast("array<int>")
    inp = F.when(n >= 2, F.slice(c, 1, n - 1)).otherwise(empty)
    tgt = F.when(n >= 2, F.slice(c, 2, n - 1)).otherwise(empty)
    return inp, tgt


def resume_from(windows: DataFrame, shard: int, cursor: int) -> DataFrame:
    """A-38: the windows at or after the cursor (shard, window), clamped to the data."""
    return windows.filter((F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("win") >= cursor)))


def corpus_manifest(split_shards: DataFrame, keys: Sequence[str], vocab_size: int,
                    byte_lengths: DataFrame | None = None) -> DataFrame:
    """A-34: per dataset — train/val shard and token counts, vocab size (+ bytes)."""
    keys = list(keys)
    m = split_shards.groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("split") == "train", F.col("shard"))).alias("n_train_shards"),
        F.sum(F.when(F.col("split") == "train", F.col("n_tokens")).otherwise(0)).alias("n_train_tokens"),
        F.countDistinct(F.when(F.col("split") == "val", F.col("shard"))).alias("n_val_shards"),
        F.sum(F.when(F.col("split") == "val", F.col("n_tokens")).otherwise(0)).alias("n_val_tokens"),
    ).withColumn("vocab_size", F.lit(vocab_size))
    if byte_lengths is not None:
        m = m.join(byte_lengths, keys, "left")
    return m


def corpus_limits(df: DataFrame, keys: Sequence[str], text: str = "text", max_bytes: int = MAX_CORPUS_BYTES,
                  warn_bytes: int = WARN_CORPUS_BYTES) -> DataFrame:
    """A-35: per dataset — total UTF-8 bytes and a status: reject_too_large,
    reject_empty (nothing but whitespace), warn_large, ok."""
    agg = df.groupBy(*keys).agg(
        F.sum(F.octet_length(text)).cast("long").alias("byte_length"),
        F.max(F.when(~T.is_blank(F.col(text)), 1).otherwise(0)).alias("_has_text"))
    status = (F.when(F.col("byte_length") > max_bytes, "reject_too_large")
              .when(F.col("_has_text") == 0, "reject_empty")
              .when(F.col("byte_length") > warn_bytes, "warn_large")
              .otherwise("ok"))
    return agg.withColumn("status", status).drop("_has_text")


# --- chat rendering (A-27) ----------------------------------------------------

# fixed role template: "<|role|>\n" + content + "<|end|>\n"; generation prompt "<|assistant|>\n"
CHAT_OPEN = "<|{role}|>\n"
CHAT_CLOSE = "<|end|>\n"
CHAT_GENERATION_PROMPT = "<|assistant|>\n"


def chat_format(conv: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                text: str = "text", add_generation_prompt: bool = False) -> DataFrame:
    """A-27: render each message through the fixed role template.

    The rendered conversation is kept as ordered pieces with ``char_start``
    offsets (like ``assemble_corpus``), so a huge conversation never becomes
    one string in one task.  With ``add_generation_prompt`` one extra piece
    follows the last message."""
    piece = F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"), F.col(text), F.lit(CHAT_CLOSE))
    p = conv.select(key, F.col(order).cast("long").alias(order), piece.alias("piece"))
    if add_generation_prompt:
        last = conv.groupBy(key).agg(F.max(order).cast("long").alias(order))
        p = p.unionByName(last.select(key, (F.col(order) + 1).alias(order), F.lit(CHAT_GENERATION_PROMPT).alias("piece")))
    p = p.withColumn("_len", F.length("piece").cast("long"))
    return prefix_sum(p, [key], [order], "_len", "char_start", exclusive=True).drop("_len")
