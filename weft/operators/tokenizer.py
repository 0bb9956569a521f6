"""Encoding with a BPE model and its policies, templates, padding and decoders (A-15, A-19 .. A-25).

Texts are pre-tokenised by column expressions; the model runs in Arrow batches in which each distinct word is
encoded once and its ids are put back by position in the document's array, so nothing is
shuffled or joined and a document without a word keeps its row.  Templates, padding and all
decoders but the byte-level one are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.arrays import let
from weft.operators.bpe import RowMerges, byte_level_pieces, byte_to_unicode, merge_queue, raw_pieces

#: Words whose ids a task keeps between batches, and the longest of them.
MOST_WORDS, LONGEST = 100_000, 256
#: Rows of an Arrow batch whose words or ids are Python objects at the same time.
ROWS_AT_ONCE = 64


def _slices(batches):
    """The rows of Arrow batches, a few at a time."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(k, ROWS_AT_ONCE)


@dataclass(frozen=True)
class BpeModel:
    """Vocabulary in id order, merges in rank order, and what happens to unknown pieces.

    ``byte_fallback``: a piece outside the vocabulary becomes its bytes' ``<0xNN>`` tokens if all of them
    exist.  ``ignore_merges``: a whole word of the vocabulary stays whole.  ``fuse_unk``: unknown
    pieces in a row become one.  ``end_of_word_suffix`` is part of a word's last character before
    merging; ``continuing_suffix`` is added after merging to all pieces but a word's last.
    ``added``: tokens that are matched before pre-tokenising."""

    vocab: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]
    unk: str | None = "<unk>"
    byte_fallback: bool = False
    ignore_merges: bool = False
    fuse_unk: bool = False
    end_of_word_suffix: str | None = None
    continuing_suffix: str | None = None
    added: tuple[str, ...] = ()

    def encoder(self, byte_level: bool = False) -> WordEncoder:
        return WordEncoder(self, byte_level)


class WordEncoder:
    """word -> ids of one model; built in each task, remembers words in bounded memory.  With ``byte_level``
    the words are pieces of the text, whose bytes become letters here."""

    def __init__(self, model: BpeModel, byte_level: bool = False):
        self.model = model
        self.ids = {t: i for i, t in enumerate(model.vocab)}
        self.merges = {p: (rank, p[0] + p[1]) for rank, p in enumerate(model.merges)}
        self.unk = self.ids.get(model.unk, -1)
        self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)]
        self.known: dict[str, list[int]] = {}
        self.letters = {b: ch for b, ch in enumerate(byte_to_unicode())} if byte_level else None
        self.added = frozenset(model.added)
        self.simple = not (model.ignore_merges or model.end_of_word_suffix or model.continuing_suffix)
        if self.simple:  # symbols as numbers: those of the merges, and characters as they come
            self.symbols: dict[str, int] = {}
            numbered = {(self.number(l), self.number(r)): (rank, self.number(new)) for (l, r), (rank, new) in self.merges.items()}
            self.rows = RowMerges(numbered)
            if byte_level:
                self.of_byte = np.array([self.number(ch) for ch in byte_to_unicode()], np.int64)
            else:
                self.of_char = np.full(0x110000, -1, np.int64)

    def number(self, symbol: str) -> int:
        return self.symbols.setdefault(symbol, len(self.symbols))

    def pieces(self, word: str) -> list[str]:
        """A-19: the word's symbols after all merges."""
        m = self.model
        symbols = list(word)
        if symbols and m.end_of_word_suffix:
            symbols[-1] += m.end_of_word_suffix
        symbols = merge_queue(symbols, self.merges)
        if m.continuing_suffix:
            symbols = [s + m.continuing_suffix for s in symbols[:-1]] + symbols[-1:]
        return symbols

    def word_ids(self, word: str) -> list[int]:
        """A-21: ids of the word's pieces under the model's policies."""
        if word in self.model.added or (self.model.ignore_merges and word in self.ids):
            return [self.ids[word]]
        out: list[int] = []
        for piece in self.pieces(word):
            if (found := self.ids.get(piece)) is not None:
                out.append(found)
                continue
            codes = [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if self.model.byte_fallback else [None]
            out += [self.unk] if None in codes else codes
        return out

    def words_ids(self, words: list[str]) -> list[list[int]]:
        """``word_ids`` of many words: merged together where the model has no more than merges; a word with
        an unknown piece goes alone."""
        if not self.simple:
            return [self.word_ids(self.spelled(w)) for w in words]
        text = "".join(words)
        chars, lengths = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), np.array([len(w) for w in words], np.int64)
        if self.letters is None:
            flat = self.of_char[chars]
            if len(new := np.unique(chars[flat < 0])):
                self.of_char[new] = [self.number(chr(c)) for c in new.tolist()]
                flat = self.of_char[chars]
        else:
            flat = self.of_byte[np.frombuffer(text.encode(), np.uint8)]
            if len(flat) > len(chars):  # bytes of each word
                before = np.r_[0, np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))]
                lengths = np.diff(before[np.r_[0, np.cumsum(lengths)]])
        flat, sizes = self.rows(flat, lengths)
        ids = np.array([self.ids.get(s, -1) for s in self.symbols], np.int64)[flat]
        ends, odd, ids = np.r_[0, np.cumsum(sizes)].tolist(), np.flatnonzero(ids < 0), ids.tolist()
        out = [ids[i:j] for i, j in zip(ends, ends[1:])]
        alone = set(np.repeat(np.arange(len(words)), sizes)[odd].tolist())
        if self.added:
            alone.update(i for i, w in enumerate(words) if w in self.added)
        for i in alone:
            out[i] = self.word_ids(self.spelled(words[i]))
        return out

    def spelled(self, word: str) -> str:
        """The word in the letters of the vocabulary."""
        if self.letters is None or word in self.added:
            return word
        return word.encode().decode("latin-1").translate(self.letters)

    def codes(self, words: list[str]) -> list[list[int]]:
        out = [self.known.get(w) for w in words]
        fresh = [i for i, c in enumerate(out) if c is None]
        for i, got in zip(fresh, self.words_ids([words[i] for i in fresh]) if fresh else []):
            out[i] = got
            if len(words[i]) <= LONGEST:
                if len(self.known) >= MOST_WORDS:
                    self.known.clear()
                self.known[words[i]] = got
        return out

    def encode(self, lists: pa.ListArray) -> pa.ListArray:
        """Ids of lists of words: each distinct word of the batch once, then placed by position."""
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        words = lists.flatten().dictionary_encode()
        codes = self.codes(words.dictionary.to_pylist())
        width = np.array([len(c) for c in codes], np.int64)
        begin = np.cumsum(width) - width
        flat = np.fromiter(chain.from_iterable(codes), np.int32, int(width.sum()))
        at = words.indices.to_numpy()
        n = width[at]  # ids of each word in place
        total = np.r_[0, np.cumsum(n)]
        ids = flat[np.repeat(begin[at] - total[:-1], n) + np.arange(total[-1])] if len(at) else flat[:0]
        ends = np.r_[0, np.cumsum(sizes)]
        cut = total[ends]
        if self.model.fuse_unk and len(ids):
            same = np.r_[False, (ids[1:] == self.unk) & (ids[:-1] == self.unk)]
            same[cut[:-1][cut[:-1] < len(ids)]] = False  # a document's first id
            cut = cut - np.r_[0, np.cumsum(same)][cut]
            ids = ids[~same]
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))


def added_sections(text, added: Sequence[str], lstrip: Sequence[str] = (), rstrip: Sequence[str] = ()) -> Column:
    """A-15: the text around and at added tokens, as an array; longer tokens match first, empty sections go.
    Tokens in ``lstrip`` / ``rstrip`` take the white space before / after them away from their neighbour.

    Every token is matched in one pass over the text itself, without marks inside it, so a text may
    hold any character; a null text gives null."""
    import re
    c = F.col(text) if isinstance(text, str) else text
    if not added:
        return F.filter(F.array(c), lambda s: F.length(s) > 0)
    alt = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))

    def trimmed(s, i, found):
        if lstrip:  # the token after this section
            s = F.when(F.get(found, i).isin(list(lstrip)), F.regexp_replace(s, r"\s+$", "")).otherwise(s)
        if rstrip:  # the token before it
            s = F.when(F.get(found, i - 1).isin(list(rstrip)), F.regexp_replace(s, r"^\s+", "")).otherwise(s)
        return F.array(s, F.get(found, i))

    sections = let(F.regexp_extract_all(c, F.lit(f"(?:{alt})"), F.lit(0)), lambda found: F.flatten(
        F.transform(F.split(c, alt, -1), lambda s, i: trimmed(s, i, found))))
    return F.filter(sections, lambda s: F.length(s) > 0)


def words_of(text, model: BpeModel, pretokenize: Callable = byte_level_pieces, normalize: Callable | None = None,
             lstrip: Sequence[str] = (), rstrip: Sequence[str] = ()) -> Column:
    """A-20, before the model: sections, of which those that are no added token are normalised and
    pre-tokenised, as one array of words."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    norm = normalize or (lambda s: s)
    if not model.added:
        return pretokenize(norm(c))
    return F.flatten(F.transform(added_sections(c, model.added, lstrip, rstrip), lambda s: F.when(
        s.isin(list(model.added)), F.array(s)).otherwise(pretokenize(norm(s)))))


def encode_words(df: DataFrame, model: BpeModel, words: str = "words", out: str = "ids", byte_level: bool = False) -> DataFrame:
    """A-19 / A-21: ``df`` with its array column ``words`` replaced by the ids ``out``, row by row.  With ``byte_level``
    the words are ``raw_pieces``; a task maps each distinct one of its own to the byte alphabet."""
    rest = [c for c in df.columns if c != words]
    shared = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary

    def run(batches):
        encoder = shared.value.encoder(byte_level)
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], encoder.encode(b.column(len(rest)))], names=[*rest, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in rest]).schema.fields),
                        f"`{out}` array<int>"])
    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(words)).mapInArrow(run, schema)


def template(parts: Sequence[tuple], a: Column, b: Column | None = None, add_special_tokens: bool = True) -> tuple[Column, Column]:
    """A-23: ids and type ids of a template: ``("A", type)``, ``("B", type)`` or ``([ids], type)`` for
    special tokens, which go where ``add_special_tokens`` is false; a null sequence is empty."""
    ids, types = [], []
    for what, kind in parts:
        if what in ("A", "B"):
            seq = a if what == "A" else b
            seq = F.array().cast("array<int>") if seq is None else F.coalesce(seq.cast("array<int>"), F.array().cast("array<int>"))
            ids.append(seq)
            types.append(F.transform(seq, lambda _: F.lit(kind)))
        elif add_special_tokens and what:
            ids.append(F.array(*[F.lit(int(i)) for i in what]))
            types.append(F.array(*[F.lit(kind)] * len(what)))
    none = F.array().cast("array<int>")
    return F.concat(*ids, none), F.concat(*types, none)


def encode(df: DataFrame, text: str, model: BpeModel, keep: Sequence[str], parts: Sequence[tuple] = (("A", 0),),
           pair: str | None = None, pretokenize: Callable = byte_level_pieces, normalize: Callable | None = None,
           add_special_tokens: bool = True, lstrip: Sequence[str] = (), rstrip: Sequence[str] = ()) -> DataFrame:
    """A-20: the ``keep`` columns plus ``ids, attention_mask, type_ids`` of every row.

    A null or empty text has no ids but the template's special ones."""
    kept = [F.col(f"`{c}`") for c in keep]
    # without a normaliser no piece can turn into an added token, so the bytes can be mapped word by word later
    late = pretokenize is byte_level_pieces and (normalize is None or not model.added)
    words = lambda c: words_of(c, model, raw_pieces if late else pretokenize, normalize, lstrip, rstrip)
    src = df.select(*kept, words(F.col(text)).alias("_a"), *([words(F.col(pair)).alias("_b")] if pair else []))
    done = encode_words(src, model, "_a", "_a_ids", late)
    if pair:
        done = encode_words(done, model, "_b", "_b_ids", late)
    ids, types = template(parts, F.col("_a_ids"), F.col("_b_ids") if pair else None, add_special_tokens)
    return done.select(*kept, ids.alias("ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), types.alias("type_ids"))


def pad_batches(df: DataFrame, batch: str, pad_id: int, model_max: int | None = None, side: str = "right", padding=True,
                truncate: bool = False, arrays: Sequence[str] = ("ids", "attention_mask", "type_ids")) -> DataFrame:
    """A-24 over batches (rows with one value of ``batch``): ``padding`` true pads to the longest row of the
    batch, at most ``model_max``; ``"max_length"`` to ``model_max``; false not at all, and then rows of
    different lengths in a batch are an error when the frame is evaluated.  ``ids`` are filled with
    ``pad_id``, the other arrays with 0."""
    cap = (lambda c: F.least(c, F.lit(model_max))) if model_max else (lambda c: c)
    size = F.size(arrays[0])
    if truncate and model_max:
        df = df.withColumns({a: F.slice(F.col(a), 1, model_max) for a in arrays})
    sizes = df.groupBy(F.col(batch).alias("_batch")).agg(F.max(size).alias("_max"), F.min(size).alias("_min"))
    df = df.join(sizes, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    if not padding:
        bad = F.raise_error(F.lit("rows of a batch differ in length: ask for padding or truncation"))
        return df.withColumn(arrays[0], F.when(F.col("_max") == F.col("_min"), F.col(arrays[0])).otherwise(bad)).drop("_max", "_min")
    to = F.lit(model_max) if padding == "max_length" else cap(F.col("_max"))
    df = df.withColumn("_fill", F.greatest(to - size, F.lit(0)))
    for a in arrays:
        fill = F.array_repeat(F.lit(pad_id if a == arrays[0] else 0), F.col("_fill"))
        df = df.withColumn(a, F.concat(F.col(a), fill) if side == "right" else F.concat(fill, F.col(a)))
    return df.drop("_max", "_min", "_fill")


# --- decoders (A-25) -----------------------------------------------------------------------


def ids_to_tokens(df: DataFrame, model: BpeModel, ids: str = "ids", out: str = "tokens", skip: Sequence[int] = ()) -> DataFrame:
    """``df`` with the array ``ids`` replaced by their tokens; unknown ids become the unknown token, and
    ids in ``skip`` go."""
    rest = [c for c in df.columns if c != ids]
    vocab = df.sparkSession.sparkContext.broadcast((*model.vocab, model.unk))  # a vocabulary

    def run(batches):
        tokens = pa.array(vocab.value, pa.string())
        known = len(vocab.value) - 1
        for b in _slices(batches):
            lists = b.column(len(rest))
            lists = lists if lists.null_count == 0 else pa.array([x or [] for x in lists.to_pylist()], lists.type)
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.where((at < 0) | (at >= known), known, at)
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(pa.array(at)))],
                                             names=[*rest, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in rest]).schema.fields),
                        f"`{out}` array<string>"])
    some = F.filter(ids, lambda i: ~i.isin(list(skip))) if skip else F.col(ids)
    return df.select(*[F.col(f"`{c}`") for c in rest], some.alias(ids)).mapInArrow(run, schema)


def fuse(tokens: Column) -> Column:
    """All tokens as one."""
    return F.array(F.array_join(tokens, ""))


def strip(content: str, start: int, stop: int) -> Callable:
    """Up to ``start`` times ``content`` (one character) off each token's front, ``stop`` times off its end."""
    import re
    c = re.escape(content)
    return lambda tokens: F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, f"^{c}{{0,{start}}}", ""), f"{c}{{0,{stop}}}$", ""))


def bpe_suffix(suffix: str) -> Callable:
    """The suffix becomes a space, and nothing in the last token."""
    return lambda tokens: F.transform(tokens, lambda t, i: F.replace(
        t, F.lit(suffix), F.when(i == F.size(tokens) - 1, F.lit("")).otherwise(F.lit(" "))))


def _utf8(hexes: Column) -> Column:
    """Bytes in hex as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(F.unhex(hexes).cast("string"))


def byte_fallback(tokens: Column) -> Column:
    """Each row of ``<0xNN>`` tokens becomes the text of its bytes."""
    def step(acc, t):
        byte = t.rlike("^<0x[0-9A-Fa-f]{2}>$")
        done = F.when(F.length(acc["held"]) > 0, F.array(_utf8(acc["held"]))).otherwise(F.array().cast("array<string>"))
        return F.when(byte, F.struct(acc["out"].alias("out"), F.concat(acc["held"], F.substring(t, 4, 2)).alias("held"))).otherwise(
            F.struct(F.concat(acc["out"], done, F.array(t)).alias("out"), F.lit("").alias("held")))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    return F.reduce(tokens, start, step, lambda acc: F.when(F.length(acc["held"]) > 0, F.concat(
        acc["out"], F.array(_utf8(acc["held"])))).otherwise(acc["out"]))


def byte_level(added: Sequence[str] = ()) -> Callable:
    """Tokens of the byte alphabet become text; added tokens stay and end the stretch before them."""
    def text(joined):
        table = F.create_map(*[x for b, ch in enumerate(byte_to_unicode()) for x in (F.lit(ch), F.lit(f"{b:02X}"))])
        return _utf8(F.array_join(F.transform(F.filter(F.split(joined, ""), lambda c: c != ""), lambda c: table[c]), ""))

    def decode(tokens):
        def step(acc, t):
            done = F.when(F.length(acc["held"]) > 0, F.array(text(acc["held"]))).otherwise(F.array().cast("array<string>"))
            return F.when(t.isin(list(added)), F.struct(F.concat(acc["out"], done, F.array(t)).alias("out"), F.lit("").alias("held"))).otherwise(
                F.struct(acc["out"].alias("out"), F.concat(acc["held"], t).alias("held")))

        if not added:
            return F.when(F.size(tokens) > 0, F.array(text(F.array_join(tokens, "")))).otherwise(F.array().cast("array<string>"))
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
        return F.reduce(tokens, start, step, lambda acc: F.when(F.length(acc["held"]) > 0, F.concat(
            acc["out"], F.array(text(acc["held"])))).otherwise(acc["out"]))

    return decode


def decode_tokens(tokens, *decoders: Callable) -> Column:
    """A-25: the decoders in sequence, joined; without any, tokens are joined by a space."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    if not decoders:
        return F.array_join(c, " ")
    for d in decoders:
        c = d(c)
    return F.array_join(c, "")


def decode_byte_level(df: DataFrame, model: BpeModel, ids: str = "ids", out: str = "decoded", skip: Sequence[int] = ()) -> DataFrame:
    """A-25, byte-level ids to text in one pass over Arrow batches: ids -> bytes of their tokens -> UTF-8.
    Ids in ``skip`` go; other added tokens stay as written; unknown ids become the unknown token."""
    rest = [c for c in df.columns if c != ids]
    shared = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary

    def run(batches):
        m = shared.value
        back = {ch: b for b, ch in enumerate(byte_to_unicode())}
        raw = [t.encode() if t in m.added or any(c not in back for c in t) else bytes(back[c] for c in t) for t in (*m.vocab, m.unk or "")]
        last, gone, tokens = len(raw) - 1, np.array(sorted(skip), np.int64), pa.array(raw, pa.large_binary())
        for b in _slices(batches):
            lists = b.column(len(rest))
            sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            stay = ~np.isin(ids, gone)
            ends = np.r_[0, np.cumsum(stay)][np.r_[0, np.cumsum(sizes)]]
            ids = ids[stay]
            taken = tokens.take(pa.array(np.where((ids < 0) | (ids >= last), last, ids)))  # its bytes lie one after the other
            _, at, data = taken.buffers()
            cut = np.frombuffer(at, np.int64)[taken.offset:][ends] if len(ids) else np.zeros(len(ends), np.int64)
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cut), data if data is not None else pa.py_buffer(b"")])
            try:
                text = text.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no UTF-8
                text = pa.array([t.decode("utf-8", "replace") for t in text.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=[*rest, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in rest]).schema.fields),
                        f"`{out}` string"])
    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(ids)).mapInArrow(run, schema)
