"""Vocabulary statistics, id lookup and byte-pair-encoding (A-16 .. A-25).

Training works on the table of distinct words (small compared with the corpus); encoding is in
``weft.operators.tokenizer``.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.ordering import row_index
from weft.session import checkpoint_dir, stage_table

# fixed values: special tokens of the BPE path, ids 0..4 in this order
SPECIAL_TOKENS = ["<unk>", "<pad>", "<bos>", "<eos>", "<mask>"]
UNK_ID, PAD_ID, BOS_ID, EOS_ID, MASK_ID = 0, 1, 2, 3, 4


def word_counts(df: DataFrame, pretokenizer, text: str = "text") -> DataFrame:
    """A-16: pre-token frequencies (partial aggregation map-side, then by word)."""
    return (df.select(F.explode(pretokenizer(F.col(text))).alias("word"))
            .groupBy("word").agg(F.count("*").alias("freq")))


def pair_counts(words: DataFrame, symbols: str = "symbols", freq: str = "freq") -> DataFrame:
    """A-17: adjacent symbol pairs weighted by word frequency (one BPE statistics round)."""
    s = F.col(symbols)
    pairs = F.transform(F.sequence(F.lit(1), F.size(s) - 1),
                        lambda i: F.struct(F.element_at(s, i).alias("left_sym"), F.element_at(s, i + 1).alias("right_sym")))
    return (words.filter(F.size(s) > 1)
            .select(F.explode(pairs).alias("p"), F.col(freq))
            .groupBy(F.col("p.left_sym").alias("left_sym"), F.col("p.right_sym").alias("right_sym"))
            .agg(F.sum(freq).cast("long").alias("freq")))


def frequency_vocab(wc: DataFrame, min_freq: int, first_id: int = len(SPECIAL_TOKENS)) -> DataFrame:
    """Word-level vocabulary: words with freq >= min_freq, ids by (freq desc, word)."""
    v = wc.filter(F.col("freq") >= min_freq)
    v = row_index(v, [], [-F.col("freq"), F.col("word")], "id")
    return v.select("word", (F.col("id") + first_id).alias("id"))


def tokens_to_ids(pieces: DataFrame, vocab: DataFrame, unk_id: int = UNK_ID, token: str = "word") -> DataFrame:
    """A-22: id of each token, ``unk_id`` when missing (left join on the vocab)."""
    return (pieces.join(vocab.select(F.col("word").alias(token), "id"), token, "left")
            .withColumn("id", F.coalesce(F.col("id"), F.lit(unk_id)).cast("long")))


def ids_to_tokens(ids: DataFrame, vocab: DataFrame, unk: str = "<unk>") -> DataFrame:
    """A-22 inverse: token of each id, ``unk`` when missing."""
    return (ids.join(vocab.select("id", F.col("word").alias("token")), "id", "left")
            .withColumn("token", F.coalesce(F.col("token"), F.lit(unk))))


def post_process(ids: Column, bos: int | None = BOS_ID, eos: int | None = EOS_ID,
                 pair: Column | None = None) -> Column:
    """A-23: template ``<bos> A <eos>`` (and ``A <eos> B <eos>`` for a pair);
    ``None`` omits that special token."""
    parts = []
    if bos is not None:
        parts.append(F.array(F.lit(bos).cast("long")))
    parts.append(ids.cast("array<long>"))
    if eos is not None:
        parts.append(F.array(F.lit(eos).cast("long")))
    if pair is not None:
        parts.append(pair.cast("array<long>"))
        if eos is not None:
            parts.append(F.array(F.lit(eos).cast("long")))
    return F.concat(*parts)


def pad_truncate(ids: Column, max_len: int, pad_id: int = PAD_ID, side: str = "right",
                 truncate: bool = True) -> tuple[Column, Column]:
    """A-24: pad to ``max_len`` with ``pad_id`` on ``side`` (attention mask 1/0),
    truncating longer arrays (from the right) when ``truncate``."""
    kept = F.slice(ids, 1, max_len) if truncate else ids
    k = F.size(kept)
    pad = F.array_repeat(F.lit(pad_id), F.greatest(F.lit(max_len) - k, F.lit(0)))
    ones = F.array_repeat(F.lit(1), k)
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - k, F.lit(0)))
    if side == "right":
        out, mask = F.concat(kept, pad), F.concat(ones, zeros)
    else:
        out, mask = F.concat(pad, kept), F.concat(zeros, ones)
    return out, mask


# --- byte-level BPE (A-10, A-18 .. A-21, A-25) ---------------------------------------

# fixed value: the GPT-2 pre-tokenisation pattern (contractions, letters, numbers, other, spaces); a run that
# nothing follows is taken whole (possessive), which matches the same
BYTE_LEVEL_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"


def byte_to_unicode() -> list[str]:
    """The byte-level alphabet: printable bytes ('!'..'~', '¡'..'¬', '®'..'ÿ') stand for
    themselves, every other byte b maps to chr(256 + k) in increasing byte order."""
    keep = set(range(ord("!"), ord("~") + 1)) | set(range(ord("¡"), ord("¬") + 1)) | set(range(ord("®"), ord("ÿ") + 1))
    out, k = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + k))
            k += 1
    return out


def byte_level_pieces(text, add_prefix_space: bool = False, use_regex: bool = True) -> Column:
    """A-10: GPT-2 regex split, then each piece's UTF-8 bytes mapped to printable code points."""
    c = F.col(text) if isinstance(text, str) else text
    if add_prefix_space:
        c = F.when(c.startswith(" "), c).otherwise(F.concat(F.lit(" "), c))
    return F.transform(raw_pieces(c) if use_regex else F.array(c), byte_letters)


def raw_pieces(text) -> Column:
    """The pieces of :func:`byte_level_pieces` as they are in the text."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(BYTE_LEVEL_PATTERN), 0)


def byte_letters(piece: Column) -> Column:
    """A piece's UTF-8 bytes as printable code points; different pieces have different ones."""
    # bytes read as Latin-1 are code points 0 to 255, of which those that are not printable have other letters
    moved = [(chr(b), ch) for b, ch in enumerate(byte_to_unicode()) if chr(b) != ch]
    old, new = "".join(b for b, _ in moved), "".join(ch for _, ch in moved)
    return F.translate(F.decode(F.encode(piece, "UTF-8"), "ISO-8859-1"), old, new)


def byte_level_word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``word_counts(df, byte_level_pieces)``: pieces are counted as they are in the text, and only the distinct
    ones mapped."""
    return word_counts(df, raw_pieces, text).select(byte_letters(F.col("word")).alias("word"), "freq")


def byte_level_decode(tokens: Column) -> Column:
    """A-25 (byte-level decoder): map every code point back to its byte and decode UTF-8
    (invalid sequences become U+FFFD)."""
    inv = {ch: b for b, ch in enumerate(byte_to_unicode())}
    m = F.create_map(*[x for ch, b in inv.items() for x in (F.lit(ch), F.lit(f"{b:02X}"))])
    hexes = F.transform(F.split(F.array_join(tokens, ""), ""), lambda ch: F.coalesce(m[ch], F.lit("")))
    return F.decode(F.unhex(F.array_join(hexes, "")), "UTF-8")


def merge_queue(symbols: list, merges: dict) -> list:
    """Merge a symbol sequence: ``merges`` gives (left, right) -> (rank, merged); the pair of lowest
    rank goes first, of equal ones the leftmost.  A queue of candidate pairs over a linked list, so
    the work is n log n for n symbols."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (found := merges.get((symbols[i], symbols[j]))) is not None:
            heapq.heappush(queue, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, left, right, merged = heapq.heappop(queue)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two is part of another merge by now
        symbols[i], symbols[j], after[i] = merged, None, after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in symbols if x is not None]


#: Symbols of a row that is merged with others at once; longer ones go through :func:`merge_queue`.
SHORT_ROW = 64
#: Ids up to which the pairs to merge are a table of all pairs.
MOST_IDS = 2048


class RowMerges:
    """``merge_queue`` of many rows of ids at once: ``merges`` gives (left, right) -> (rank, merged).

    Each pass over the rows merges the pair that is first in every row (lowest rank, then leftmost); rows
    without one are done and leave."""

    def __init__(self, merges: dict):
        self.merges = merges
        table = sorted((l << 32 | r, rank, new) for (l, r), (rank, new) in merges.items())
        self.pairs, self.rank, self.new = (np.array([t[k] for t in table], np.int64) for k in range(3))
        #: ids from here on are in no pair; of few ids, the place of each pair in the table or -1
        self.other = 1 + max((max(p) for p in merges), default=-1)
        self.places = None
        if self.other < MOST_IDS:
            self.places = np.full((self.other + 1) ** 2, -1, np.int32)
            self.places[(self.pairs >> 32) * (self.other + 1) + (self.pairs & 0xFFFFFFFF)] = np.arange(len(self.pairs))

    def __call__(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids and sizes of the rows."""
        if not len(self.pairs) or not len(flat):
            return flat, sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        long = sizes > SHORT_ROW
        done = []
        if long.any():
            ends = np.cumsum(sizes)
            for i in np.flatnonzero(long):
                got = merge_queue(flat[ends[i] - sizes[i]:ends[i]].tolist(), self.merges)
                done.append((np.full(len(got), i), np.array(got, np.int64)))
            flat, row = flat[~long[row]], row[~long[row]]
        flat = flat.copy()
        while len(flat) > 1:
            if self.places is None:
                pair = flat[:-1] << 32 | flat[1:]
                k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                found = self.pairs[k] == pair
            else:
                own = np.minimum(flat, self.other)
                k = self.places[own[:-1] * (self.other + 1) + own[1:]]
                found = k >= 0
            at = np.flatnonzero(found & (row[:-1] == row[1:]))
            if not len(at):
                break
            of = row[at]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            first = np.minimum.reduceat(self.rank[k[at]] << 32 | at, starts) & 0xFFFFFFFF
            flat[first] = self.new[k[first]]
            live = np.zeros(len(sizes), bool)
            live[of[starts]] = True
            stay = live[row]
            if not stay.all():
                done.append((row[~stay], flat[~stay]))
            stay[first + 1] = False
            flat, row = flat[stay], row[stay]
        done.append((row, flat))
        row, flat = (np.concatenate([d[k] for d in done]) for k in range(2))
        return flat[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(sizes))


class _Segments:
    """Symbol sequences with frequencies, whose pair counts follow each merge: only the sequences that
    hold the merged pair are looked at."""

    def __init__(self, rows):
        self.parts = [np.frombuffer(seq, "<i4").tolist() for seq, _ in rows]
        self.freq = [n for _, n in rows]
        self.count: dict[tuple, int] = defaultdict(int)
        self.where: dict[tuple, set] = defaultdict(set)
        for i, part in enumerate(self.parts):
            self._add(i, part, self.freq[i])
        self.queue = [(-n, l, r) for (l, r), n in self.count.items()]
        heapq.heapify(self.queue)

    def _add(self, i: int, part: list, n: int) -> set:
        pairs = list(zip(part, part[1:]))
        for p in pairs:
            self.count[p] += n
            if n > 0:
                self.where[p].add(i)
        return set(pairs)

    def best(self) -> tuple | None:
        """(-count, left, right) that is first: highest count, then smallest ids."""
        while self.queue:
            n, l, r = self.queue[0]
            if self.count.get((l, r), 0) == -n and n < 0:
                return self.queue[0]
            heapq.heappop(self.queue)
        return None

    def merge(self, left: int, right: int, merged: int) -> None:
        changed = set()
        for i in self.where.pop((left, right), ()):
            part, out, at = self.parts[i], [], 0
            while at < len(part):
                if at + 1 < len(part) and part[at] == left and part[at + 1] == right:
                    out.append(merged)
                    at += 2
                else:
                    out.append(part[at])
                    at += 1
            if len(out) < len(part):
                changed |= self._add(i, part, -self.freq[i])
                changed |= self._add(i, out, self.freq[i])
                self.parts[i] = out
        for p in changed:
            if self.count[p] > 0:
                heapq.heappush(self.queue, (-self.count[p], *p))


def _rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists one after the other, and the lists' sizes."""
    return column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)


def _neighbours(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ids that another id of their row follows, and the two as one number each."""
    at = np.ones(len(flat), bool)
    at[np.cumsum(sizes)[sizes > 0] - 1] = False
    at = np.flatnonzero(at)
    return at, flat[at] << 32 | flat[at + 1]


def _pair_totals(w: DataFrame) -> DataFrame:
    """``(pair, n)``: neighbouring ids as one number with the frequencies of their words; each batch sums its own first."""
    def run(batches):
        for b in batches:
            flat, sizes = _rows(b.column(0))
            at, pairs = _neighbours(flat, sizes)
            if len(at):
                order = np.argsort(pairs, kind="stable")
                pairs, freq = pairs[order], np.repeat(b.column(1).to_numpy(), sizes)[at][order]
                starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[starts]), pa.array(np.add.reduceat(freq, starts))], names=["pair", "n"])

    return w.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _hot_segments(w: DataFrame, hot: list[int]) -> DataFrame:
    """``(seq, freq)``: words cut between neighbours that are no hot pair; equal stretches of two
    symbols and more (as bytes of four each) are counted together."""
    def run(batches):
        known = np.sort(np.array(hot, np.int64))
        for b in batches:
            flat, sizes = _rows(b.column(0))
            at, pairs = _neighbours(flat, sizes)
            at = at[known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs]  # ids whose next one is in their stretch
            if not len(at):
                continue
            first = np.r_[True, at[1:] != at[:-1] + 1]
            begin, end = at[first], at[np.r_[first[1:], True]] + 2
            freq = np.repeat(b.column(1).to_numpy(), sizes)[begin]
            raw, total = flat.astype("<i4").tobytes(), defaultdict(int)
            for i, j, n in zip((begin * 4).tolist(), (end * 4).tolist(), freq.tolist()):
                total[raw[i:j]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["seq", "freq"])

    return w.mapInArrow(run, "seq binary, freq long").groupBy("seq").agg(F.sum("freq").alias("freq"))


def _letters(words: DataFrame) -> list[str]:
    """The characters of all words, by code point; a task hands on each of its own once a batch."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set("".join(b.column(0).to_pylist()))), pa.string())], names=["c"])

    return sorted(r[0] for r in words.select("word").mapInArrow(run, "c string").distinct().collect())


def train_bpe(words: DataFrame, vocab_size: int | None = None, min_frequency: int = 2,
              special_tokens: list[str] = SPECIAL_TOKENS, max_merges: int | None = None,
              hot_pairs: int = 1024, max_segments: int = 100_000) -> tuple[list[str], list[tuple[str, str]]]:
    """A-18: train BPE on a (word, freq) table of distinct words (byte-mapped already for byte level).

    Ids: specials first, then the alphabet (characters seen, by code point), then one id per merge.
    The most frequent pair is merged in every word, left to right; ties go to the smallest
    (left id, right id).  Stops at ``vocab_size`` / ``max_merges`` or when the best count drops below
    ``min_frequency``.  Returns (vocab in id order, merges).

    Rounds of many merges, with the outcome of one-by-one merging.  A round counts all pairs and
    takes the first ``hot_pairs`` of the order (count, ids).  Counts of pairs there are only fall, and a
    new symbol's pair is met at most as often as the pair it comes from and has a larger id.  So until
    the best pair comes after the last hot one, merges happen only where all neighbours are hot: words
    are cut at their other neighbours, equal stretches are counted by Spark, and at most
    ``max_segments`` of them (else the round takes a quarter of the hot pairs) reach the driver, where
    counts follow each merge through the stretches that hold its pair.  A merge that makes a
    symbol known before ends its round, since the bound fails for it.  The round's merges are then
    applied to the words in Arrow batches, all words of a batch at once, and the words staged; so jobs grow with rounds, not with merges,
    and nothing that grows with the words is collected."""
    checkpoint_dir(words.sparkSession)
    w = words.where(F.length("word") > 0).select("word", F.col("freq").cast("long").alias("freq"))
    w = stage_table(w, "bpe-words")
    alphabet = _letters(w)
    vocab = list(special_tokens) + [a for a in alphabet if a not in special_tokens]
    ids = {t: i for i, t in enumerate(vocab)}
    merges: list[tuple[str, str]] = []

    def room() -> bool:
        return (vocab_size is None or len(vocab) < vocab_size) and (max_merges is None or len(merges) < max_merges)

    def spelled(batches):
        table = np.zeros(0x110000, np.int64)
        table[[ord(c) for c in letters]] = list(letters.values())
        for b in batches:
            words = b.column(0).to_pylist()
            sizes = [len(word) for word in words]
            flat = table[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
            yield _symbols(flat, sizes, b.column(1))

    def rewritten(passes: list):
        def run(batches):
            merged = [RowMerges(p) for p in passes]
            for b in batches:
                flat, sizes = _rows(b.column(0))
                for p in merged:
                    flat, sizes = p(flat, sizes)
                yield _symbols(flat, sizes, b.column(1))
        return run

    def _symbols(flat, sizes, freq):
        ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64())), freq], names=["symbols", "freq"])

    kind = "symbols array<long>, freq long"
    letters = {a: ids[a] for a in alphabet}
    w = stage_table(w.mapInArrow(spelled, kind), "bpe-symbols")
    while room():
        top = _pair_totals(w).orderBy(F.desc("n"), "pair").limit(hot_pairs + 1).collect()
        if not top or top[0]["n"] < min_frequency:
            break
        while True:
            last = (-top[hot_pairs - 1]["n"], top[hot_pairs - 1]["pair"]) if len(top) > hot_pairs else None
            rows = _hot_segments(w, [r["pair"] for r in top[:hot_pairs]]).limit(max_segments + 1).collect()
            if len(rows) <= max_segments or hot_pairs == 1:
                break
            hot_pairs = max(1, hot_pairs // 4)
        parts, passes, known = _Segments([(r["seq"], r["freq"]) for r in rows]), [{}], False
        while room() and not known and (best := parts.best()) is not None:
            n, l, r = best
            if -n < min_frequency or (last is not None and (n, l << 32 | r) > last):
                break
            new = vocab[l] + vocab[r]
            known = new in ids
            if known and passes[-1]:
                passes.append({})
            elif not known:
                ids[new] = len(vocab)
                vocab.append(new)
            passes[-1][l, r] = (len(merges), ids[new])
            merges.append((vocab[l], vocab[r]))
            parts.merge(l, r, ids[new])
        if room():
            w = stage_table(w.mapInArrow(rewritten(passes), kind), "bpe-symbols")
    return vocab, merges


def bpe_encode(docs: DataFrame, key: str, text: str, vocab: list[str], merges: list[tuple[str, str]],
               bos: int | None = BOS_ID, eos: int | None = EOS_ID) -> DataFrame:
    """A-20 in short: byte-level ids of every document between ``bos`` and ``eos`` as (key, ids); see
    :func:`weft.operators.tokenizer.encode` for the policies, pairs and masks."""
    from weft.operators import tokenizer as TK
    model = TK.BpeModel(tuple(vocab), tuple(merges))
    words = TK.encode_words(docs.select(key, TK.words_of(text, model, raw_pieces).alias("words")), model, byte_level=True)
    return words.select(key, post_process(F.col("ids"), bos, eos).alias("ids"))
