"""Exact removal of word windows that occur more than once, by recompression.

Recompression rewrites every text in rounds.  A round names runs of one symbol (in some rounds)
and pairs of neighbouring symbols: a bit of each symbol's name calls it left or right, and a left
symbol followed by a right one become one symbol.  Names are hashes of what they stand for, so they
are the same in every task and a round needs no exchange of names; whether two symbols pair depends
on them and their neighbours only.  So equal passages get the same symbols, all but a few at
their two ends.  For each symbol the words [lo, hi) that decided on it are tracked exactly.

Spark rounds, in which names are counted over all texts by ``groupBy`` (with partial aggregation,
so a name that a third of all texts holds is one row a task) and only those met once return to
their texts:

1. Low symbols.  A window holding all of [lo, hi) of a symbol that no other place has is not
   repeated.  What remains are candidates; windows without such a symbol are among them.
2. High symbols, in texts with candidates: from each symbol's start to the first symbol start from
   which no window of its own can still begin, at least a window's length.  If the name of such a
   tile, the digest of its words, is met twice, all windows that start in its first symbol are repeated.
3. The candidates left, mostly at the ends of long repeats, are named by their words' digest, and so
   are those of one tile of each name met twice, since a candidate left may have its equal there.

Equal windows have equal names in every round, so no repeat is lost; the digests of rounds 2 and 3
have 128 bits, so none is made up.  The texts lie in a table bucketed by row, so that they are
shuffled once and then joined with the small tables of places without a shuffle or sort.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import shared_path, staged, text_or_empty
from weft.llm.periodic_runs import mix

#: Rounds after which symbols are low and high, and the rounds that also name runs.
LOW, HIGH, RUN_ROUNDS = 6, 8, (0, 6)
#: Words that are rewritten at once, and that are named at once.
CHUNK, BLOCK = 1 << 16, 1 << 14
_LEN_BITS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def spaced(text: bytes) -> bytes:
    """The text's words joined by one space."""
    return b" ".join(text.split())  # bytes: at space and \x09-\x0D


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of a spaced text that has one."""
    space = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.r_[0, space + 1], np.r_[space, len(joined)]


def _spans(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Names of the stretches [lo, hi) of values, wherever they stand."""
    n = len(values)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(n, _BACK)])
    upto = np.r_[np.uint64(0), np.cumsum(values * power[:-1])]
    return mix((upto[hi] - upto[lo]) * back[lo], (hi - lo).astype(np.uint64))


def word_names(joined: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word, some at a time."""
    letters, out = np.frombuffer(joined, np.uint8), np.empty(len(lo), np.uint64)
    for i in range(0, len(lo), BLOCK):
        a, b = lo[i:i + BLOCK], hi[i:i + BLOCK]
        out[i:i + BLOCK] = _spans(letters[a[0]:b[-1]].astype(np.uint64) + np.uint64(1), a - a[0], b - a[0])
    return out


class Symbols:
    """Symbols of several texts after some rounds: ``names``, first word ``start``, text ``doc``, the
    deciding words ``lo`` to ``hi`` and ``inner`` (no text's end took part in the decision)."""

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        n = len(names)
        self.names, self.doc, self.start = names, doc, np.arange(n)
        self.lo, self.hi, self.inner = self.start.copy(), self.start + 1, np.ones(n, bool)

    def _seen(self, lo, hi, inner, at, side):
        """Take the neighbours ``side`` (-1, 1) of the symbols ``at`` into the deciding words."""
        to = at + side
        there = (to >= 0) & (to < len(self.doc))
        there[there] = self.doc[to[there]] == self.doc[at[there]]
        to = to[there]
        lo[there] = np.minimum(lo[there], self.lo[to])
        hi[there] = np.maximum(hi[there], self.hi[to])
        inner[there] &= self.inner[to]
        inner[~there] = False

    def _take(self, names, at, lo, hi, inner):
        self.names, self.lo, self.hi, self.inner = names, lo, hi, inner
        self.doc, self.start = self.doc[at], self.start[at]

    def run_round(self, level: int) -> None:
        """Runs of one symbol become one."""
        cut = (self.names[1:] != self.names[:-1]) | (self.doc[1:] != self.doc[:-1])
        at = np.flatnonzero(np.r_[True, cut])
        last = np.r_[at[1:], len(cut) + 1] - 1
        k = (last - at + 1).astype(np.uint64)
        names = np.where(k > 1, mix(self.names[at], k + np.uint64(level << 32)), self.names[at])
        lo, hi = self.lo[at].copy(), self.hi[last].copy()
        inner = np.logical_and.reduceat(self.inner, at)
        self._seen(lo, hi, inner, at, -1)
        self._seen(lo, hi, inner, last, 1)
        self._take(names, at, lo, hi, inner)

    def pair_round(self, level: int) -> None:
        """A left symbol followed by a right one become one."""
        left = mix(self.names, np.full(1, level + 1, np.uint64)) >> np.uint64(63) == 1
        first = np.zeros(len(left), bool)
        first[:-1] = left[:-1] & ~left[1:] & (self.doc[:-1] == self.doc[1:])
        second = np.r_[False, first[:-1]]
        at = np.flatnonzero(~second)
        pair = first[at]
        names, lo, hi, inner = self.names[at], self.lo[at].copy(), self.hi[at].copy(), self.inner[at].copy()
        one = at[pair]
        names[pair] = mix(names[pair], self.names[one + 1] + np.uint64(level))
        for which, side in ((pair, 1), (~pair & left[at], 1), (~pair & ~left[at], -1)):
            a, b, c = lo[which], hi[which], inner[which]
            self._seen(a, b, c, at[which], side)
            lo[which], hi[which], inner[which] = a, b, c
        self._take(names, at, lo, hi, inner)

    def rounds(self, first: int, last: int) -> Symbols:
        for level in range(first, last):
            if len(self.names):
                if level in RUN_ROUNDS:
                    self.run_round(level)
                self.pair_round(level)
        return self


def _chunks(rows, least: int):
    """(row, spaced text, number of words) of the texts with ``least`` words at least, together about
    CHUNK words at a time."""
    part, size = [], 0
    for row, text in rows:
        joined = spaced(text)
        n = joined.count(b" ") + 1
        if n >= least:
            part.append((row, joined, n))
            size += n
            if size >= CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def _symbols(part):
    """Word names, sizes and first words of the texts, their words' bounds and their symbols."""
    sizes = np.array([n for _, _, n in part])
    joined = b" ".join([t for _, t, _ in part])
    lo, hi = word_bounds(joined)
    names = word_names(joined, lo, hi)
    return names, sizes, np.cumsum(sizes) - sizes, (lo, hi), Symbols(names, np.repeat(np.arange(len(part)), sizes))


def low_names(part, window: int):
    """(name, row, place) of the low symbols whose deciding words fit a window."""
    names, _, begin, _, s = _symbols(part)
    s.rounds(0, LOW)
    good = np.flatnonzero(s.inner & (s.hi - s.lo <= window))
    lo, hi, doc = s.lo[good], s.hi[good], s.doc[good]
    rows = np.fromiter((r for r, _, _ in part), np.int64, len(part))
    return _spans(names, lo, hi).view(np.int64), rows[doc], (lo - begin[doc]) << _LEN_BITS | (hi - lo)


def _items(cell) -> np.ndarray:
    """The numbers of an Arrow list; none of a null."""
    return cell.values.to_numpy() if cell.is_valid else np.empty(0, np.int64)


def candidate_mask(n: int, places: np.ndarray, window: int) -> np.ndarray:
    """Window starts of a text of n words that no place of an unshared symbol rules out."""
    left = np.zeros(n - window + 2, np.int32)
    lo = places >> _LEN_BITS
    hi = lo + (places & ((1 << _LEN_BITS) - 1))
    np.add.at(left, np.maximum(hi - window, 0), 1)
    np.add.at(left, np.minimum(lo, n - window) + 1, -1)
    return np.cumsum(left[:-1]) == 0


def intervals(mask: np.ndarray) -> np.ndarray:
    """[first, end) of each stretch of true values, flat."""
    return np.flatnonzero(np.diff(np.r_[False, mask, False]))


def from_intervals(flat, n: int) -> np.ndarray:
    mask = np.zeros(n, bool)
    for a, b in zip(flat[::2], flat[1::2]):
        mask[a:b] = True
    return mask


def _digests(joined: bytes, first, ends) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests of the stretches of bytes, as two signed numbers each."""
    d = b"".join([xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(first.tolist(), ends.tolist())])
    both = np.frombuffer(d, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def tiles(starts: np.ndarray, can: np.ndarray, window: int):
    """Of the symbol starts of one text: (first, next, end) of the tiles whose windows are all candidates."""
    ends = np.searchsorted(starts, starts[1:] + window - 1)  # no window of the symbol begins at or beyond next
    ok = ends < len(starts)
    a, b, e = starts[:-1][ok], starts[1:][ok], starts[ends[ok]]
    miss = np.r_[0, np.cumsum(~can)]
    fine = b <= len(can)
    a, b, e = a[fine], b[fine], e[fine]
    fine = miss[b] == miss[a]
    return a[fine], b[fine], e[fine]


def _once(names: DataFrame, *keys: str) -> DataFrame:
    """``(row, lone)``: for each row the list of its places whose name is met at no other place."""
    met = names.groupBy(*keys).agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("place").alias("place"))
    return met.where("n = 1").groupBy("row").agg(F.collect_list("place").alias("lone"))


def _tiles_met(tile: DataFrame) -> DataFrame:
    """``(row, lone, shown)``: for each row its tiles met once, and those that are the first of several."""
    met = tile.groupBy("n1", "n2").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("at")).select("n", "at.*")
    return met.groupBy("row").agg(F.collect_list(F.when(F.col("n") == 1, F.col("place"))).alias("lone"),
                                  F.collect_list(F.when(F.col("n") > 1, F.col("place"))).alias("shown"))


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
                                      schema=schema)


LOW_SCHEMA = pa.schema([("name", pa.int64()), ("row", pa.int64()), ("place", pa.int64())])
HIGH_SCHEMA = pa.schema([("row", pa.int64()), ("can", pa.list_(pa.int32())), ("first", pa.list_(pa.int32())),
                         ("next", pa.list_(pa.int32())), ("n1", pa.list_(pa.int64())), ("n2", pa.list_(pa.int64()))])
WINDOW_SCHEMA = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("n1", pa.int64()), ("n2", pa.int64())])


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``.  The table's name goes at once; its
    files stay, as an external table's do, and the frame reads them."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", shared_path(spark, "bucketed"))
     .option("compression", "zstd").saveAsTable(name))
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def remove_repeated(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                    buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept``: the text's words, joined by one
    space, without those covered by a window of ``window`` consecutive words whose words also start
    at any other place of any row (the same one included, overlapping or not).

    A null text counts as empty.  Texts of fewer words than the window stay whole.  Rows with one
    doc_id, or none, are rows of their own; other columns are ignored; an empty table gives no rows.
    ``buckets`` of the staged texts: by default ``spark.sql.shuffle.partitions``.
    """
    if not 2 <= window < 1 << _LEN_BITS:
        raise ValueError("window must be from 2 to a million words")
    spark = docs.sparkSession
    k = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = bucketed(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                                 text_or_empty(text_col).cast("binary").alias("text")), "row", k)

    def low(batches):
        for b in batches:
            for part in _chunks(zip(b.column(0).to_pylist(), (t.as_py() for t in b.column(1))), window):
                yield _batch(low_names(part, window), LOW_SCHEMA)

    lone = _once(texts.select("row", "text").mapInArrow(low, "name long, row long, place long"), "name")

    def high(batches):
        for b in batches:
            places = dict(zip(b.column(0).to_pylist(), b.column(2)))
            for part in _chunks(zip(b.column(0).to_pylist(), (t.as_py() for t in b.column(1))), window):
                can = {r: candidate_mask(n, _items(places[r]), window) for r, _, n in part}
                part = [x for x in part if can[x[0]].any()]
                if not part:
                    continue
                _, sizes, begin, (lo, hi), s = _symbols(part)
                s.rounds(0, HIGH)
                cut = np.searchsorted(s.doc, np.arange(len(part) + 1))
                out = []
                for i, (row, joined, _) in enumerate(part):
                    starts = np.r_[s.start[cut[i]:cut[i + 1]] - begin[i], sizes[i]]
                    a, nxt, e = tiles(starts, can[row], window)
                    at = begin[i]
                    out.append((row, intervals(can[row]), a, nxt, *_digests(joined, lo[at + a] - lo[at], hi[at + e - 1] - lo[at])))
                yield _batch([list(c) for c in zip(*out)], HIGH_SCHEMA)

    found = staged(texts.select("row", "text").join(lone.hint("shuffle_hash"), "row", "left").select("row", "text", "lone")
                   .mapInArrow(high, "row long, can array<int>, first array<int>, next array<int>, n1 array<long>, n2 array<long>"),
                   "candidates")
    tile = found.select("row", F.posexplode(F.arrays_zip("n1", "n2")).alias("place", "n")).select("row", "place", "n.n1", "n.n2")
    left = found.select("row", "can", "first", "next").join(_tiles_met(tile), "row", "left")

    def windows(batches):
        for b in batches:
            for row, text, can, first, nxt, lone, shown in zip(*(b.column(i) for i in range(7))):
                joined = spaced(text.as_py())
                lo, hi = word_bounds(joined)
                rest = from_intervals(can.as_py(), len(lo) - window + 1)
                first, nxt = _items(first), _items(nxt)
                shared = np.ones(len(first), bool)
                shared[_items(lone)] = False
                for a, e in zip(first[shared].tolist(), nxt[shared].tolist()):
                    rest[a:e] = False
                at, shown = np.flatnonzero(rest), _items(shown)
                also = [np.arange(a, e) for a, e in zip(first[shown].tolist(), nxt[shown].tolist())]
                every = np.concatenate([at, *also])
                if len(every):  # a place below zero is settled already
                    place = np.concatenate([at, *(-1 - x for x in also)])
                    yield _batch([np.full(len(every), row.as_py()), place, *_digests(joined, lo[every], hi[every + window - 1])], WINDOW_SCHEMA)

    tested = (texts.select("row", "text").join(left.hint("shuffle_hash"), "row")
              .select("row", "text", "can", "first", "next", "lone", "shown").mapInArrow(windows, "row long, place int, n1 long, n2 long"))
    once = staged(_once(tested, "n1", "n2").select("row", F.filter("lone", lambda x: x >= 0).alias("lone")), "lone-windows")

    def keep(batches):
        for b in batches:
            out = []
            for text, can, lone in zip(b.column(1), b.column(2), b.column(3)):
                joined = spaced(text.as_py())
                n = joined.count(b" ") + 1 if joined else 0
                gone = 0
                if can.is_valid:
                    rep = from_intervals(can.as_py(), n - window + 1)
                    rep[_items(lone)] = False
                    edge = np.zeros(n + 1, np.int32)
                    at = np.flatnonzero(rep)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    gone = n - len(stay)
                    if gone:
                        words = joined.split()
                        joined = b" ".join([words[i] for i in stay.tolist()])
                out.append((n, gone, joined))
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    # repeated windows: candidates but those that were named and met once
    told = found.select("row", "can").join(once, "row", "left")
    return (texts.join(told.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "can", "lone")
            .mapInArrow(keep, f"doc_id {id_type}, n_words long, n_removed long, kept string"))
