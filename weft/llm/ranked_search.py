"""Ranked lexical search of a query set over all texts, by MaxScore with pair bounds.

The index is a table of blocks of up to ``BLOCK_ROWS`` texts; it holds the postings of the query
set's terms, so its size follows the texts and no term's list is ever in one place.  Two Spark
passes build it: one counts terms and writes the blocks, whose sums (texts, lengths, texts of each
term) are taken by ``groupBy``; one turns counts into impacts and adds, for each block, the largest
impact of each term and, for each pair of terms that a query pairs up, their intersection list with
the joint impacts' maximum.

Pairs: a query's terms in order of their largest weight, two by two.  A text of a block holds both
terms of a pair, and then gains at most their joint maximum, or one, and then at most that term's
maximum.  So ``max(joint, one, other)`` bounds what the pair adds, which is less than the sum of the
two terms' maxima wherever the terms peak in different texts or never meet.  Search goes through
the blocks with each query's k-th best score so far as threshold:

* bounds of all pairs of a query don't reach the threshold: the block is skipped;
* else pairs are taken from the highest bound down until the rest, summed, cannot reach it; only
  texts with a term of a taken pair are candidates;
* each candidate has its own bound of the rest: of a pair in whose intersection list it stands the
  joint maximum, else the larger of the two terms' maxima;
* those left get the remaining pairs' impacts pair by pair and are dropped as soon as their score and
  the bounds of what follows cannot reach the threshold.

A text that ties with the k-th best is kept (ties go to the smaller id).  Every task passes on its k best
of each query; a window per query merges them.  Results don't depend on blocks or tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import staged, text_or_empty

#: Texts of a block, and the bytes of query texts that are searched in one pass over the texts.
BLOCK_ROWS, QUERY_BYTES = 1024, 4 << 20
#: Bytes between terms: all of ASCII but digits and letters; A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

Blocks = pa.schema([("ids", pa.binary()), ("no_id", pa.binary()), ("sizes", pa.binary()), ("terms", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())),
                    ("texts", pa.binary()), ("tf", pa.binary()), ("n_texts", pa.int64()), ("n_terms", pa.int64())])
_BLOCKS = "ids binary, no_id binary, sizes binary, terms array<int>, df array<long>, texts binary, tf binary, n_texts long, n_terms long"
_INDEX = "ids binary, no_id binary, terms binary, ends binary, texts binary, impacts binary, single binary, joint binary, meet_ends binary, meet binary"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal stretches of ASCII letters and digits and of all other characters beyond ASCII."""
    return text.translate(_TABLE).split()


def weight(n_texts: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_texts + 2) / (2 * df + 1)))


class QuerySet:
    """The queries of one pass: ``terms`` numbered over all of them, each query's term numbers."""

    def __init__(self, rows):
        self.number: dict[bytes, int] = {}
        self.items = [(key, sorted({self.number.setdefault(t, len(self.number)) for t in terms_of(text)})) for key, text in rows]

    def weigh(self, n_texts: int, total: int, df: dict) -> None:
        """Corpus figures give each term its weight and each query its pairs (a single last term: with -1)."""
        self.n_texts, self.total = n_texts, total
        self.weights = np.array([weight(n_texts, df.get(t, 0)) for t in range(len(self.number))], np.int64)
        pairs: dict[tuple, int] = {}
        self.paired = []
        for key, terms in self.items:
            order = sorted((t for t in terms if t in df and self.weights[t] > 0), key=lambda t: (-self.weights[t], t))
            two = [(a, b) for a, b in zip(order[::2], [*order[1::2], -1])]
            self.paired.append((key, two, np.array([pairs.setdefault(p, len(pairs)) for p in two], np.int64)))
        self.pairs = list(pairs)


def _blocks(queries):
    """Arrow batches of (id, text) -> a row for each block of texts."""
    def run(batches):
        number = queries.value.number
        part = []

        def counted(text):
            words = terms_of(text)
            found = np.array([x for x in map(number.get, words) if x is not None], np.int64)
            return len(words), *np.unique(found, return_counts=True)

        def block(part):
            ids, per = zip(*part)
            sizes = np.array([p[0] for p in per], "<i8")
            term = np.concatenate([p[1] for p in per])
            text = np.repeat(np.arange(len(per)), [len(p[1]) for p in per])
            tf = np.concatenate([p[2] for p in per])
            by = np.argsort(term, kind="stable")
            terms, df = np.unique(term, return_counts=True)
            none = np.array([i is None for i in ids])
            cells = [np.array([i or 0 for i in ids], "<i8").tobytes(), none.tobytes(), sizes.tobytes(), terms, df, text[by].astype("<u2").tobytes(), tf[by].astype("<u4").tobytes(),
                     int((sizes > 0).sum()), int(sizes.sum())]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, Blocks)], schema=Blocks)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                part.append((i, counted(text.as_py())))
                if len(part) == BLOCK_ROWS:
                    yield block(part)
                    part = []
        if part:
            yield block(part)

    return run


def _impacts(queries):
    """Rows of blocks -> rows of the index: impacts instead of counts, maxima, intersection lists."""
    def run(batches):
        q = queries.value
        for b in batches:
            out = []
            for ids, none, sizes, terms, df, texts, tf in zip(*(b.column(i) for i in range(7))):
                sizes, tf = np.frombuffer(sizes.as_py(), "<i8"), np.frombuffer(tf.as_py(), "<u4").astype(np.int64)
                texts, terms, df = np.frombuffer(texts.as_py(), "<u2"), terms.values.to_numpy(), df.values.to_numpy()
                m = np.array([10 + 90 * n * q.n_texts // max(q.total, 1) for n in sizes.tolist()], np.int64)
                share = 1_000_000_000 * tf // (1000 * tf + 8 * m[texts])
                impact = np.repeat(q.weights[terms], df) * share
                ends = np.cumsum(df)
                most = np.maximum.reduceat(impact, ends - df) if len(df) else np.empty(0, np.int64)
                where = {t: slice(e - n, e) for t, e, n in zip(terms.tolist(), ends.tolist(), df.tolist())}
                best = dict(zip(terms.tolist(), most.tolist()))
                dense, meet = np.zeros(len(sizes), np.int64), []
                single = np.array([max(best.get(x, 0), best.get(y, 0)) for x, y in q.pairs], np.int64)
                joint = single.copy()
                last = None
                for i, (x, y) in sorted(enumerate(q.pairs), key=lambda p: p[1][0]):
                    if x != last:
                        if last in where:
                            dense[texts[where[last]]] = 0
                        if x in where:
                            dense[texts[where[x]]] = impact[where[x]]
                        last = x
                    if x in where and y in where:
                        both = texts[where[y]]
                        there = dense[both]
                        hit = there > 0
                        if hit.any():
                            joint[i] = max(joint[i], int((there + impact[where[y]])[hit].max()))
                            meet.append((i, both[hit]))
                sizes_met = np.zeros(len(q.pairs), np.int64)
                sizes_met[[i for i, _ in meet]] = [len(x) for _, x in meet]
                lists = [x for _, x in sorted(meet, key=lambda p: p[0])]
                out.append((ids.as_py(), none.as_py(), terms.astype("<i4").tobytes(), ends.astype("<i4").tobytes(), texts.tobytes(), impact.tobytes(),
                            single.tobytes(), joint.tobytes(), np.cumsum(sizes_met).astype("<i8").tobytes(),
                            (np.concatenate(lists) if lists else np.empty(0, "<u2")).tobytes()))
            names = [c.split()[0] for c in _INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in range(len(names))], names=names)

    return run


class _Block:
    """One row of the index."""

    def __init__(self, row):
        ids, none, terms, ends, texts, impacts, single, joint, meet_ends, meet = row
        self.ids, self.none = np.frombuffer(ids, "<i8"), np.frombuffer(none, bool)
        terms, ends = np.frombuffer(terms, "<i4").tolist(), np.frombuffer(ends, "<i4").tolist()
        self.where = {t: slice(a, e) for t, a, e in zip(terms, [0, *ends], ends)}
        self.texts, self.impacts = np.frombuffer(texts, "<u2"), np.frombuffer(impacts, "<i8")
        self.single, self.joint = np.frombuffer(single, "<i8"), np.frombuffer(joint, "<i8")
        self.meet_ends, self.meet = np.frombuffer(meet_ends, "<i8"), np.frombuffer(meet, "<u2")
        self.score = np.zeros(len(self.ids), np.int64)

    def add(self, pair: tuple, to: np.ndarray) -> None:
        for t in pair:
            at = self.where.get(t)
            if at is not None:
                to[self.texts[at]] += self.impacts[at]

    def together(self, i: int) -> np.ndarray:
        """Texts that hold both terms of pair i."""
        return self.meet[self.meet_ends[i - 1] if i else 0:self.meet_ends[i]]

    def best(self, pairs: list, which: np.ndarray, least: int):
        """(texts, scores) of all texts with a score of at least ``least`` (and above 0)."""
        bounds = self.joint[which]
        if int(bounds.sum()) < least:
            return None
        order = np.argsort(-bounds, kind="stable")
        left = np.r_[np.cumsum(bounds[order][::-1])[::-1], 0]
        taken = max(1, int(np.searchsorted(-left, -least, side="right")))  # what follows stays below least
        taken = min(taken, len(order))
        self.score[:] = 0
        for j in order[:taken].tolist():
            self.add(pairs[j], self.score)
        rest = np.full(len(self.score), int(self.single[which[order[taken:]]].sum()))
        for i in which[order[taken:]].tolist():
            rest[self.together(i)] += self.joint[i] - self.single[i]
        near = np.flatnonzero((self.score > 0) & (self.score + rest >= least))
        for at in range(taken, len(order)):
            if not len(near):
                break
            got = np.zeros(len(self.score), np.int64)
            self.add(pairs[order[at]], got)
            self.score[near] += got[near]
            near = near[self.score[near] + left[at + 1] >= least]
        return near, self.score[near]


def _search(queries, k: int):
    """Rows of the index -> this task's k best texts of each query."""
    def run(batches):
        q = queries.value
        heaps: dict[int, list] = defaultdict(list)  # of (score, has id, -id); the smallest is the k-th best
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                block = _Block(row)
                for at, (_, pairs, which) in enumerate(q.paired):
                    heap = heaps[at]
                    got = block.best(pairs, which, heap[0][0] if len(heap) == k else 1) if pairs else None
                    if got is None:
                        continue
                    texts, scores = got
                    if len(texts) > k:  # no more than k of a block can stay
                        few = np.lexsort((block.ids[texts], block.none[texts], -scores))[:k]
                        texts, scores = texts[few], scores[few]
                    for text, score in zip(texts.tolist(), scores.tolist()):
                        one = (score, not block.none[text], -int(block.ids[text]))
                        if len(heap) < k:
                            heapq.heappush(heap, one)
                        elif one > heap[0]:
                            heapq.heapreplace(heap, one)
        rows = [(q.paired[at][0], -i if has else None, score) for at, heap in heaps.items() for score, has, i in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["query", "doc_id", "score"])

    return run


def build(docs: DataFrame, queries: QuerySet, id_col: str = "doc_id", text_col: str = "text"):
    """The index of ``docs`` for a query set, as a staged table, and the weighed query set's broadcast."""
    sc = docs.sparkSession.sparkContext
    blocks = staged(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("t"))
                    .mapInArrow(_blocks(sc.broadcast(queries)), _BLOCKS), "search-blocks")
    n, total = blocks.agg(F.coalesce(F.sum("n_texts"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    per = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
    queries.weigh(n, total, {r.terms: r.df for r in per.collect()})  # at most the query set's terms
    shared = sc.broadcast(queries)
    return staged(blocks.select("ids", "no_id", "sizes", "terms", "df", "texts", "tf").mapInArrow(_impacts(shared), _INDEX), "search-index"), shared


def _query_sets(items: DataFrame):
    """The queries in order, some at a time (``QUERY_BYTES`` of text, or one longer text)."""
    rows, size = [], 0
    for r in items.toLocalIterator():
        text = bytes(r.t)
        if rows and size + len(text) > QUERY_BYTES:
            yield QuerySet(rows)
            rows, size = [], 0
        rows.append((r.query, text))
        size += len(text)
    yield QuerySet(rows)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k texts of highest score above 0 for each row of ``items``.

    Terms are as in :func:`terms_of`, each of a query once; scores are integers, so they don't
    depend on order.  Equal scores rank by ascending id; a null id ranks after all others.  A null
    text has no terms; rows that repeat, with or without one id, each count as a text; items that repeat
    are each a query of their own.  Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    numbered = staged(items.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item"),
                                   text_or_empty(query_col).cast("binary").alias("t")), "search-queries")
    found = None
    for queries in _query_sets(numbered.select("query", "t")):
        index, shared = build(docs, queries, id_col, text_col)
        got = index.mapInArrow(_search(shared, k), "query long, doc_id long, score long")
        found = got if found is None else found.unionByName(got)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id"))
    best = found.withColumn("rank", nth).where(F.col("rank") <= k)
    return best.join(numbered.select("query", "item"), "query").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
