"""Nearest neighbours by inner product with multi-index hashing.

Codes: vectors get one more component that makes all of them equally long (queries get zero
there), so a larger inner product is a smaller angle.  Four rotations are learned by
iterative quantisation on a bounded sample; the signs of the rotated vectors are the code.

Index: rows are dealt to blocks of about ``BLOCK`` by a hash of their id.  A block holds its
vectors, its codes split into substrings of 16 bits, and for each substring the distinct
values with the list of rows that have them.

Search: within a block the Hamming radius of a query grows until ``rerank`` rows lie inside.
By the pigeonhole principle a code within radius r has some substring within r // m bits, so
all list entries of substring values that near are fetched, their whole codes compared, and
the rows inside the radius ranked by inner product in double precision.  Every code within
the radius is retrieved, equal ones too.  The stated query set meets the index in blocks:
each block of queries is sent to each block of the index, and a query's best rows of all
blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import staged

BLOCK, QUERY_BLOCK = 8192, 512
ROTATIONS, SUB_BITS = 4, 16
#: Rows at most on which rotations are fitted.
SAMPLE = 8192
#: Share of a block that a query's radius must reach before it stops growing, and least rows.
RERANK_SHARE, RERANK_LEAST = 0.05, 256
ROUNDS = 30


def clean(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part: an id, and a vector that is not null,
    empty or zero, of finite components, and as long as most vectors are."""
    v = F.col(vec_col).cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where("vec_id is not null and v is not null and size(v) > 0").where(fine).where(F.exists("v", lambda x: x != 0)))
    n = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("v") == (n["dim"] if n else 0))


def learn_rotations(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """``(dim, ROTATIONS * dim)``: side by side, rotations fitted by iterative quantisation, each
    from another random start."""
    rng, out, d = np.random.default_rng(seed), [], x.shape[1]
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS if len(x) else 0):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        out.append(r)
    return np.concatenate(out, axis=1)


def _codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Rows of 16-bit substrings of the sign codes, filled up with zeros."""
    bits = x @ rotation >= 0
    pad = -bits.shape[1] % SUB_BITS
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)).view(np.uint16)


def _lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(longest ** 2 - (x ** 2).sum(axis=1), 0)))) / longest


class Block:
    """One block of the index: for each substring its distinct values and the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.lists, self.guess = codes, [], 0
        for s in range(codes.shape[1]):
            values, which = np.unique(codes[:, s], return_inverse=True)
            order = np.argsort(which, kind="stable")
            self.lists.append((values, which, order, np.searchsorted(which[order], np.arange(len(values) + 1))))

    def within(self, code: np.ndarray, apart: list, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose code is within ``radius`` bits, and their distances.  ``apart``: for each
        substring how far each of its values is from the query's."""
        near = radius // len(code)
        hit = np.zeros(len(self.codes), bool)
        for (values, which, order, starts), far in zip(self.lists, apart):
            probe = np.flatnonzero(far <= near)
            if len(probe) > 64:  # one pass over the rows is cheaper than many lists
                hit |= (far <= near)[which]
            else:
                for v in probe:
                    hit[order[starts[v]:starts[v + 1]]] = True
        rows = np.flatnonzero(hit)
        far = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
        return rows[far <= radius], far[far <= radius]

    def reach(self, code: np.ndarray, least: int) -> np.ndarray:
        """Rows within the smallest radius that holds at least ``least`` rows (all, if there are
        fewer).  The search starts near the radius of the query before and grows from there."""
        if least >= len(self.codes):
            return np.arange(len(self.codes))
        apart = [np.bitwise_count(values ^ own) for (values, _, _, _), own in zip(self.lists, code)]
        step = len(code)
        radius = self.guess // step * step + step - 1  # the largest with this radius a substring
        rows, far = self.within(code, apart, radius)
        while len(rows) < least:
            radius += step
            rows, far = self.within(code, apart, radius)
        edge = self.guess = int(np.partition(far, least - 1)[least - 1])
        return rows[far <= edge]


def _pack(block: str):
    """``(block, ids, vectors)`` of a group's rows, as bytes, in order of ids."""
    def run(pdf):
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = np.array(pdf["v"].tolist(), "<f8")
        return pd.DataFrame({block: [int(pdf["b"].iloc[0])], f"{block}_ids": [pdf["vec_id"].to_numpy("<i8").tobytes()],
                             f"{block}_vecs": [x.tobytes()]})
    return run


def _blocks(rows: DataFrame, name: str, n: int) -> DataFrame:
    return rows.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n))).groupBy("b").applyInPandas(
        _pack(name), f"{name} long, {name}_ids binary, {name}_vecs binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank_share: float = RERANK_SHARE,
           rerank_least: int = RERANK_LEAST) -> DataFrame:
    """``vectors`` and ``queries`` as :func:`clean` makes them -> ``query_id, rank, vec_id, score``.

    Each query's ``k`` best rows among those retrieved, rows with its own id left out, by
    inner product in double precision, ties to the smaller vec_id.  A query id that
    repeats is asked once (its smallest vector); rows that repeat an id count each.  No
    vectors or no queries: no rows.
    """
    spark = vectors.sparkSession
    rows = staged(vectors, "vectors")
    asked = staged(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n, longest, = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    n_asked = asked.count()
    schema = "query_id long, vec_id long, score double"
    if not n or not n_asked:
        return spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                                     F.lit(0.0).alias("score"))
    longest = float(np.sqrt(longest))
    keep = max(1, n // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(keep)) == 0).select("v").limit(SAMPLE).collect()
    x = np.array([r["v"] for r in sample]) if sample else np.zeros((0, len(rows.first()["v"])))
    rotation = spark.sparkContext.broadcast(learn_rotations(_lengthened(x, longest)))  # (dim + 1)**2 * ROTATIONS numbers
    n_blocks, n_query_blocks = -(-n // BLOCK), -(-n_asked // QUERY_BLOCK)
    index = staged(_blocks(rows, "block", n_blocks), "index")
    ask = _blocks(asked, "query_block", n_query_blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))

    def run(frames):
        turn, held, block = rotation.value, None, None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if held != r.block:
                    ids = np.frombuffer(r.block_ids, "<i8")
                    vecs = np.frombuffer(r.block_vecs, "<f8").reshape(len(ids), -1)
                    held, block = r.block, Block(_codes(_lengthened(vecs, longest), turn))
                q_ids = np.frombuffer(r.query_block_ids, "<i8")
                q = np.frombuffer(r.query_block_vecs, "<f8").reshape(len(q_ids), -1)
                codes = _codes(np.column_stack((q, np.zeros(len(q)))), turn)
                least = max(rerank_least, int(rerank_share * len(ids)), k + 1)
                parts = []
                for own, vec, code in zip(q_ids, q, codes):
                    near = block.reach(code, least)
                    near = near[ids[near] != own]
                    score = vecs[near] @ vec
                    best = np.lexsort((ids[near], -score))[:k]
                    parts.append((np.full(len(best), own), ids[near[best]], score[best]))
                yield pd.DataFrame({c: np.concatenate([p[i] for p in parts])
                                    for i, c in enumerate(("query_id", "vec_id", "score"))})

    found = ask.join(index, "block").mapInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
