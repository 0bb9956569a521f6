"""Matrix products on the long encoding, by tiles (C-69, C-70, C-73).

Both matrices are cut into square tiles by one ``groupBy`` each.  A product needs, for each inner tile
index, every row tile of the left with every column tile of the right: the right tiles are repeated
over a number of lanes that follows the measured number of row tiles, the left tiles are dealt to
the lanes, and the join runs on (batch, inner tile, lane), so neither one inner index nor one inner tile
gathers the table.  Joined tiles are multiplied row by row in Arrow batches; the partial products
are summed with partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import stage_table

#: Side of a tile: at most this many squared elements meet in one row.
TILE = 64
#: Row tiles that a lane takes of each inner tile, and the most lanes.
LANE_TILES, MOST_LANES = 256, 4096


def _tiles(m: DataFrame, batch: Sequence[str], row: str, col: str, val: str, tile: int, name: str) -> DataFrame:
    """``(batch..., _r, _c, elements)``: elements of a tile as (row, column, value) within it."""
    within = F.struct(F.pmod(F.col(row), F.lit(tile)).cast("int").alias("r"), F.pmod(F.col(col), F.lit(tile)).cast("int").alias("c"),
                      F.col(val).cast("double").alias("v"))
    rows = m.where(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col(val).isNotNull())
    rows = rows.select(*batch, F.floor(F.col(row) / tile).cast("long").alias("_r"), F.floor(F.col(col) / tile).cast("long").alias("_c"), within.alias("e"))
    # one shuffle, by tile: equal places add up first, so that a tile never has more than its elements
    rows = rows.select(*batch, "_r", "_c", "e.*").repartition(*batch, "_r", "_c").groupBy(*batch, "_r", "_c", "r", "c").agg(F.sum("v").alias("v"))
    return rows.groupBy(*batch, "_r", "_c").agg(F.collect_list(F.struct("r", "c", "v")).alias(name))


def _dense(cell, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of one tile."""
    e = cell.values
    r, c, v = (e.field(k).to_numpy(zero_copy_only=False) for k in ("r", "c", "v"))
    values, there = np.zeros((tile, tile)), np.zeros((tile, tile))
    values[r, c], there[r, c] = v, 1.0
    return values, there


def matmul(a: DataFrame, b: DataFrame, i: str = "i", k: str = "k", j: str = "j", a_val: str = "a", b_val: str = "b", out: str = "val",
           batch: Sequence[str] = (), trans_a: bool = False, trans_b: bool = False, bias: DataFrame | None = None,
           bias_val: str = "bias", tile: int = TILE) -> DataFrame:
    """C-69 / C-70: ``C[batch, i, j] = sum_k A[batch, i, k] B[batch, k, j] (+ bias[j])`` as ``(batch..., i, j, out)``.

    ``trans_a``: A is stored transposed, so its first index, column ``i``, is the inner one and ``k`` the row
    (``trans_b``: B's column ``k`` is the result's column index and ``j`` the inner one).  Absent and null elements are zeros; rows at one place add up; an
    element is returned where some inner index has both factors (with ``bias``: of those, a column
    without a bias row gets none).  ``bias``: ``(j, bias_val)``, one row a column.  ``batch`` columns must
    be in both tables; a null in them or in an index matches nothing."""
    batch = list(batch)
    a_row, a_in = (k, i) if trans_a else (i, k)
    b_in, b_col = (j, k) if trans_b else (k, j)
    left = stage_table(_tiles(a, batch, a_row, a_in, a_val, tile, "_a").withColumnsRenamed({"_r": "_i", "_c": "_k"}), "row-tiles")
    right = _tiles(b, batch, b_in, b_col, b_val, tile, "_b").withColumnsRenamed({"_r": "_k", "_c": "_j"})
    n_tiles, inner = left.agg(F.count("*"), F.approx_count_distinct(F.struct(*batch, "_k"))).first()
    lanes = min(MOST_LANES, max(1, n_tiles // (LANE_TILES * max(inner, 1))))
    left = left.withColumn("_lane", F.pmod(F.col("_i"), F.lit(lanes)))
    right = right.withColumn("_lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    pairs = left.join(right, [*batch, "_k", "_lane"]).select(*batch, "_i", "_j", "_a", "_b")
    types = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    n = len(batch)

    def run(batches):
        for rb in batches:
            parts = []
            for at in range(rb.num_rows):
                (x, xs), (y, ys) = _dense(rb.column(n + 2)[at], tile), _dense(rb.column(n + 3)[at], tile)
                r, c = np.nonzero(xs @ ys)
                parts.append((np.full(len(r), at), r + tile * rb.column(n)[at].as_py(), c + tile * rb.column(n + 1)[at].as_py(), (x @ y)[r, c]))
            if parts:
                of, r, c, v = (np.concatenate(p) for p in zip(*parts))
                yield pa.RecordBatch.from_arrays([*(rb.column(m).take(pa.array(of)) for m in range(n)), pa.array(r, pa.int64()),
                                                  pa.array(c, pa.int64()), pa.array(v, pa.float64())], names=[*batch, "_i", "_j", "_v"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in batch), "_i long, _j long, _v double"])
    total = pairs.mapInArrow(run, schema).groupBy(*batch, F.col("_i").alias(i), F.col("_j").alias(j)).agg(F.sum("_v").alias(out))
    if bias is None:
        return total
    add = bias.select(F.col(j).alias("_bj"), F.col(bias_val).cast("double").alias("_bias"))
    return (total.join(add, F.col(j) == F.col("_bj"), "left")
            .withColumn(out, F.col(out) + F.coalesce(F.col("_bias"), F.lit(0.0))).drop("_bj", "_bias"))


def pairwise_dot(q: DataFrame, k: DataFrame, scale: float | None = None, i: str = "i", d: str = "d", j: str = "j",
                 q_val: str = "q", k_val: str = "k", out: str = "score", batch: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """C-73: ``Q K^T`` (times ``scale``): dot products of the rows ``i`` of Q and ``j`` of K, both stored by
    (row, component ``d``)."""
    # K is stored (row, component): the transposed right factor
    keys = k.select(*batch, F.col(j).alias("_part"), F.col(d).alias("_row"), F.col(k_val).alias("_kv"))
    rows = q.select(*batch, F.col(i).alias("_q"), F.col(d).alias("_part"), F.col(q_val).alias("_qv"))
    got = matmul(rows, keys, "_q", "_part", "_row", "_qv", "_kv", out, batch, trans_b=True, tile=tile)
    return got.select(*batch, F.col("_q").alias(i), F.col("_row").alias(j), (F.col(out) * F.lit(1.0 if scale is None else scale)).alias(out))
