"""Order-dependent primitives that never put a whole group into one task.

A plain ``Window.partitionBy(key).orderBy(o)`` ships every row of a key to a
single task; a key that holds a third of the data then becomes one giant task.
The helpers here use a two-level scheme instead:

1. **Blocks.**  The input is staged once; its row count sets the number of
   blocks; Spark's range partitioning on ``(keys..., order...)`` deals the rows
   and the result, tagged with its block, is staged again.  Blocks are contiguous,
   balanced ranges of the sort order; a hot key spans many blocks, and every
   branch of a plan, or a recomputed partition, reads the same blocks.
2. Inside each (block, key) a window computes the local running value; the
   window's exchange (hash on block, key) is the only shuffle of the full data.
3. A small table of per-(block, key) totals (partial aggregation, at most
   ``n x keys-per-block`` rows) gets a running offset with a window over blocks.
4. The offsets are joined back on (block, key): the big side is already
   partitioned on those columns, so only the small table moves (AQE broadcasts
   it when small; with no keys it has ``n`` rows and is broadcast outright).

Rows that carry texts or arrays are staged with a row number; only their keys, order and value go through the
steps, and a join on the row number brings the sums back: the payload is shuffled once and written once.

Order expressions must be ascending (negate a numeric column for descending).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.session import stage_table

BLK = "_blk"
ROWS_PER_BLOCK = 1_000_000


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def n_blocks(df: DataFrame) -> int:
    """Least number of range blocks: the session's shuffle partition count."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence, n: int | None = None) -> DataFrame:
    """Rows dealt to blocks that follow each other in the order of (keys, order); ``_blk`` is a row's block.

    The input is computed once and staged; its row count gives the number of blocks (at least the
    session's shuffle partitions, and one for every ``ROWS_PER_BLOCK`` rows), Spark's range
    partitioning deals them, and the dealt rows are staged too, so every later read sees the
    same blocks.  A key of any size is spread over as many blocks as it needs."""
    rows = stage_table(df, "ordered")
    n = n or max(n_blocks(df), -(-rows.count() // ROWS_PER_BLOCK))
    dealt = rows.repartitionByRange(n, *_cols(keys), *_cols(order)) if keys or order else rows
    return stage_table(dealt.withColumn(BLK, F.spark_partition_id()), "blocks")


def _join_offsets(local: DataFrame, offsets: DataFrame, keys: list) -> DataFrame:
    """One row per block and key of ``offsets`` joined to the rows; null keys match each other."""
    if not keys:
        return local.join(F.broadcast(offsets), [BLK], "inner")  # one row a block
    o = offsets.withColumnsRenamed({BLK: "_o_blk"} | {k: f"_o_{i}" for i, k in enumerate(keys)})
    on = F.col(BLK) == F.col("_o_blk")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{i}"))
    return local.join(o, on).drop("_o_blk", *[f"_o_{i}" for i in range(len(keys))])


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value, out: str,
               exclusive: bool = False, n: int | None = None) -> DataFrame:
    """Running sum of ``value`` per ``keys`` in ``order`` (inclusive by default).

    ``order`` must be a total order inside each key (add a unique tie-breaker),
    otherwise the running sum of tied rows is undefined — exactly as for SQL.
    """
    keys = list(keys)
    val = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("_v", val)
    if _carries(df, [*keys, "_v", *[o for o in order if isinstance(o, str)]]):
        # texts and arrays are staged with a row number and moved once, to meet their sum; narrow rows are put in order
        rows = stage_table(df.withColumn("_row", F.monotonically_increasing_id()), "ordered")
        narrow = rows.select("_row", "_v", *[F.col(k) for k in keys], *[c.alias(f"_ord{i}") for i, c in enumerate(_cols(order))])
        run = _running(blocked(narrow, keys, [f"_ord{i}" for i in range(len(order))], n), keys, [f"_ord{i}" for i in range(len(order))], out, exclusive)
        return rows.drop("_v", *([out] if out in rows.columns else [])).join(run.select("_row", out), "_row").drop("_row")
    return _running(blocked(df, keys, order, n), keys, order, out, exclusive).drop("_v")


def _carries(df: DataFrame, known: Sequence[str]) -> bool:
    """Whether rows hold texts, arrays or the like besides the columns ``known``."""
    wide = ("string", "binary", "array", "map", "struct", "variant")
    return any(t.startswith(wide) for c, t in df.dtypes if c not in known)


def _running(b: DataFrame, keys: list, order: Sequence, out: str, exclusive: bool) -> DataFrame:
    """Blocks with the running sum ``out`` of their column ``_v``."""
    w_local = Window.partitionBy(BLK, *keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_loc", F.sum("_v").over(w_local))
    totals = b.groupBy(BLK, *keys).agg(F.sum("_v").alias("_bt"))
    w_blk = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BLK, *keys, F.coalesce(F.sum("_bt").over(w_blk), F.lit(0)).alias("_off"))
    res = _join_offsets(local, offsets, keys)
    run = F.col("_off") + F.col("_loc")
    if exclusive:
        run = run - F.col("_v")
    return res.withColumn(out, run).drop("_loc", "_off", BLK)


def prefix_agg(df: DataFrame, keys: Sequence[str], order: Sequence, value, out: str, fn: str = "max",
               exclusive: bool = False, n: int | None = None) -> DataFrame:
    """Running max / min of ``value`` per key in ``order`` (nulls ignored), same
    two-level scheme as ``prefix_sum``.  ``exclusive`` excludes the current row."""
    keys = list(keys)
    agg = {"max": F.max, "min": F.min}[fn]
    comb = {"max": F.greatest, "min": F.least}[fn]
    val = F.col(value) if isinstance(value, str) else value
    b = blocked(df.withColumn("_v", val), keys, order, n)
    hi = -1 if exclusive else 0
    w_local = Window.partitionBy(BLK, *keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, hi)
    local = b.withColumn("_loc", agg("_v").over(w_local))
    totals = b.groupBy(BLK, *keys).agg(agg("_v").alias("_bt"))
    w_blk = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(BLK, *keys, agg("_bt").over(w_blk).alias("_off"))
    res = _join_offsets(local, offsets, keys)
    # greatest/least skip nulls, so an empty side never hides the other
    return res.withColumn(out, comb(F.col("_off"), F.col("_loc"))).drop("_v", "_loc", "_off", BLK)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "idx",
              n: int | None = None) -> DataFrame:
    """0-based position of each row inside its key, in ``order`` (skew-safe row_number)."""
    return prefix_sum(df, keys, order, F.lit(1).cast("long"), out, exclusive=True, n=n)


def lag_value(df: DataFrame, keys: Sequence[str], order: Sequence, col, out: str | None = None,
              n: int | None = None) -> DataFrame:
    """Value of ``col`` on the previous row of the same key (null on the first row).

    ``col`` may be a dict {column: output name} to lag several columns in one pass.
    Inside a block the window ``lag`` is exact; the first row of a block takes
    the last value of the previous block of the same key from a small table.
    """
    keys = list(keys)
    cols = dict(col) if isinstance(col, dict) else {col: out}
    b = blocked(df, keys, order, n)
    w = Window.partitionBy(BLK, *keys).orderBy(*_cols(order))
    local = b.withColumn("_rn", F.row_number().over(w))
    for i, c in enumerate(cols):
        local = local.withColumn(f"_lag{i}", F.lag(c).over(w))
    order_struct = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_cols(order))])
    last = b.groupBy(BLK, *keys).agg(*[F.max_by(F.col(c), order_struct).alias(f"_last{i}") for i, c in enumerate(cols)])
    w_blk = Window.partitionBy(*keys).orderBy(BLK)
    prev = last.select(BLK, *keys, *[F.lag(f"_last{i}").over(w_blk).alias(f"_prev{i}") for i in range(len(cols))])
    res = _join_offsets(local, prev, keys)
    for i, o in enumerate(cols.values()):
        res = res.withColumn(o, F.when(F.col("_rn") == 1, F.col(f"_prev{i}")).otherwise(F.col(f"_lag{i}")))
    return res.drop("_rn", BLK, *[f"_lag{i}" for i in range(len(cols))], *[f"_prev{i}" for i in range(len(cols))])


def group_total(df: DataFrame, keys: Sequence[str], value, out: str) -> DataFrame:
    """Attach the per-key total of ``value`` to every row.

    Partial aggregation runs map-side, so the shuffle carries one row per key
    and task; the join back is on the (small) per-key table.
    """
    keys = list(keys)
    val = F.col(value) if isinstance(value, str) else value
    if not keys:
        # a scalar subquery: one value, computed once and inlined as a literal
        return df.withColumn(out, df.agg(F.sum(val)).scalar())
    tot = df.groupBy(*[F.col(k).alias(f"_t_{i}") for i, k in enumerate(keys)]).agg(F.sum(val).alias(out))
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_t_{i}")) for i, k in enumerate(keys)])
    return df.join(tot, on).drop(*[f"_t_{i}" for i in range(len(keys))])
