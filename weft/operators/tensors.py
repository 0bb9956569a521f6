"""Tensors stored as tables, and the operators that mix dimensions (C3 .. C7).

Encodings
---------
* ``vector``: ``(i, v ARRAY<DOUBLE>)`` — one row per leading index; row-wise
  math is in ``weft.functions.arrays`` and never shuffles.
* ``long``: ``(i, j, val)`` — one row per element; ops that mix rows are
  joins / groupBys on index columns.  Reductions use partial aggregation, so
  the shuffle carries one row per (task, output index), not per element.

Row-count-bounded helpers (``to_vector``) assemble at most one row's worth
of elements (the trailing dimension), never a whole tensor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import arrays as A
from weft.session import stage_table

#: Largest table that a join may copy to every executor, in bytes of its rows written out.
BROADCAST_BYTES = 64 << 20


def checked_broadcast(small: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` staged, measured and marked for broadcast if its rows, written out as JSON (longer than
    their binary form), stay within ``max_bytes``; beyond it the join is a plain shuffle join."""
    small = stage_table(small, "measured")
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns]))))).first()[0] or 0
    return F.broadcast(small) if size <= max_bytes else small


def to_long(vec: DataFrame, i: str = "i", v: str = "v", j: str = "j", val: str = "val") -> DataFrame:
    """vector -> long via posexplode (narrow, no shuffle)."""
    keep = [c for c in vec.columns if c != v]
    return vec.select(*keep, F.posexplode(A.dbl(v)).alias(j, val))


def to_vector(long: DataFrame, keys: Sequence[str], j: str = "j", val: str = "val", v: str = "v") -> DataFrame:
    """long -> vector: one array per key, ordered by j (group size = row length)."""
    return (long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(j).alias(j), F.col(val).cast("double").alias(val)))).alias("_s"))
            .select(*keys, F.col(f"_s.{val}").alias(v)))


# --- C3 reductions over the row axis (across rows) ---------------------------

def reduce_rows(long: DataFrame, by: Sequence[str], val: str = "val", ops: Sequence[str] = ("sum",)) -> DataFrame:
    """Reduce ``val`` over everything except ``by`` (sum, mean, var, max, min, argmax, argmin)."""
    aggs = []
    x = F.col(val).cast("double")
    for op in ops:
        if op == "sum":
            aggs.append(F.sum(x).alias("sum"))
        elif op == "mean":
            aggs.append(F.avg(x).alias("mean"))
        elif op == "var":
            aggs.append(F.var_samp(x).alias("var"))
        elif op == "max":
            aggs.append(F.max(x).alias("max"))
        elif op == "min":
            aggs.append(F.min(x).alias("min"))
        else:
            raise ValueError(op)
    return long.groupBy(*by).agg(*aggs)


def arg_reduce(long: DataFrame, by: Sequence[str], over: str, val: str = "val", largest: bool = True) -> DataFrame:
    """argmax / argmin of ``val`` along ``over`` (lowest index on ties)."""
    key = F.struct((-F.col(val) if largest else F.col(val)).alias("k"), F.col(over).alias("o"))
    return long.groupBy(*by).agg(F.min_by(F.col(over), key).alias("argmax" if largest else "argmin"))


def matrix_norm(long: DataFrame, ord, i: str = "i", j: str = "j", val: str = "val") -> Column | DataFrame:
    """Matrix norms: 'fro', inf (max row abs-sum), -inf (min row abs-sum), 1 / -1 (max / min column abs-sum)."""
    if ord == "fro":
        return long.agg(F.sqrt(F.sum(F.col(val) * F.col(val))).alias("norm"))
    axis = i if ord in (float("inf"), float("-inf")) else j
    sums = long.groupBy(axis).agg(F.sum(F.abs(F.col(val))).alias("_s"))
    f = F.max if ord in (float("inf"), 1) else F.min
    return sums.agg(f("_s").alias("norm"))


def tensor_stats(long: DataFrame, by: Sequence[str] = (), val: str = "val") -> DataFrame:
    """C-46: mean, population variance max(0, E[x^2]-mu^2) and L2 norm in one pass."""
    x = F.col(val).cast("double")
    return long.groupBy(*by).agg(F.avg(x).alias("mean"),
                                 F.greatest(F.lit(0.0), F.avg(x * x) - F.avg(x) * F.avg(x)).alias("var"),
                                 F.sqrt(F.sum(x * x)).alias("l2"))


def matrix_report(vec: DataFrame, v: str = "v") -> DataFrame:
    """C-45 / C-46 / C-48 of a matrix with one row array a row, by one aggregate: ``fro``,
    ``norm_inf`` / ``norm_ninf`` (largest / smallest row sum of magnitudes), ``norm_1`` / ``norm_n1`` (column
    sums), ``mean``, ``var`` (population), ``n_nan`` and ``n_inf``.

    Rows are summed in place; each column sum is a partial aggregate, so a task passes on one row as wide
    as the matrix (whose width a first look at the sizes gives).  Null rows and elements are skipped; no elements, nulls and 0."""
    x = F.filter(A.dbl(v), lambda e: e.isNotNull())
    add = lambda f: F.aggregate("_x", F.lit(0.0), lambda s, e: s + f(e))
    rows = vec.select(A.dbl(v).alias("_all"), x.alias("_x")).where("_all IS NOT NULL").select(
        "_all", F.size("_x").cast("long").alias("_n"), add(F.abs).alias("_abs"), add(lambda e: e).alias("_sum"), add(lambda e: e * e).alias("_sq"),
        F.size(F.filter("_x", F.isnan)).cast("long").alias("_nan"),
        F.size(F.filter("_x", lambda e: F.abs(e) == F.lit(float("inf")))).cast("long").alias("_inf"))
    width = rows.agg(F.max(F.size("_all"))).first()[0] or 0
    columns = [F.sum(F.abs(F.get("_all", F.lit(c)))).alias(f"_c{c}") for c in range(width)]
    got = rows.agg(F.sum("_n").alias("n"), F.sum("_sum").alias("s"), F.sum("_sq").alias("q"), F.max("_abs").alias("norm_inf"),
                   F.min("_abs").alias("norm_ninf"), F.coalesce(F.sum("_nan"), F.lit(0)).alias("n_nan"),
                   F.coalesce(F.sum("_inf"), F.lit(0)).alias("n_inf"), *columns)
    of = [F.col(f"_c{c}") for c in range(width)]
    one = F.array_max(F.array(*of)) if of else F.lit(None).cast("double")
    low = F.array_min(F.array(*of)) if of else F.lit(None).cast("double")
    mean = F.col("s") / F.col("n")
    return got.select(F.sqrt("q").alias("fro"), "norm_inf", "norm_ninf", one.alias("norm_1"), low.alias("norm_n1"), mean.alias("mean"),
                      F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean).alias("var"), "n_nan", "n_inf")


def all_close(pairs: DataFrame, key: str, x: str, y: str, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """C-49 of two matrices whose rows stand side by side: ``all_close``, ``max_err``, ``mean_err`` and the place
    (``worst_i, worst_j``, the smallest of equals) of the largest error.  Elements are compared where they
    are (no join); where only one side has an element or is null, the matrices are not close."""
    el = pairs.select(F.col(key).alias("i"), F.posexplode(F.arrays_zip(A.dbl(x).alias("x"), A.dbl(y).alias("y"))).alias("j", "e"))
    err = F.abs(F.col("e.x") - F.col("e.y"))
    d = el.select("i", "j", err.alias("err"), F.coalesce(err <= atol + rtol * F.abs(F.col("e.y")), F.lit(False)).alias("ok"))
    worst = F.struct(F.col("err"), -F.col("i"), -F.col("j"))
    return d.agg(F.coalesce(F.min("ok"), F.lit(True)).alias("all_close"), F.max("err").alias("max_err"), F.avg("err").alias("mean_err"),
                 F.max_by("i", worst).alias("worst_i"), F.max_by("j", worst).alias("worst_j"))


# --- C4 shape ops on the long encoding ------------------------------------------

def reshape(long: DataFrame, n_cols_in: int, n_cols_out: int, i="i", j="j") -> DataFrame:
    """Row-major view of an (N, n_cols_in) matrix as (-1, n_cols_out)."""
    flat = F.col(i).cast("long") * n_cols_in + F.col(j)
    return long.withColumns({i: F.floor(flat / n_cols_out).cast("long"), j: (flat % n_cols_out).cast("long")})


def transpose(long: DataFrame, i="i", j="j") -> DataFrame:
    return long.withColumnsRenamed({i: "_t", j: i}).withColumnRenamed("_t", j)


def flip(long: DataFrame, dim: str, size: int | Column) -> DataFrame:
    s = size if isinstance(size, Column) else F.lit(size)
    return long.withColumn(dim, s - 1 - F.col(dim))


def narrow(long: DataFrame, dim: str, start: int, length: int) -> DataFrame:
    """C-54/C-55: keep [start, start+length) of ``dim`` and rebase it to 0."""
    return long.filter((F.col(dim) >= start) & (F.col(dim) < start + length)).withColumn(dim, F.col(dim) - start)


def slice_ranges(long: DataFrame, ranges: dict) -> DataFrame:
    """C-54: keep ``[start, end)`` of several dimensions at once and rebase each to 0; an end of None is open."""
    for dim, (start, end) in ranges.items():
        keep = F.col(dim) >= start
        long = long.filter(keep if end is None else keep & (F.col(dim) < end))
    return long.withColumns({dim: F.col(dim) - start for dim, (start, _) in ranges.items()})


def unsqueeze(long: DataFrame, dim: str) -> DataFrame:
    """C-51: a new dimension of size one."""
    if dim in long.columns:
        raise ValueError(f"the tensor has a dimension {dim!r}")
    return long.withColumn(dim, F.lit(0).cast("long"))


def squeeze(long: DataFrame, dim: str, val: str = "val") -> DataFrame:
    """C-51: without a dimension of size one; an element elsewhere than at 0 of it is an error when evaluated."""
    bad = F.raise_error(F.concat(F.lit(f"dimension {dim} is larger than one: index "), F.col(dim).cast("string")))
    return long.withColumn(val, F.when(F.col(dim) == 0, F.col(val)).otherwise(bad)).drop(dim)


def chunk_ids(long: DataFrame, dim: str, size: int) -> DataFrame:
    """C-56/C-57: split ``dim`` into pieces of ``size`` (last may be short): adds ``chunk``, rebases ``dim``."""
    return long.withColumns({"chunk": F.floor(F.col(dim) / size).cast("long"), dim: F.col(dim) % size})


def cat(parts: Sequence[DataFrame], dim: str, sizes: Sequence[int]) -> DataFrame:
    """C-58: concatenate along ``dim`` by offsetting each part's index."""
    out, off = None, 0
    for p, n in zip(parts, sizes):
        q = p.withColumn(dim, F.col(dim) + off)
        out = q if out is None else out.unionByName(q)
        off += n
    return out


def stack(parts: Sequence[DataFrame], new_dim: str = "s") -> DataFrame:
    """C-59: new leading index = position in ``parts``."""
    out = None
    for k, p in enumerate(parts):
        q = p.withColumn(new_dim, F.lit(k).cast("long"))
        out = q if out is None else out.unionByName(q)
    return out


def tri(long: DataFrame, k: int = 0, upper: bool = True, i="i", j="j", val="val", out: str | None = None) -> DataFrame:
    """C-61 triu / tril: zero outside the triangle (j - i >= k, or <= k), in place or as column ``out``."""
    keep = (F.col(j) - F.col(i) >= k) if upper else (F.col(j) - F.col(i) <= k)
    return long.withColumn(out or val, F.when(keep, F.col(val)).otherwise(F.lit(0.0)))


def index_write(dst: DataFrame, src: DataFrame, offsets: dict, keys: Sequence[str], val="val") -> DataFrame:
    """C-62: overwrite the block of ``dst`` at ``offsets`` with ``src`` (left join + coalesce)."""
    s = src.select(*[(F.col(k) + offsets.get(k, 0)).alias(k) for k in keys], F.col(val).alias("_src"))
    return (dst.join(s, list(keys), "left")
            .withColumn(val, F.coalesce(F.col("_src"), F.col(val))).drop("_src"))


# --- C5 index ops ------------------------------------------------------------------

def gather(vec_col: Column, index_col: Column) -> Column:
    """C-63 on the vector encoding: element at a 0-based index (null when out of range)."""
    return F.try_element_at(A.dbl(vec_col), (index_col + 1).cast("int"))


def index_select(ids: DataFrame, table: DataFrame, id_col: str, key: str) -> DataFrame:
    """C-64: rows of ``table`` by id, repeats allowed (inner equi-join)."""
    return ids.join(table, ids[id_col] == table[key], "inner")


def scatter_add(base: DataFrame, src: DataFrame, keys: Sequence[str], val: str = "val") -> DataFrame:
    """C-65 / C-66: add ``src`` values into ``base`` at their target index.

    Source rows are pre-aggregated per target index (partial aggregation), then
    unioned with the base and summed again — a hot target index never forms one
    huge group."""
    add = src.groupBy(*keys).agg(F.sum(val).alias(val))
    return base.select(*keys, F.col(val).cast("double").alias(val)).unionByName(add).groupBy(*keys).agg(
        F.sum(val).alias(val))


#: Elements of the largest weight table that may travel with every task (32 MB of doubles).
WEIGHT_ELEMENTS = 4_000_000


def linear_rows(vec: DataFrame, weights: DataFrame, v: str = "v", w_key: str = "o", w_vec: str = "w",
                bias: str | None = None, out: str = "y") -> DataFrame:
    """C-72: y_i = W x_i (+ b) for a vector table and a weight table (one row per output feature).

    Every row computes its outputs in place, in the order of ``w_key``, from the weights as one
    value (a scalar subquery): no join, no shuffle, repeated and null ids keep their rows.
    Weights beyond ``WEIGHT_ELEMENTS`` are refused; use ``matmul`` on the long form."""
    size = weights.agg(F.sum(F.size(w_vec).cast("long"))).first()[0] or 0
    if size > WEIGHT_ELEMENTS:
        raise ValueError(f"{size} weights; linear_rows takes {WEIGHT_ELEMENTS}, matmul any number")
    b = F.coalesce(F.col(bias).cast("double"), F.lit(0.0)) if bias else F.lit(0.0)
    table = weights.agg(F.array_sort(F.collect_list(F.struct(F.col(w_key).alias("o"), A.dbl(w_vec).alias("w"), b.alias("b"))))).scalar()
    x = A.dbl(v)
    y = F.transform("_weights", lambda s: F.aggregate(F.zip_with(x, s["w"], lambda p, q: p * q), F.lit(0.0),
                                                      lambda acc, t: acc + t) + s["b"])
    return vec.withColumn("_weights", table).withColumn(out, y).drop("_weights")

