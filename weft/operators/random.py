"""Seeded random tensors (C-83, C-87 .. C-90, C-95, D-14).

Every draw is ``uniform(seed, ids..., stream)`` — a pure function of the row
ids — so results survive retries, executor loss and re-partitioning (Spark's
``rand()`` does not).  The streams of one row are independent hash chains.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.hashing import uniform


def _u(seed: int, ids: Sequence, stream: int) -> Column:
    return uniform(seed, *ids, F.lit(stream))


def rand_uniform(seed: int, ids: Sequence, lo: float = 0.0, hi: float = 1.0, stream: int = 0) -> Column:
    """C-87: U[lo, hi)."""
    return F.lit(lo) + F.lit(hi - lo) * _u(seed, ids, stream)


def rand_normal(seed: int, ids: Sequence, mean: float = 0.0, std: float = 1.0) -> Column:
    """C-88: Box-Muller on streams 0 and 1."""
    u1, u2 = _u(seed, ids, 0), _u(seed, ids, 1)
    return F.lit(mean) + F.lit(std) * F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def randint(seed: int, ids: Sequence, lo: int, hi: int, stream: int = 1) -> Column:
    """C-89: integers in [lo, hi)."""
    return F.floor(_u(seed, ids, stream) * (hi - lo)).cast("long") + F.lit(lo)


def bernoulli(seed: int, ids: Sequence, p, stream: int = 0) -> Column:
    """C-90: 1 with probability p."""
    pc = p if isinstance(p, Column) else F.lit(p)
    return F.when(_u(seed, ids, stream) < pc, 1).otherwise(0)


def dropout(x: Column, p: float, seed: int, ids: Sequence, training: bool = True, stream: int = 1) -> Column:
    """C-83: keep with probability 1-p and scale by 1/(1-p) (identity when not training)."""
    if not training or p == 0:
        return x
    return F.when(_u(seed, ids, stream) < p, F.lit(0.0)).otherwise(x / (1.0 - p))


def cumulative(w: Column) -> Column:
    """Running sums of an array (element k = w_0 + ... + w_k), one linear fold."""
    folded = F.aggregate(w, F.array().cast("array<double>"),
                         lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)))
    return F.when(F.size(w) > 0, folded).otherwise(F.array().cast("array<double>"))


def multinomial_rows(df: DataFrame, w: str, n: int, seed: int, id_col: str, replacement: bool = True) -> DataFrame:
    """C-95: ``n`` draws per row from unnormalised weights (inverse CDF on the
    running sum: first j with cum_j >= u * total).

    Without replacement the draws are the ``n`` largest Efraimidis-Spirakis
    keys u^(1/w) — a different (equally valid) random stream than sequential
    removal.  Returns (id, draw, sample)."""
    if replacement:
        cum = cumulative(F.col(w).cast("array<double>"))
        tot = F.element_at(cum, -1)
        x = df.select(id_col, cum.alias("_cum"), tot.alias("_tot"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
        x = x.withColumn("_thr", uniform(seed, F.col(id_col), F.col("draw")) * F.col("_tot"))
        pick = F.array_min(F.transform("_cum", lambda c, j: F.when(c >= F.col("_thr"), j)))
        return x.select(id_col, "draw", pick.alias("sample"))
    keyed = F.transform(F.col(w).cast("array<double>"), lambda v, j: F.struct(
        F.when(v > 0, -F.pow(uniform(seed, F.col(id_col), j), F.lit(1.0) / v)).alias("k"), j.alias("j")))
    # zero-weight items can never be drawn
    top = F.slice(F.array_sort(F.filter(keyed, lambda s: s["k"].isNotNull())), 1, n)
    return df.select(id_col, F.posexplode(F.transform(top, lambda s: s["j"])).alias("draw", "sample"))


def argmax_sample(logits: Column) -> Column:
    """D-14 at temperature 0: the lowest index of the maximum."""
    x = logits.cast("array<double>")
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def sample_next(df: DataFrame, logits: str, temperature: float, seed: int, id_col: str) -> DataFrame:
    """D-14: ``(id_col, next_token)``: the largest logit (the first of equals) at temperature 0, else one draw from
    softmax(logits / temperature), decided by ``seed`` and the id alone.

    Logits are taken relative to the row's largest, so no exponent overflows; an empty or null row has no
    next token.  A negative temperature is an error."""
    if temperature < 0:
        raise ValueError("temperature must not be negative")
    if temperature == 0:
        return df.select(id_col, argmax_sample(F.col(logits)).alias("next_token"))
    x = F.col(logits).cast("array<double>")
    top = F.array_max(x)
    weights = df.where(F.size(logits) > 0).select(id_col, F.transform(x, lambda v: F.exp((v - top) / temperature)).alias("_w"))
    drawn = multinomial_rows(weights, "_w", 1, seed, id_col=id_col)
    return drawn.select(id_col, F.col("sample").alias("next_token"))
