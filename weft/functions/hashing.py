"""Portable 32-bit hashing and seeded uniforms as Column expressions.

Randomness in weft is a pure function of ``(seed, id, position, ...)`` so that
results do not depend on partitioning, task retries or executor loss (Spark's
``rand()`` depends on the partition layout).  All arithmetic stays inside
64-bit LONG without overflow, so ANSI mode never raises: a 32x32-bit product
is split into 16-bit halves (every partial product < 2^49).

Every builder has a twin that emits the same expression as SQL text
(``*_sql``), so the DuckDB oracle can recompute the very same bits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF
# fixed values: the murmur3 32-bit finaliser multipliers and the golden-ratio increment
FMIX_C1 = 0x85EBCA6B
FMIX_C2 = 0xC2B2AE35
GOLDEN = 0x9E3779B9


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def imul32(a: Column, b: int) -> Column:
    """(a * b) mod 2^32 for a in [0, 2^32) and a constant b, overflow-free."""
    lo = b & 0xFFFF
    hi = (b >> 16) & 0xFFFF
    return ((a * F.lit(lo)) + F.shiftleft((a * F.lit(hi)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(M32))


def _xs(x: Column, s: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, s))


def _let(x: Column, fn) -> Column:
    """Bind ``x`` once and evaluate ``fn(v)``; keeps expression trees linear in size."""
    return F.aggregate(F.array(x), F.lit(0).cast("long"), lambda acc, v: fn(v))


def mix32(x: Column) -> Column:
    """murmur3 fmix32 finaliser on a value in [0, 2^32)."""
    x = _let(x, lambda v: imul32(_xs(v, 16), FMIX_C1))
    x = _let(x, lambda v: imul32(_xs(v, 13), FMIX_C2))
    return _let(x, lambda v: _xs(v, 16))


def mix32_int(x: int) -> int:
    """The same finaliser on a Python int (used to pre-mix literal seeds)."""
    x &= M32
    x ^= x >> 16
    x = (x * FMIX_C1) & M32
    x ^= x >> 13
    x = (x * FMIX_C2) & M32
    return x ^ (x >> 16)


def _seed0(seed) -> Column:
    if isinstance(seed, int):
        return F.lit(mix32_int(seed)).cast("long")
    return mix32(_c(seed).cast("long").bitwiseAND(F.lit(M32)))


def hash32(seed, *parts) -> Column:
    """Chain ``h = mix32(h ^ (part + GOLDEN))`` over the parts, starting from mix32(seed).

    Parts are integers (LONG); their low and high 32 bits are folded, so ids
    beyond 2^32 still hash distinctly.
    """
    h = _seed0(seed)
    for p in parts:
        v = _c(p).cast("long")
        folded = v.bitwiseAND(F.lit(M32)).bitwiseXOR(F.shiftright(v, 32).bitwiseAND(F.lit(M32)))
        h = mix32(h.bitwiseXOR(folded + F.lit(GOLDEN)).bitwiseAND(F.lit(M32)))
    return h


def uniform(seed, *parts) -> Column:
    """A double in [0, 1) from ``hash32``."""
    return hash32(seed, *parts).cast("double") / F.lit(4294967296.0)


def _mix32_array(x: np.ndarray) -> np.ndarray:
    """The finaliser on an array of uint64 below 2^32."""
    m = np.uint64(M32)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(FMIX_C1)) & m
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(FMIX_C2)) & m
    return x ^ (x >> np.uint64(16))


def uniform_array(seed: int, ids: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """``uniform(seed, id, position)`` for every id (rows) and position (columns)."""
    h = np.uint64(mix32_int(seed))
    for p in (ids[:, None], positions[None, :]):
        v = p.astype(np.int64)
        folded = ((v & M32) ^ ((v >> 32) & M32)).astype(np.uint64)
        h = _mix32_array((h ^ (folded + np.uint64(GOLDEN))) & np.uint64(M32))
    return h / 4294967296.0


def draws(seed: int, idx: Column, positions: Sequence[int], n: int | None = None) -> Column:
    """ARRAY<DOUBLE> of ``uniform(seed, idx, k)`` for the given positions k or, with ``n``, ARRAY<INT> of
    ``floor(uniform * n)``; a null idx has null elements.

    A hash as a column expression is interpreted node by node in every lambda; here a whole Arrow batch of ids
    is hashed at once.  Not for use inside a lambda (bind the array with ``let``)."""
    ks = np.array(list(positions), np.int64)

    @F.arrow_udf("array<double>" if n is None else "array<int>")
    def drawn(ids: pa.Array) -> pa.Array:
        x = uniform_array(seed, ids.fill_null(0).to_numpy(zero_copy_only=False), ks)
        x = x if n is None else np.floor(x * n).astype(np.int32)
        none = np.repeat(ids.is_null().to_numpy(zero_copy_only=False), len(ks))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * len(ks), pa.int32()), pa.array(x.ravel(), mask=none))

    return drawn(idx.cast("long"))


# ---- SQL twins (DuckDB / ANSI text; DuckDB spells XOR as xor()) -------------

def imul32_sql(a: str, b: int) -> str:
    lo = b & 0xFFFF
    hi = (b >> 16) & 0xFFFF
    return f"(((({a}) * {lo}) + (((({a}) * {hi}) & 65535) << 16)) & {M32})"


def _xs_sql(x: str, s: int) -> str:
    return f"xor({x}, ({x}) >> {s})"


def _let_sql(x: str, fn) -> str:
    return f"(list_transform([{x}], lambda v: {fn('v')}))[1]"


def mix32_sql(x: str) -> str:
    x = _let_sql(x, lambda v: imul32_sql(_xs_sql(v, 16), FMIX_C1))
    x = _let_sql(x, lambda v: imul32_sql(_xs_sql(v, 13), FMIX_C2))
    return _let_sql(x, lambda v: _xs_sql(v, 16))


def hash32_sql(seed, *parts: str) -> str:
    if isinstance(seed, int):
        h = f"CAST({mix32_int(seed)} AS BIGINT)"
    else:
        h = mix32_sql(f"(CAST({seed} AS BIGINT) & {M32})")
    for p in parts:
        v = f"CAST({p} AS BIGINT)"
        h = mix32_sql(f"(xor({h}, (xor(({v} & {M32}), (({v} >> 32) & {M32})) + {GOLDEN})) & {M32})")
    return h


def uniform_sql(seed, *parts: str) -> str:
    return f"(CAST({hash32_sql(seed, *parts)} AS DOUBLE) / 4294967296.0)"


def hash32_py(seed: int, *parts: int) -> int:
    """The same chain on Python ints (for per-row helpers inside tasks)."""
    h = mix32_int(seed)
    for p in parts:
        folded = (p & M32) ^ ((p >> 32) & M32)
        h = mix32_int((h ^ (folded + GOLDEN)) & M32)
    return h


def uniform_py(seed: int, *parts: int) -> float:
    return hash32_py(seed, *parts) / 4294967296.0
