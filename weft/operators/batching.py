"""Samplers, batching, collation and hold-out filtering (B-01 .. B-22).

Order is data: every operator takes an explicit order and assigns positions
with the skew-safe helpers of ``ordering`` (no reliance on input order or on
``collect_list`` order).  Batches are bounded groups (``size`` rows), so
collecting a batch into arrays is safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.hashing import M32, uniform
from weft.operators.ordering import prefix_sum, row_index
from weft.operators.tensors import checked_broadcast

IGNORE_INDEX = -100


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- samplers -------------------------------------------------------------------

def sequential_index(df: DataFrame, order: Sequence, out: str = "idx") -> DataFrame:
    """B-01: 0..n-1 in ``order`` (two-level, no single-partition window)."""
    return row_index(df, [], order, out)


def random_sample(indexed: DataFrame, n: int, seed: int, idx: str = "idx", replacement: bool = False) -> DataFrame:
    """B-02 / B-03: ``n`` positions drawn from a table indexed 0..N-1 by ``idx``.

    Without replacement: floor(n/N) full permutations then a partial one; the
    permutation of epoch e orders items by uniform(seed, e, idx) (ties by idx).
    With replacement: draw d picks item floor(uniform(seed, d) * N); the draws
    are a distributed ``range``.  Returns (pos, idx, ...)."""
    N = indexed.count()
    if N == 0 or n <= 0:
        return indexed.limit(0).withColumn("pos", F.lit(0).cast("long"))
    if replacement:
        draws = indexed.sparkSession.range(0, n).withColumnRenamed("id", "pos")
        draws = draws.withColumn(idx, F.floor(uniform(seed, F.col("pos")) * N).cast("long"))
        return draws.join(indexed, idx, "inner")
    epochs = -(-n // N)
    x = indexed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    x = x.withColumn("_h", uniform(seed, F.col("epoch"), F.col(idx)))
    x = row_index(x, [], ["epoch", "_h", idx], "pos")
    return x.filter(F.col("pos") < n).drop("_h")


def batch_ids(df: DataFrame, idx: str, size: int, drop_last: bool = False, out: str = "batch") -> DataFrame:
    """B-04 / B-05: batch = idx div size; with ``drop_last`` the short tail batch is removed."""
    if size <= 0 or int(size) != size:
        raise ValueError("batch size must be a positive integer")
    x = df.withColumn(out, F.floor(F.col(idx) / size).cast("long"))
    if drop_last:
        n = df.agg(F.count("*")).scalar()
        x = x.filter(F.col(out) < F.floor(n / size))
    return x


def batch_results(df: DataFrame, idx: str, fields: Sequence[str], error: str, size: int = 16, drop_last: bool = True) -> DataFrame:
    """B-05: batches of results: ``(batch, n_rows, columns, error)``.

    Items whose ``error`` is not null failed.  Failed items take their places in the batch; once
    it is full, its first error stands for it and it has no columns.  The short tail batch is
    dropped by default, failed items or not."""
    b = batch_ids(df, idx, size, drop_last)
    item = F.struct(F.col(idx), *[F.col(f) for f in fields])
    g = b.groupBy("batch").agg(F.count("*").alias("n_rows"), F.min_by(error, F.when(F.col(error).isNotNull(), F.col(idx))).alias("error"),
                               F.array_sort(F.collect_list(item)).alias("_items"))
    cols = F.struct(*[F.col(f"_items.{f}").alias(f) for f in fields])
    return g.select("batch", "n_rows", F.when(F.col("error").isNull(), cols).alias("columns"), "error")


def loader_length(df: DataFrame, size: int, drop_last: bool) -> Column:
    """B-06: number of batches (floor or ceil of n / size) as a scalar expression."""
    n = df.agg(F.count("*")).scalar()
    return (F.floor(n / size) if drop_last else F.ceil(n / size)).cast("long")


def take_first(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """B-07: the first n rows in order (n beyond the data is fine) — a top-n, the limit is the feature."""
    return df.orderBy(*[_c(o) for o in order]).limit(n)


# --- collation --------------------------------------------------------------------

def collate_columns(batched: DataFrame, batch: str, order: str, fields: Sequence[str]) -> DataFrame:
    """B-08: struct of arrays from the rows of a batch (each field in row order)."""
    s = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(f).alias(f) for f in fields])))
    agg = batched.groupBy(batch).agg(s.alias("_rows"))
    return agg.select(batch, F.struct(*[F.col(f"_rows.{f}").alias(f) for f in fields]).alias("columns"))


def _collated(values: Column, kind: T.DataType) -> Column:
    """The values of a batch (an array in row order) by their type: an object becomes an object of
    collated fields, a list the list of collated positions, anything else stays as it is."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_collated(F.transform(values, lambda x: x[f.name]), f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        sizes = F.transform(values, lambda x: F.coalesce(F.size(x), F.lit(-1)))
        size = F.array_max(sizes)
        even = (F.array_min(sizes) == size) & (size >= 0)
        at = F.when(~even, F.raise_error(F.lit("each element in list of batch should be of equal size"))).when(
            size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: _collated(F.transform(values, lambda x: F.get(x, i)), kind.elementType))
    return values


def collate_nested(batched: DataFrame, batch: str, order: str, fields: Sequence[str]) -> DataFrame:
    """B-08 for nested rows: ``(batch, columns)`` with one value array for each leaf of the fields' types.

    Objects and lists (tuples) may nest in any way; lists of one place must be of equal size in
    a batch, else evaluating it is an error.  One ordered collection a batch keeps all leaves
    aligned; a null object gives null leaves; a null list is of no size and so an error."""
    s = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(f).alias(f) for f in fields])))
    rows = batched.groupBy(batch).agg(s.alias("_rows"))
    return rows.select(batch, F.struct(*[_collated(F.transform("_rows", lambda x: x[f]), batched.schema[f].dataType).alias(f)
                                         for f in fields]).alias("columns"))


def collate_stack(batched: DataFrame, batch: str, order: str, arr: str, dtype: str = "int") -> DataFrame:
    """B-09: stack equal-length numeric arrays of a batch; unequal lengths give status 'ragged'.
    Casts: u8 -> u32 (long), f64 -> f32 (float), bool -> int."""
    agg = batched.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(arr).alias("_a")))).alias("_r"),
                                     F.min(F.size(arr)).alias("_mn"), F.max(F.size(arr)).alias("_mx"))
    return agg.select(batch, F.when(F.col("_mn") == F.col("_mx"), F.lit("ok")).otherwise(F.lit("ragged")).alias("status"),
                      F.when(F.col("_mn") == F.col("_mx"), F.col("_r._a").cast(f"array<array<{dtype}>>")).alias("stacked"))


def collate_custom(batched: DataFrame, batch: str, by_type: dict) -> DataFrame:
    """B-10: per-column aggregate chosen by Spark type name (exact type first, then
    a 'default' entry); ``by_type`` maps type names to ``fn(column) -> aggregate``."""
    aggs = []
    for f in batched.schema.fields:
        if f.name == batch:
            continue
        t = f.dataType.simpleString()
        fn = by_type.get(t) or by_type.get(t.split("<")[0]) or by_type.get("default")
        if fn is not None:
            aggs.append(fn(F.col(f.name)).alias(f.name))
    return batched.groupBy(batch).agg(*aggs)


# --- sequence collators (toy tasks) -------------------------------------------------

def _arr(x) -> Column:
    return _c(x).cast("array<int>")


def collate_autoregressive(prompt, target, mask=None, bos: int | None = None, eos: int | None = None,
                           ignore_prompt: bool = False) -> tuple[Column, Column, Column]:
    """B-13: full = [bos] + prompt + target + [eos]; input = full[:-1], labels = full[1:].

    ``ignore_prompt`` sets the first len(prompt) labels to -100 (post-shift, so without a
    bos the first target token is masked too); mask=false positions i of the target set
    label len(prompt)+i to -100.  Returns (input, labels, full)."""
    p, t = F.coalesce(_arr(prompt), F.array().cast("array<int>")), _arr(target)
    parts = ([F.array(F.lit(bos))] if bos is not None else []) + [p, t] + ([F.array(F.lit(eos))] if eos is not None else [])
    full = F.concat(*parts)
    n = F.size(full)
    inp = F.slice(full, 1, n - 1)
    lab = F.slice(full, 2, n - 1)
    plen = F.size(p)
    m = _c(mask) if mask is not None else None

    def fix(v, i):
        out = v
        if ignore_prompt:
            out = F.when(i < plen, F.lit(IGNORE_INDEX)).otherwise(out)
        if m is not None:
            k = i - plen
            out = F.when((k >= 0) & (k < F.size(m)) & (F.try_element_at(m, k + 1) == F.lit(False)),
                         F.lit(IGNORE_INDEX)).otherwise(out)
        return out
    return inp, F.transform(lab, fix), full


def visible_target(target, mask, mask_id: int, eos: int | None = None) -> Column:
    """B-16: target with mask=false positions shown as ``mask_id``, then [eos]."""
    t = _arr(target)
    vis = F.transform(t, lambda v, i: F.when(F.try_element_at(_c(mask), i + 1) == F.lit(False), F.lit(mask_id)).otherwise(v))
    return F.concat(vis, F.array(F.lit(eos))) if eos is not None else vis


def collate_encoder_decoder(prompt, target, mask=None, bos: int = None, eos: int | None = None
                            ) -> tuple[Column, Column, Column]:
    """B-15: encoder = prompt (no specials); decoder input = [bos] + target (minus its last
    token when there is no eos); decoder labels = target (mask=false -> -100) + [eos]."""
    if bos is None:
        raise ValueError("encoder-decoder collation needs a bos id")
    p, t = F.coalesce(_arr(prompt), F.array().cast("array<int>")), _arr(target)
    dec_body = t if eos is not None else F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))
    dec_in = F.concat(F.array(F.lit(bos)), dec_body)
    lab = t
    if mask is not None:
        lab = F.transform(t, lambda v, i: F.when(F.try_element_at(_c(mask), i + 1) == F.lit(False), F.lit(IGNORE_INDEX)).otherwise(v))
    if eos is not None:
        lab = F.concat(lab, F.array(F.lit(eos)))
    return p, dec_in, lab


def mask_tokens(seq, ratio: float, mask_id: int, seed: int, row_id) -> tuple[Column, Column, Column]:
    """B-12: independent Bernoulli(ratio) per position from uniform(seed, row_id, pos);
    masked positions -> mask_id with label = original, else label -100; attention all 1."""
    s = _arr(seq)
    u = lambda i: uniform(seed, _c(row_id), i)
    inp = F.transform(s, lambda v, i: F.when(u(i) < ratio, F.lit(mask_id)).otherwise(v))
    lab = F.transform(s, lambda v, i: F.when(u(i) < ratio, v).otherwise(F.lit(IGNORE_INDEX)))
    att = F.transform(s, lambda v: F.lit(1))
    return inp, lab, att


def collate_bidirectional(prompt, target, mask, mask_id: int, seed: int, row_id, ratio: float = 0.15,
                          mask_prompt: bool = False) -> tuple[Column, Column]:
    """B-14: input = prompt + target; eligible = every position (``mask_prompt``) or the
    target positions whose mask is not false; each eligible position is masked with
    probability ``ratio`` and at least one is forced (the eligible position with the
    smallest hash).  Labels = original at masked positions, else -100.  Rows with no
    eligible position get a null input (the reference raises)."""
    p, t = F.coalesce(_arr(prompt), F.array().cast("array<int>")), _arr(target)
    full = F.concat(p, t)
    plen = F.size(p)

    def eligible(i):
        if mask_prompt:
            return F.lit(True)
        k = i - plen
        return (k >= 0) & F.coalesce(F.try_element_at(_c(mask), k + 1), F.lit(True))
    keyed = F.transform(full, lambda v, i: F.struct(uniform(seed, _c(row_id), i).alias("u"), i.alias("i"),
                                                    eligible(i).alias("e")))
    forced = F.array_min(F.transform(F.filter(keyed, lambda s: s["e"]), lambda s: F.struct(s["u"], s["i"])))
    picked = F.transform(keyed, lambda s: s["e"] & ((s["u"] < ratio) | (s["i"] == forced["i"])))
    inp = F.zip_with(full, picked, lambda v, m: F.when(m, F.lit(mask_id)).otherwise(v))
    lab = F.zip_with(full, picked, lambda v, m: F.when(m, v).otherwise(F.lit(IGNORE_INDEX)))
    ok = forced.isNotNull()
    return F.when(ok, inp), F.when(ok, lab)


def right_pad(df: DataFrame, group: str, seq: str, pad_id: int | None = None) -> DataFrame:
    """B-17: pad every sequence of a group (a batch) to the group's longest; the pad is
    ``pad_id`` or, by default, the sequence's last token (0 when empty).  Adds ``padded``
    and ``attention_mask``.  Groups are batches, so the window is bounded."""
    mx = F.max(F.size(seq)).over(Window.partitionBy(group))
    s = _arr(seq)
    pad = F.lit(pad_id) if pad_id is not None else F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))
    x = df.withColumn("_mx", mx)
    k = F.greatest(F.col("_mx") - F.size(s), F.lit(0))
    return (x.withColumn("padded", F.concat(s, F.array_repeat(pad, k)))
            .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.size(s)), F.array_repeat(F.lit(0), k)))
            .drop("_mx"))


# --- hold-out filtering ---------------------------------------------------------------

def sequence_key(dataset, prompt, target, mask=None) -> Column:
    """B-18: dataset | lengths | comma-joined prompt, target and mask."""
    j = lambda a: F.array_join(F.transform(_c(a), lambda x: x.cast("string")), ",")
    parts = [_c(dataset).cast("string"), F.size(_c(prompt)).cast("string"), F.size(_c(target)).cast("string"), j(prompt), j(target)]
    if mask is not None:
        parts.append(F.array_join(F.transform(_c(mask), lambda b: F.when(b, "1").otherwise("0")), ","))
    return F.concat_ws("|", *parts)


def char_sequence_key(dataset, text) -> Column:
    """B-18 for char-level targets without prompt or mask: the MD5 (16 bytes) of data set, length and text, in
    which every character that the char vocabulary doesn't know is its unknown one, so keys are equal
    exactly where the id sequences are, whose digits need not be written out."""
    known = F.regexp_replace(_c(text), "[^\\x{00}-\\x{FF}]", "?")
    return F.unhex(F.md5(F.concat_ws("|", _c(dataset).cast("string"), F.char_length(_c(text)).cast("string"), known)))


def exclude_heldout(train: DataFrame, heldout: DataFrame, key: str = "key") -> DataFrame:
    """B-19: remove training rows whose key is in the held-out set.

    A held-out set of checked size is broadcast (no shuffle of the training
    side, so a hot key cannot pile up in one task); beyond the bound it is a
    shuffled left-anti join, where AQE splits skewed partitions."""
    return train.join(checked_broadcast(heldout.select(key).distinct()), key, "left_anti")


def low_diversity_guard(flags: DataFrame, keys: Sequence[str], order: Sequence, excluded: str = "excluded",
                        max_skips: int = 10) -> DataFrame:
    """B-20: longest run of consecutive excluded rows (the counter resets on a kept row)
    and whether it reaches ``max_skips``.  Gaps-and-islands with a running count of kept
    rows as the island id."""
    keys = list(keys)
    x = prefix_sum(flags, keys, order, F.when(F.col(excluded), 0).otherwise(1).cast("long"), "_island")
    runs = x.filter(F.col(excluded)).groupBy(*keys, "_island").agg(F.count("*").alias("_run"))
    out = runs.groupBy(*keys).agg(F.max("_run").alias("max_consecutive_excluded"))
    base = flags.select(*keys).distinct() if keys else None
    if base is not None:
        out = base.join(out, keys, "left")
    out = out.fillna({"max_consecutive_excluded": 0})
    return out.withColumn("too_many_skips", F.col("max_consecutive_excluded") >= max_skips)


# --- seeds ------------------------------------------------------------------------------

# fixed values: FNV-1a 32-bit offset basis and prime; constants of the sample-seed mixer
FNV_OFFSET = 0x811C9DC5
FNV_PRIME = 0x01000193
SEED_MIX_C1 = 0x7FEB352D
SEED_MIX_C2 = 0x846CA68B


def fnv1a32(text: str) -> int:
    """FNV-1a over UTF-16 code units (JavaScript charCodeAt)."""
    h = FNV_OFFSET
    b = text.encode("utf-16-le")
    for k in range(0, len(b), 2):
        h ^= b[k] | (b[k + 1] << 8)
        h = (h * FNV_PRIME) & M32
    return h


def _seed_mix_int(x: int) -> int:
    x &= M32
    x = ((x ^ (x >> 16)) * SEED_MIX_C1) & M32
    x = ((x ^ (x >> 15)) * SEED_MIX_C2) & M32
    return (x ^ (x >> 16)) & M32


def _seed_mix(x: Column) -> Column:
    from weft.functions.hashing import _let, _xs, imul32
    x = _let(x, lambda v: imul32(_xs(v, 16), SEED_MIX_C1))
    x = _let(x, lambda v: imul32(_xs(v, 15), SEED_MIX_C2))
    return _let(x, lambda v: _xs(v, 16))


def sample_seed(base_seed: int, dataset: str, index, scope: str = "sample") -> Column:
    """B-21: mix(base ^ mix(fnv(dataset)) ^ mix(index) ^ mix(fnv(scope))), never 0."""
    const = (base_seed & M32) ^ _seed_mix_int(fnv1a32(dataset)) ^ _seed_mix_int(fnv1a32(scope))
    idx = _c(index).cast("long").bitwiseAND(F.lit(M32))
    mixed = _seed_mix(F.lit(const).cast("long").bitwiseXOR(_seed_mix(idx)))
    return F.when(mixed == 0, F.lit(1).cast("long")).otherwise(mixed)


def parse_seed(text) -> Column:
    """B-22: a leading integer (after optional spaces and sign) when there is one that fits in 64 bits, else the
    31-multiplier string hash folded to 32 bits (signed) and made non-negative."""
    t = _c(text)
    lead = F.regexp_extract(t, r"^\s*([+-]?\d+)", 1)
    h = F.aggregate(F.transform(F.split(t, ""), lambda ch: F.ascii(ch).cast("long")), F.lit(0).cast("long"),
                    lambda a, c: (a * 31 + c).bitwiseAND(F.lit(M32)))
    signed = F.when(h >= 2 ** 31, h - 2 ** 32).otherwise(h)
    return F.coalesce(lead.try_cast("long"), F.abs(signed))


FORK = 0x5EED  # the stream that child seeds are drawn from


def fork_seed(parent, nth=0) -> Column:
    """B-22: the ``nth`` child seed of a parent seed, a signed 32-bit number.  A child is drawn from its
    parent alone, so it can be taken again anywhere, and forked in turn."""
    return (F.floor(uniform(FORK, _c(parent), F.lit(nth) if isinstance(nth, int) else nth) * 4294967296.0) - 2147483648).cast("long")
