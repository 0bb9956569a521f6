"""Mixing sources to target weights by hash-threshold histograms, DataFrame operations only.

Every document has a 60-bit hash of its id and text.  A source's budget is met by whole passes over
its documents plus those below a hash threshold.  The threshold is found without sorting:
the words of a source are summed by the hash's top bits, the bucket in which the budget ends
is refined by the next bits, and so on; from the second round on only (source, hash, size)
of the first round's boundary buckets is read.  Histograms are partial aggregates of at most
``2 ** BITS`` rows a source and task.  The filter is then row-local.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import WORD, staged, text_or_empty

HASH_BITS, BITS = 60, 12


def n_words(col="text"):
    """Words (runs without white space) of a text, 0 for null."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def row_hash(id_col="doc_id", text_col="text"):
    """60 bits of the MD5 of id, space and text as a number; the same in any engine.  Nulls hash as empty."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), text_or_empty(text_col))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` -> the same with ``target`` (double).

    Weights go round the sources in code-point order, null last.  ``share`` times all words
    are dealt by weight; a source stops at ``most`` times its size and what it leaves is
    dealt again by weight.  In the order of size over weight the sources that stop form a
    prefix, so one cumulative sum over the (few) sources finds them.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                                                (nth % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    all_ = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source") \
        .rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = ((F.sum("source_size").over(all_) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), zero))
             / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), zero)))
    # the level at which all later sources could be dealt; it stops falling short at the first open source
    w = w.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    first_open = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("none"),
                          "source", "level")
    final = F.min(F.when(F.col("open"), first_open)).over(all_)["level"]
    return w.select("source", "source_size", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``docs(source, h, size)``, ``target(source, source_size, target)`` -> per source ``source,
    source_size, target, passes`` (whole passes) and ``below``: in the last pass documents with
    a hash below it are taken.  Of the two thresholds round the budget the nearer one counts
    (a tie: the lower)."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = target.select("source", "source_size", "target", passes.cast("long").alias("passes")).withColumn(
        "need", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("at", F.lit(0).cast("long"))
    state, left, rounds = staged(state, "mix-state"), docs.where("size > 0"), HASH_BITS // BITS
    for r in range(rounds):
        shift = HASH_BITS - BITS * (r + 1)
        bucket = F.shiftrightunsigned("h", shift)
        # only the bucket in which the budget ended: prefix `at` of the bits read so far
        inside = left.alias("d").join(
            state.select(F.col("source").alias("s"), "at"),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("h", shift + BITS) == F.col("at")))
        if r == 1:  # some 1 / 2 ** BITS of the rows; the later rounds read no others
            left = staged(inside.select("source", "h", "size"), "mix-boundary")
            inside = left
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("words").over(run)).alias("x").join(
            state.select(F.col("source").alias("s"), "need"), F.col("source").eqNullSafe(F.col("s")))
        # the first bucket whose sum passes the budget; the words before it are met
        end = hist.where("upto > need").groupBy("source").agg(F.min(F.struct("bucket", "words", "upto")).alias("b")) \
            .select(F.col("source").alias("s"), "b.*")
        state = staged(state.select("source", "source_size", "target", "passes", "need").join(
            end, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "passes",
            F.coalesce(F.col("need") - (F.col("upto") - F.col("words")), F.col("need")).alias("need"),
            F.coalesce("bucket", F.lit(-1).cast("long")).alias("at"), "words"), "mix-state")
    # `at` is now one hash value: without it `need` words are missing, with it there are words - need too many
    take = (F.col("words") - F.col("need")) < F.col("need")
    return state.select("source", "source_size", "target", "passes",
                        F.when(F.col("at") < 0, F.lit(0).cast("long"))
                        .otherwise(F.col("at") + F.when(take, 1).otherwise(0)).alias("below"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` plus a struct ``mix`` of ``size, source_size, target,
    copies, taken``: how often the mix takes the row and the words that gives.

    A null text has size 0; a null source is a source of its own; rows with one doc_id
    and text are taken together; a source without words has no budget and none of its rows is taken; an
    empty table gives no rows.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(source_col).cast("string").alias("source"), row_hash(id_col, text_col).alias("h"),
                        n_words(text_col).alias("size"))
    slim = staged(inner.select("source", "h", "size"), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = thresholds(slim, staged(targets(sizes, weights, share, most), "mix-targets"))
    plan = staged(plan.withColumnRenamed("source", "s"), "mix-plan")
    copies = F.col("passes") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return inner.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "row", F.struct("size", "source_size", "target", copies.cast("long").alias("copies"),
                        (copies * F.col("size")).cast("long").alias("taken")).alias("mix"))
