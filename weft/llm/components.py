"""Connected components of a link table, as rounds of joins and partial aggregates.

Alternates the two star steps (every neighbour above a node is hung on the node's
smallest neighbour, then every neighbour below it) until the links are stars.  Each round
is two aggregations and two equi-joins on plain shuffles, so a hub with very many links
is split by the skew join; the rounds grow with the logarithm of a chain's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import staged


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    hung = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` (any orderable type) -> ``(node, root)``: the smallest node of each
    node's component, for every node that has a link to another one.

    Self links and null ends are ignored; repeated links count once; no links, no rows.
    """
    e = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .distinct(), "links")
    before = None
    while True:
        now = _mark(e)
        if now == before or not now[0]:
            break
        before = now
        e = staged(_small_star(_large_star(e)), "links")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
