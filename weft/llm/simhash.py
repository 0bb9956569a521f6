"""SimHash near-duplicates by a segment-popcount embedding.

Every text gets a 64-bit fingerprint of its word shingles.  A fingerprint is embedded as
the numbers of one bits in its 16 segments of 4 bits.  One flipped bit moves one number by
one, so the Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints: it is a lower bound, and fingerprints within 2 bits meet within 2 steps of
the grid of embeddings.

Grid range join: each distinct fingerprint visits its own cell and the (at most 32) cells
one step away.  Two embeddings within 2 steps share a visited cell, so only cells visited
by at least two distinct fingerprints can hold a link; all others fall in an aggregation.

Exact check: fingerprints within 2 bits share a bit string that differs from each of them
in at most one bit, and that string's embedding is one of the shared cells.  In a kept cell
each fingerprint writes the (at most 4) such strings that lie in the cell; those that meet
in one string are linked, through the smallest, and the distance is counted.  At most 65
distinct fingerprints meet in a string, so no group is large and no pairs are written out,
however many near copies there are: rows grow with the number of distinct fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import staged, text_or_empty
from weft.llm.components import components

SEGMENTS, BITS = 16, 4
SEED = 42
#: Shingle hashes whose bits are unpacked at once (64 bytes each).
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one UTF-8 text as a signed 64-bit number (0 if it has no word)."""
    words = text.lower().split()  # bytes: only A-Z change; splits at space and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:len(words) - width] + 1)).tolist()
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    ends = ends[width - 1:].tolist()
    for at in range(0, len(starts), CHUNK):
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])),
                        np.uint64)
        bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row; a null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = pa.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], names=["doc_id", "text_hash", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                        text_or_empty(text_col).cast("binary").alias("t"))
            .mapInArrow(run, "doc_id long, text_hash long, fp long"))


def _ones(i: int):
    return F.bit_count(F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)))


def _cells(fps: DataFrame) -> DataFrame:
    """``(fp, cell, step)``: visited cells; a cell is the 16 numbers in 3 bits each, step 0 the
    own cell, +-(i + 1) one step up or down in segment i."""
    steps = [F.struct(F.col("own").alias("cell"), F.lit(0).alias("step"))]
    for i in range(SEGMENTS):
        one = F.lit(1 << (3 * i)).cast("long")
        steps += [F.when(F.col(f"n{i}") < BITS, F.struct((F.col("own") + one).alias("cell"), F.lit(i + 1).alias("step"))),
                  F.when(F.col(f"n{i}") > 0, F.struct((F.col("own") - one).alias("cell"), F.lit(-i - 1).alias("step")))]
    own = sum((F.col(f"n{i}").cast("long") * F.lit(1 << (3 * i)).cast("long") for i in range(SEGMENTS)),
              F.lit(0).cast("long"))
    return (fps.select("fp", *[_ones(i).alias(f"n{i}") for i in range(SEGMENTS)])
            .withColumn("own", own)
            .select("fp", F.explode(F.array(*steps)).alias("s"))
            .where("s is not null").select("fp", "s.cell", "s.step"))


def _meeting_strings():
    """Bit strings at most one bit from ``fp`` whose embedding is the visited cell: ``fp`` itself
    at step 0, else ``fp`` with one zero (step up) or one (step down) of that segment flipped."""
    def flipped(j):
        bit = F.expr(f"shiftleft(1L, (abs(step) - 1) * {BITS} + {j})")
        is_one = F.col("fp").bitwiseAND(bit) != 0
        return F.when(is_one == (F.col("step") < 0), F.col("fp").bitwiseXOR(bit))

    return F.when(F.col("step") == 0, F.array("fp")).otherwise(
        F.filter(F.array(*[flipped(j) for j in range(BITS)]), lambda x: x.isNotNull()))


def links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """``fps(fp)``, distinct -> ``(a, b)``: links whose components are those of all pairs at most
    ``max_distance`` (0 or 2) bits apart."""
    if max_distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a <> b")
    if max_distance != 2:
        raise ValueError("max_distance must be 0 or 2")
    cells = _cells(fps)
    shared = cells.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("cell")
    meet = cells.join(shared, "cell").select("fp", F.explode(_meeting_strings()).alias("mid"))
    first = meet.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").select("mid", "b")
    return (meet.join(first, "mid").where("fp <> b")
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_distance)
            .select(F.col("fp").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash`` (of the raw text), ``fp`` (signed),
    ``component_id`` (the smallest doc_id linked with it, over any number of links),
    ``component_size`` (rows) and ``stays``: the row with the component's smallest doc_id (a null is
    larger than any number), of those the one with the smallest text_hash.

    Null and empty texts have fingerprint 0 and are linked like others; rows with one doc_id
    count each; rows without doc_id keep a null id and join the component of their text;
    an empty table gives no rows; other columns are ignored.
    """
    rows = staged(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"),
                                         F.count("*").alias("n")), "distinct-fp")
    root = components(links(fps.select("fp"), max_distance))
    rooted = fps.join(root, fps.fp == root.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted-fp")
    whole = staged(rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("component_size")),
                   "components")
    named = staged(rooted.select("fp", "root").join(whole, "root").select("fp", "first", "component_size"), "named-fp")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), "component_size",
                                         stays.alias("stays"))


def fingerprint_hex(col="fp"):
    return F.lower(F.lpad(F.hex(F.col(col)), 16, "0"))
