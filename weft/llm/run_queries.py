"""Registered query of the periodic runs, with the contract's planted periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.llm.common import WORD, text_or_empty
from weft.llm.periodic_runs import periodic_runs
from weft.sources.tables import read_table


def planted(docs):
    """``doc_id, text``: with h = crc32 of the decimal doc_id and g = h div 10, texts of n > 0 words with
    h % 10 = 0 get, from word a = g % n on, the p = 1 + (n - a) div (3 + g % 8) words there again and again
    (a null doc_id: unchanged)."""
    def again(w):
        n, g = F.size(w), F.floor(F.col("h") / 10)
        a = g % n
        p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        a = a.cast("int")
        times = F.ceil((n - a) / p).cast("int")
        body = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), body), " ")

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(""))[0]
    return (docs.select("doc_id", text_or_empty("text").alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
            .select("doc_id", F.when(F.col("h") % 10 == 0, made).otherwise(F.col("text")).alias("text")))


def op13_periodic_runs(spark, sf_dir):
    """Runs of all documents with planted periods: the strongest run, and digests of all runs and of the rest."""
    found = periodic_runs(planted(read_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    # exact comparison of length / period; the runs come by start, then period, so the first of equals stays
    best = F.reduce("runs", F.element_at("runs", 1), lambda m, r: F.when(r["length"] * m["period"] > m["length"] * r["period"], r).otherwise(m))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
