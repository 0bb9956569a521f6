"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs to completion through the ``noop`` sink (the whole plan
executes, nothing is collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weft.plans.catalog import load_all  # noqa: E402
from weft.session import get_spark  # noqa: E402

HEADLINE = [
    "corpus_windows",          # text -> pieces -> char ids -> stream -> shards -> windows
    "a31_shard_tokens",        # ordered train/val split and shard assembly
    "a22_tokens_to_ids",       # word counts, frequency vocab, id lookup
    "a17_pair_counts",         # one BPE statistics round
    "b19_exclude_heldout",     # hold-out anti join
    "b02_random_sample",       # permutation sampler (global order)
    "c69_matmul",              # long-form matmul
    "c74_softmax",             # row-wise softmax / log-softmax
    "c68_topk",                # per-row top-k
    "d01_cross_entropy",       # loss + perplexity
    "d36_adam",                # two optimiser steps (params x grads x state)
    "d17_throughput",          # skew-safe lag over the metric log
    "d24_nearest_step",        # as-of join without per-key windows
    "e04_next_sibling",        # selector with sibling scan
    "e18_op_chain",            # automaton over the op log
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    reg = load_all()
    times = {}
    for n in names:
        t0 = time.time()
        reg[n].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
