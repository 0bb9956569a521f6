"""weft — training-data and tensor analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    table / file readers and writers (parquet tables, text, token shards, npy)
functions  Column-expression builders (hashing, element-wise math, array math, text)
operators  DataFrame -> DataFrame operators (corpus, batching, tensors, evaluation, runs, capture)
plans      the registered query catalogue with its SQL oracles
streaming  Structured Streaming versions of ingestion, batching and metric logging
"""

from weft.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
