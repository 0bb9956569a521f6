"""Layer 3 of the test strategy: the same answer with 1, 4 and 17 shuffle partitions."""
from weft.plans.catalog import load_all

SF = "/root/testdata/sf0.001"


def run(spark, name, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return sorted(tuple(r) for r in load_all()[name].build(spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_partition_count_invariance(spark):
    for name in ["corpus_windows", "b02_random_sample", "d17_throughput"]:
        base = run(spark, name, 1)
        assert run(spark, name, 4) == base
        assert run(spark, name, 17) == base
