"""Task generators: index-addressable, rule-conformant."""
from pyspark.sql import functions as F

from weft.operators import tasks as TK


def test_generators_are_pure_functions_of_index(spark):
    a = spark.range(0, 200).repartition(7).select("id", TK.addition(F.col("id"), 5)[0].alias("p"))
    b = spark.range(0, 200).repartition(2).select("id", TK.addition(F.col("id"), 5)[0].alias("p"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rules(spark):
    df = spark.range(300).select("id", *[TK.TASKS[n](F.col("id"), 3)[k].alias(f"{n}_{k}")
                                         for n in ("addition", "sort", "parity", "dyck", "temporal_order") for k in (0, 1)])
    for r in df.collect():
        a, _, b, _ = r.addition_0
        assert a + b == r.addition_1[0] and 0 <= a + b <= 20
        assert r.sort_1 == sorted(r.sort_0)
        assert r.parity_1[0] == sum(r.parity_0) % 2
        depth = 0
        for t in r.dyck_1:
            depth += 1 if t % 2 == 0 else -1
            assert depth >= 0
        assert depth == 0 and len(r.dyck_1) == 10
        p = r.temporal_order_0
        assert p.count(10) == 1 and p.count(11) == 1
        assert r.temporal_order_1 == ([10, 11] if p.index(10) < p.index(11) else [11, 10])


def test_two_sum_unique_solution(spark):
    for length, top in ((4, 15), (6, 40), (2, 9)):
        df = spark.range(300).select("id", *[c.alias(n) for c, n in zip(TK.two_sum(F.col("id"), 9, length, top), ("prompt", "target"))])
        for r in df.collect():
            nums, t = r.prompt[:-1], r.prompt[-1]
            pairs = [(x, y) for x in range(length) for y in range(x + 1, length) if nums[x] + nums[y] == t]
            assert len(nums) == length and len(pairs) == 1 and sum(r.target) == t and all(0 <= v <= top // 2 for v in nums)
            assert sorted(r.target) == sorted(nums[p] for p in pairs[0])


def test_elman_metrics(spark):
    words = [["man", "eat", "pie"], ["rock", "move", "PAD"], ["man", "sleep", "pie"], ["dragon"], []]
    df = spark.createDataFrame([(w,) for w in words], "w array<string>")
    m = [r.m for r in df.select(TK.elman_metrics(F.col("w")).alias("m")).collect()]
    assert [x.best_prefix for x in m] == [3, 3, 2, 1, 0]
    assert m[2].matches == [True, True, False] and m[3].length_correct is False
