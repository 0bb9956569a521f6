"""Sampling of the next token with temperature."""
from collections import Counter

import numpy as np
import pytest

from weft.operators.random import sample_next


def test_temperature_zero_is_greedy_and_draws_follow_the_softmax(spark):
    logits = [1.0, 900.0, 901.0, 899.0]
    df = spark.createDataFrame([(i, logits) for i in range(4000)], "id long, x array<double>")
    assert {r.next_token for r in sample_next(df, "x", 0, 3, "id").collect()} == {2}
    got = Counter(r.next_token for r in sample_next(df, "x", 2.0, 3, "id").collect())
    z = np.exp((np.array(logits) - 901) / 2)
    for j, p in enumerate(z / z.sum()):
        assert abs(got[j] / 4000 - p) < 0.03
    again = sample_next(df.repartition(3), "x", 2.0, 3, "id")
    assert Counter(r.next_token for r in again.collect()) == got
    assert [r.next_token for r in sample_next(df.where("id < 9"), "x", 1e-6, 3, "id").collect()] == [2] * 9
    odd = spark.createDataFrame([(1, []), (2, None)], df.schema)
    assert sample_next(odd, "x", 1.0, 3, "id").count() == 0
    with pytest.raises(ValueError):
        sample_next(df, "x", -1, 3, "id")
