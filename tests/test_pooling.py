"""Pooling of token rows against pooling of arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import vectors as vc
from scoreloom.operators import pooling as pl


@pytest.fixture(scope="module")
def states(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        n, real = 6, int(rng.integers(3, 7))
        hidden = rng.normal(size=(n, 5))
        if i % 7 == 0:
            hidden[0, 1] = np.nan
        rows.append((i % 4, i, hidden.tolist(), [0] * (n - real) + [1] * real, [1] * real + [0] * (n - real)))
    return spark.createDataFrame(rows, "layer int, idx int, hidden array<array<double>>, left array<int>, right array<int>")


def values(df):
    return {(r["layer"], r["idx"]): r["pooled"] for r in df.collect()}


@pytest.mark.parametrize("side", ["left", "right"])
@pytest.mark.parametrize("offset", [0, 1, 2])
def test_both_shapes_agree(states, side, offset):
    keys = ["layer", "idx"]
    rows = pl.token_rows(states, keys, mask=side).repartition(5)
    h, m = F.col("hidden"), F.col(side)
    pairs = [
        (pl.mean_pool_rows(rows, keys, side, offset), vc.mean_pool(h, m, side, offset)),
        (pl.mean_pool_rows(rows, keys, side, offset, nan_safe=True), vc.mean_pool(h, m, side, offset, nan_safe=True)),
        (pl.last_token_pool_rows(rows, keys, side, offset), vc.last_token_pool(h, m, side, offset)),
        (pl.multi_pool_rows(rows, keys, "lasttoken, mean", side, offset), vc.multi_pool(h, m, "lasttoken,mean", side, offset)),
    ]
    for by_row, by_array in pairs:
        got, want = values(by_row), values(states.select(*keys, by_array.alias("pooled")))
        assert got.keys() == want.keys() and len(got) == 40
        assert all(np.allclose(got[k], want[k], equal_nan=True) for k in got)


def test_a_long_record_and_one_without_real_tokens(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.lit(1).alias("idx"), F.col("id").cast("int").alias("token"), F.lit(1).alias("mask"),
        F.array(F.col("id").cast("double"), F.lit(2.0)).alias("state"))
    none = spark.createDataFrame([(2, 0, 0, [1.0, 1.0])], "idx int, token int, mask int, state array<double>")
    got = {r["idx"]: r["pooled"] for r in pl.mean_pool_rows(rows.unionByName(none), ["idx"]).collect()}
    assert got[1] == pytest.approx([(n - 1) / 2, 2.0]) and got[2] == [None, None]
    assert pl.last_token_pool_rows(rows, ["idx"], "right", 10).head()["pooled"] == [n - 11, 2.0]
    with pytest.raises(ValueError):
        pl.mean_pool_rows(rows, ["idx"], "middle", 1)
    with pytest.raises(ValueError):
        pl.multi_pool_rows(rows, ["idx"], "mean,most")
