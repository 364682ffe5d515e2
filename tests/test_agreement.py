"""Agreement metrics against the matrix form, and edge cases of score ranges."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.operators import agreement as ag


def matrix_qwk(a, b):
    """Weighted disagreement over expected disagreement, from the full matrices."""
    a = np.rint(a).astype(int)
    low, high = a.min(), a.max()
    b = np.rint(np.clip(b, low, high)).astype(int)
    size = high - low + 1
    observed = np.zeros((size, size))
    np.add.at(observed, (a - low, b - low), 1)
    expected = np.outer(observed.sum(1), observed.sum(0)) / len(a)
    weight = (np.arange(size)[:, None] - np.arange(size)) ** 2
    bottom = (weight * expected).sum()
    return None if bottom == 0 else 1 - (weight * observed).sum() / bottom


@settings(max_examples=8, deadline=None)
@given(st.lists(
    st.lists(st.tuples(st.integers(0, 5), st.floats(-3, 9, width=32)), min_size=1, max_size=30),
    min_size=1, max_size=25,
))
def test_qwk_equals_the_matrix_form(spark, groups):
    rows = [(g, float(a), float(b)) for g, pairs in enumerate(groups) for a, b in pairs]
    df = spark.createDataFrame(rows, "item int, a double, b double")
    got = {r["item"]: r["qwk"] for r in ag.qwk(df, ["item"], "a", "b").collect()}
    for g, pairs in enumerate(groups):
        want = matrix_qwk(*map(np.array, zip(*pairs)))
        assert (got[g] is None) == (want is None)
        assert want is None or got[g] == pytest.approx(want, abs=1e-9)


def test_half_ratings_round_to_even(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 2.5), (3.0, 3.5), (0.0, 1.0)], "a double, b double")
    cells = {(r["a"], r["b"]) for r in ag.rating_cells(df, [], "a", "b").collect()}
    assert cells == {(0, 0), (2, 2), (3, 4), (0, 1)}
    assert ag.qwk(df, [], "a", "b").count() == 1


def test_weighted_scale(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (1, 2, 3.0), (1, 4, 2.2)], "item int, t int, x double")
    got = ag.qwk_weighted_scale(df, ["item"], "t", "x", 2.0).head()["qwk"]
    t = np.array([0, 1, 2, 4], np.float32) * 2
    x = np.array([1, 1, 3, 2.2], np.float32) * 2
    assert got == pytest.approx(matrix_qwk(t, x))


def test_float_kappa(spark):
    rng = np.random.default_rng(0)
    t, x = rng.integers(0, 5, 40).astype(float), rng.normal(2, 1, 40)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, x)], "item int, t double, x double")
    t32, x32 = t.astype(np.float32).astype(float), x.astype(np.float32).astype(float)
    v = (x32 * (t32 - t32.mean())).sum()
    want = v / (v + 0.5 * ((x32 - t32) ** 2).sum())
    assert ag.float_kappa(df, ["item"], "t", "x").head()["float_kappa"] == pytest.approx(want)


RECORDS = [
    (1, 0, "train", 0), (1, 1, "train", 2), (1, 2, "valid", 4),   # valid outside the training range
    (2, 0, "valid", 1), (2, 1, "valid", 3),                       # only in validation
    (3, 0, "train", 2), (3, 1, "train", 2),                       # a single score
    (4, 0, "train", 1),                                           # a single record
]


def test_score_norm_edges(spark):
    df = spark.createDataFrame(RECORDS, "item int, idx int, split string, score int")
    got = {(r["item"], r["idx"]): r["score_norm"] for r in ag.with_score_norm(df).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): 2.0, (2, 0): 0.0, (2, 1): 1.0,
                   (3, 0): None, (3, 1): None, (4, 0): None}


def test_single_rating_gives_null(spark):
    df = spark.createDataFrame([(1, 2, 2), (1, 2, 2)], "item int, a int, b int")
    assert ag.qwk(df, ["item"], "a", "b").head()["qwk"] is None


def test_hot_item_meets_only_cells(spark):
    """The rows of an item are counted before any shuffle."""
    df = spark.range(1000).select(F.lit(1).alias("item"), (F.col("id") % 3).alias("a"), (F.col("id") % 4).alias("b"))
    plan = ag.qwk(df, ["item"], "a", "b")._jdf.queryExecution().executedPlan().toString()
    first_shuffle = plan.rindex("Exchange hashpartitioning")
    assert "partial_count" in plan[first_shuffle:]
    assert ag.rating_cells(df, ["item"], "a", "b").count() == 12
