import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import metric_search as ms

SMALL = dict(roots=5, seeds=20, tree_bytes=2000, page=8, query_bytes=3000)


def brute(rows, every=50, k=5, scale=256):
    good = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (q, x) in enumerate(good):
        if q is None or q % every:
            continue
        found = [(-sum(a * b for a, b in zip(x, y)), math.inf if i is None else i) for m, (i, y) in enumerate(good) if m != n]
        out += [(q, rank, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("row", "ID", "x", "cell", "tree", "score"):
        df = df.withColumn(name, F.lit("7"))
    return sorted((tuple(r) for r in ms.top_k(df, **sizes).collect()), key=repr)


def clustered(n, width, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(12, width))
    return heads[rng.integers(12, size=n)] + spread * rng.normal(size=(n, width))


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_brute_force(spark, spread):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(900, 6, 1, spread))]
    assert run(spark, rows, **SMALL) == brute(rows)


def test_nulls_ties_copies_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (50, [1.0, nan]), (100, [inf, 0.0]), (150, [None, 1.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0]),
            (200, []), (250, [0.5, 0.5, 0.5]), (300, [0.5]), (350, [0.0, 0.0])]
    rows += [(i, [0.25, 0.25]) for i in range(400, 460)]      # ties
    rows += [(500, [0.75, -0.5])] * 4                         # rows that share an id
    rows += [(-50, [-1.0, 2.0]), (1, [0.001, -0.001])]
    assert run(spark, rows, **SMALL) == brute(rows)
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, None)]) == []
    assert run(spark, [(0, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (50, [-1.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(120, 3)) * 3e5).round(2))]
    assert run(spark, rows, **SMALL) == brute(rows)


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = [(i, [0.5, 0.5, 0.5] if i % 3 == 0 else v.tolist()) for i, v in enumerate(clustered(600, 3, 4))]
    assert run(spark, rows, **SMALL) == brute(rows)
    df = spark.createDataFrame(rows, "id long, x array<double>").select(
        F.monotonically_increasing_id().alias("row"), "id", F.transform("x", lambda c: F.floor(c * 256)).alias("x"))
    space = ms.Space(3, 10 ** 6)
    sizes = [len(r["ids"]) for r in ms.build(df, space, 5, 3000, 8).collect()]
    assert sum(sizes) == 600 and max(sizes) < 200    # 93 rows a tree are asked for


def test_pages_cover_their_rows_and_search_leaves_most_out(spark):
    x = np.floor(256 * clustered(4000, 8, 5, 0.02)).astype(np.int64)
    space = ms.Space(8, int((x * x).sum(axis=1).max()))
    made = ms._tree(np.arange(4000), list(range(4000)), x, space, 64)
    tree = ms.Tree(made, space)
    points = space.lift(tree.x)
    assert sorted(tree.rows) == list(range(4000))
    for p, (a, b) in enumerate(zip(tree.starts, tree.starts[1:])):
        far = ms.gaps(tree.heads[p][None], points[a:b])[0]
        assert b - a <= 64 and far.max() <= tree.radius[p] + space.slack
        assert np.allclose(far, tree.own[a:b], atol=space.slack)
    least = np.full(40, np.iinfo(np.int64).min)
    best = ms.Best(np.arange(40), x[:40], least, 5, space)
    work = tree.search(best)
    scores = x[:40] @ x.T
    scores[np.arange(40), np.arange(40)] = -10 ** 12
    want = [sorted(range(4000), key=lambda j: (-scores[i, j], j))[:5] for i in range(40)]
    assert best.row.tolist() == want
    assert work < 0.5 * 40 * 4000
