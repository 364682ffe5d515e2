"""Mining against a plain sequential replay of the same visiting order."""

import itertools
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions.hashing import PRIME, luck_salt, pair_hash
from scoreloom.operators import pairs as pm


def records(spark, sizes, seed=5, scores=4, right=0.4, skew=None):
    rng = np.random.default_rng(seed)
    rows = []
    for item, n in enumerate(sizes):
        score = rng.choice(scores, size=n, p=skew)
        miss = rng.random(n) > right
        pred = score + miss * rng.choice([-1, 1, 2], size=n)
        for i in range(n):
            rows.append((item, "valid" if rng.random() < 0.2 else "train", int(i), int(score[i]), int(pred[i])))
    return spark.createDataFrame(rows, "item int, split string, idx bigint, score int, pred int")


def replay(df, p):
    """Visit every pair of an item one by one and keep plain counters."""
    placed = pm.place_records(df, p.seed).toPandas()
    out = set()
    for item, g in placed.groupby("item"):
        n, salt = int(g["n"].iat[0]), int(g["salt"].iat[0])
        ring = n + n % 2 - 1
        recs = [tuple(int(x) for x in r) for r in g[["slot", "later", "idx", "score", "err"]].to_numpy()]
        visits = []
        for a, b in itertools.combinations(recs, 2):
            low, high = min(a[0], b[0]), max(a[0], b[0])
            turn = 2 * low % ring if high == ring else (low + high) % ring
            visits.append((turn, pair_hash(low, high, salt), low, high, a, b))
        visits.sort(key=lambda v: v[:3])
        deg = dict.fromkeys([r[0] for r in recs], 0)
        neg = pos = 0
        for turn, _, low, high, a, b in visits:
            if deg[low] >= p.ct_max or deg[high] >= p.ct_max:
                continue
            if (a[3], b[3]) in p.blacklist or (b[3], a[3]) in p.blacklist:
                continue
            h = a[4] + b[4]
            if h == 0 and not pair_hash(low, high, luck_salt(salt)) < p.easy_prob * PRIME:
                continue
            same = a[3] == b[3]
            if same and (neg + 1) / (pos + 1) < p.np_min:
                continue
            pos, neg = pos + same, neg + (not same)
            deg[low] += 1
            deg[high] += 1
            first, second = sorted([a, b], key=lambda r: (r[1], r[2]))
            out.add((int(item), turn, first[2], second[2], h))
            if (pos + neg) / (p.ct_max * n) > p.cutoff:
                break
    return out


def mined(df, p, **sizes):
    got = pm.greedy_pairs(df, p, **sizes).select("item", "round", "idx1", "idx2", "h").collect()
    keys = [tuple(r) for r in got]
    assert len(keys) == len(set(keys))
    return set(keys)


BLOCKS = pm._blocks
PARAMS = [
    pm.MineParams(ct_max=3, np_min=2, easy_prob=0.01, blacklist=((0, 0),)),
    pm.MineParams(ct_max=1, np_min=2, easy_prob=0.3, blacklist=()),
    pm.MineParams(ct_max=2, np_min=10, easy_prob=0.5, cutoff=0.9, blacklist=((0, 1), (2, 2))),
    pm.MineParams(ct_max=2, np_min=1.5, easy_prob=1.0, cutoff=2.0),
    pm.MineParams(ct_max=2, np_min=0, easy_prob=0.0, cutoff=0.4),
]


@pytest.mark.parametrize("p", PARAMS)
def test_in_task_equals_replay(spark, p):
    df = records(spark, [1, 2, 3, 10, 47, 80])
    assert mined(df, p) == replay(df, p)


@pytest.mark.parametrize("p, group_rows, block_pairs", [
    (PARAMS[0], 11, 40), (PARAMS[1], 1000, 10 ** 6), (PARAMS[2], 1000, 90), (PARAMS[4], 1000, 30)])
def test_blocks_equal_replay(spark, p, group_rows, block_pairs):
    """In a task, over tasks (blocks of more than twice ``block_pairs``), and in several pieces."""
    df = records(spark, [9, 30, 41, 64])
    want = replay(df, p)
    assert mined(df, p, item_rows=20, group_rows=group_rows, block_pairs=block_pairs) == want


@pytest.mark.parametrize("p", [PARAMS[0], PARAMS[3]])
def test_repeated_acceptance_equals_replay(spark, p, monkeypatch):
    """Blocks of many rounds go over tasks; with few repeats some are settled in part only."""
    plan = pm._next_blocks
    monkeypatch.setattr(pm, "_next_blocks", lambda *a: plan(*a).withColumn("wide", F.lit(True)))
    df = records(spark, [50, 37], seed=11)
    want = replay(df, p)
    for repeats in (2, 20):
        monkeypatch.setattr(pm, "_blocks", partial(BLOCKS, repeats=repeats))
        assert mined(df, p, item_rows=20, group_rows=25, block_pairs=60) == want


def test_skewed_item_with_perfect_predictions_ends_in_few_blocks(spark, monkeypatch):
    """Nine of ten scores are zero and every pair is easy: one pair in five hundred passes."""
    blocks = []
    monkeypatch.setattr(pm, "_blocks", lambda *a: (blocks.append(t) or t for t in BLOCKS(*a)))
    df = records(spark, [3000], scores=4, right=1.1, skew=[0.9, 0.04, 0.03, 0.03])
    p = pm.TRAIN_PARAMS
    want = mined(df, p)
    assert len(want) > 500
    assert mined(df, p, item_rows=100, block_pairs=1000) == want
    assert len(blocks) <= 12


def test_hopeless_item_ends(spark):
    df = records(spark, [40], scores=2, skew=[0.95, 0.05])
    p = pm.MineParams(ct_max=3, np_min=2, easy_prob=0.01, blacklist=((0, 0),))
    want = replay(df, p)
    assert mined(df, p) == want
    assert mined(df, p, item_rows=10, group_rows=1000, block_pairs=30) == want


def test_every_pair_is_met_once(spark):
    for n in (2, 5, 8):
        df = records(spark, [n])
        rows = pm.candidate_pairs(df, 1, n).collect()
        assert len(rows) == n * (n - 1) // 2
        assert len({(r["idx1"], r["idx2"]) for r in rows}) == len(rows)
        assert all((r["split1"], r["idx1"]) < (r["split2"], r["idx2"]) for r in rows)


def test_invariants_and_partition_independence(spark):
    df = records(spark, [70, 33], seed=8)
    p = PARAMS[0]
    one = mined(df.coalesce(1), p)
    assert one == mined(df.repartition(8), p)
    report = pm.pair_coverage_report(df, pm.greedy_pairs(df, p)).collect()
    for r in report:
        assert r["pos"] * p.np_min <= r["neg"] + 1
        assert r["pairs"] <= int(p.cutoff * p.ct_max * r["records"]) + 1
    degrees = pm.record_degrees(df, pm.greedy_pairs(df, p))
    assert degrees.agg(F.max("degree")).head()[0] <= p.ct_max


def test_cap_easy(spark):
    df = records(spark, [90], right=0.8)
    pairs = pm.greedy_pairs(df, pm.MineParams(ct_max=3, np_min=0, easy_prob=1.0, cutoff=0.9))
    hard = pairs.where("h > 0").count()
    assert pairs.count() > hard > 5
    kept = pm.cap_easy(pairs, 4, 1)
    assert kept.count() == hard + 4
    assert pm.cap_easy(pairs, 0, 1).count() == hard
    split = pm.cap_easy(pairs, 10_000, 1, group_rows=5)
    assert split.count() == hard + min(hard, pairs.count() - hard)


@pytest.mark.parametrize("item_rows", [1000, 20])
def test_records_without_prediction_are_not_minable(spark, item_rows):
    df = records(spark, [60, 30])
    gaps = df.withColumn("pred", F.when(F.col("idx") % 3 > 0, F.col("pred")))
    p = PARAMS[0]
    want = replay(gaps.where("pred IS NOT NULL"), p)
    assert len(want) > 10
    assert mined(gaps, p, item_rows=item_rows, group_rows=1000, block_pairs=90) == want
    report = pm.pair_coverage_report(gaps, pm.greedy_pairs(gaps, p)).collect()
    assert sum(r["records"] for r in report) == 90


def test_hardest_first(spark):
    pairs = pm.greedy_pairs(records(spark, [70, 33]), PARAMS[3])
    rows = pm.rank_by_hardness(pairs, 5).collect()
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["h"] for r in rows] == sorted((r["h"] for r in rows), reverse=True)


def test_no_pairs_gives_an_empty_table(spark):
    df = records(spark, [6], scores=1)
    p = pm.MineParams(blacklist=((0, 0),))
    assert mined(df, p) == set()
    report = pm.pair_coverage_report(df, pm.greedy_pairs(df, p)).head()
    assert (report["pairs"], report["hard_share"]) == (0, None)


def test_pair_hash_same_in_both_engines(spark):
    df = spark.range(500).select((F.col("id") * 7919).alias("a"), (F.col("id") * 104729 + 3).alias("b"))
    got = df.select("a", "b", pair_hash(F.col("a"), F.col("b"), F.lit(12345)).alias("h")).toPandas()
    want = pair_hash(got["a"].to_numpy(np.int64), got["b"].to_numpy(np.int64), 12345)
    assert (got["h"].to_numpy() == want).all()


def test_pair_hash_is_even_and_draws_are_independent():
    low, high = np.triu_indices(900, 1)
    for salt in (5, 123_456_789, 2_000_000_000):
        visit = pair_hash(low, high, salt) / PRIME
        luck = pair_hash(low, high, luck_salt(salt)) / PRIME
        for x in (visit, luck):
            counts, _ = np.histogram(x, 50, (0, 1))
            assert ((counts - len(x) / 50) ** 2 / (len(x) / 50)).sum() < 100
        assert abs(np.corrcoef(visit, luck)[0, 1]) < 0.01
        assert (luck[visit < 0.1] < 0.1).mean() == pytest.approx(0.1, abs=0.01)
        mine = np.bincount(np.r_[low[luck < 0.05], high[luck < 0.05]], minlength=900)
        assert mine.std() == pytest.approx((899 * 0.05 * 0.95) ** 0.5, rel=0.2)


def test_items_over_several_batches(spark):
    """Tasks walk over the items of a partition, with no call per item, wherever the batches end."""
    df = records(spark, [1, 2, 3, 10, 47, 80, 5, 9], seed=3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert "InPandas" not in pm.greedy_pairs(df, PARAMS[0])._jdf.queryExecution().executedPlan().toString()
        assert mined(df, PARAMS[0]) == mined(df, PARAMS[0], group_rows=8) == replay(df, PARAMS[0])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_cap_easy_makes_its_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    schema = "item int, split1 string, idx1 bigint, split2 string, idx2 bigint, h int"
    rows = [(i % 3, "train", i, "valid", i + 1, int(i % 10 == 0)) for i in range(60)]
    pairs = spark.createDataFrame(rows, schema).mapInPandas(count, schema)
    assert pm.cap_easy(pairs, 1, 7).count() == 9
    assert seen.value == 60
