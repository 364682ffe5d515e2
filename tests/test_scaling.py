"""The paths for large groups and large tables must give what the simple paths give."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.hashing import hash32
from scoreloom.operators import sampling as sm
from scoreloom.operators.scaling import dim_join, rank_within, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """One item holds more than a third of the rows."""
    rng = random.Random(3)
    rows = []
    for idx in range(600):
        item = 1 if rng.random() < 0.5 else rng.randrange(2, 40)
        rows.append((item, idx, "valid" if rng.random() < 0.3 else "train", rng.randrange(5)))
    return spark.createDataFrame(rows, "item bigint, idx bigint, split string, score int").cache()


def as_set(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(skewed, how):
    dim = skewed.where("item % 3 <> 0").groupBy("item").agg(F.max("score").alias("top"))
    want = as_set(dim_join(skewed, dim, ["item"], how))
    assert as_set(dim_join(skewed, dim, ["item"], how, max_rows=0).select(
        *dim_join(skewed, dim, ["item"], how).columns)) == want


def test_rank_in_pieces_equals_rank(skewed):
    u = hash32(1, "item", "idx")
    want = as_set(rank_within(skewed, ["item"], u, ["idx"]))
    got = rank_within(skewed, ["item"], u, ["idx"], group_rows=17)
    assert as_set(got.select("item", "idx", "split", "score", "rank", "size")) == want


@pytest.mark.parametrize("parts", [1, 3, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, parts, descending):
    cells = skewed.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    rows = running_totals(cells, "item", ["n", "s"], descending=descending, parts=parts).collect()
    rows.sort(key=lambda r: r["item"], reverse=descending)
    n = s = 0
    for r in rows:
        n, s = n + r["n"], s + r["s"]
        assert (r["cum_n"], r["cum_s"]) == (n, s)
    assert {(r["all_n"], r["all_s"]) for r in rows} == {(n, s)}


def test_running_totals_of_an_empty_table(skewed):
    empty = skewed.where("item < 0").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    assert running_totals(empty, "item", ["n"]).count() == 0


def test_load_positions(skewed):
    order = sorted((r["item"], r["split"] != "train", r["idx"]) for r in skewed.collect())
    want = {(i, x): p for p, (i, _, x) in enumerate(order)}
    for parts in (1, 7):
        got = sm.load_positions(skewed.repartition(parts)).collect()
        assert {(r["item"], r["idx"]): r["position"] for r in got} == want


@pytest.mark.parametrize("k", [0, 1, 37, 600, 900])
def test_smallest_k(skewed, k):
    u = hash32(4, "item", "idx")
    rows = sorted((r["u"], r["item"], r["idx"]) for r in skewed.select(u.alias("u"), "item", "idx").collect())
    got = skewed.where(sm.smallest_k(skewed, u, ["item", "idx"], k))
    assert sorted((r["item"], r["idx"]) for r in got.collect()) == sorted(x[1:] for x in rows[:k])


def test_smallest_k_with_equal_hashes(skewed):
    u = (F.col("idx") % 3).cast("bigint")
    got = skewed.where(sm.smallest_k(skewed, u, ["item", "idx"], 250)).select(u.alias("u"), "item", "idx")
    rows = sorted((r["idx"] % 3, r["item"], r["idx"]) for r in skewed.collect())
    assert as_set(got) == rows[:250]


def test_samples_do_not_depend_on_partitions(skewed):
    keys = ["item", "idx"]
    for build in (
        lambda df: sm.random_subset(df, 0.2, 7, keys),
        lambda df: sm.train_test_split(df, 7, keys)[1],
        lambda df: sm.cap_rows(df, 7, keys, 40),
        lambda df: sm.split_by_item(df, 7, 0.3).select("item", "idx", "part"),
        lambda df: sm.kfold_assign(df, 5, 7).select("item", "idx", "fold"),
    ):
        assert as_set(build(skewed.coalesce(1))) == as_set(build(skewed.repartition(7)))


def test_sizes_of_samples(skewed):
    keys = ["item", "idx"]
    assert sm.random_subset(skewed, 0, 1, keys).count() == 600
    assert sm.random_subset(skewed, 0.101, 1, keys).count() == 60
    assert sm.random_subset(skewed, 5000, 1, keys).count() == 600
    train, test = sm.train_test_split(skewed.where("idx < 101"), 1, keys)
    assert (train.count(), test.count()) == (90, 11)


@pytest.mark.parametrize("k", [2, 5, 700])
def test_fold_sizes(skewed, k):
    got = sm.kfold_assign(skewed, k, 3).groupBy("item", "fold").count().collect()
    split = sm.kfold_assign(skewed, k, 3, group_rows=13).groupBy("item", "fold").count().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, split))
    by_item = {}
    for r in got:
        by_item.setdefault(r["item"], {})[r["fold"]] = r["count"]
    for folds in by_item.values():
        n = sum(folds.values())
        sizes = [folds.get(f, 0) for f in range(k)]
        assert sizes == [n // k + (f < n % k) for f in range(k)]


class FakeContext:
    def __init__(self, master, checkpoint=None):
        self.master, self.folder = master, checkpoint

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder

    def getConf(self):
        return {}


class FakeSession:
    def __init__(self, *context):
        self.sparkContext, self.conf = FakeContext(*context), self

    def get(self, key, default):
        return default


def test_a_cluster_needs_a_shared_folder():
    from scoreloom.session import shared_dir

    with pytest.raises(ValueError):
        shared_dir(FakeSession("spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(FakeSession("local-cluster[2,1,1024]"))
    assert shared_dir(FakeSession("yarn", "hdfs://x/y")) == "hdfs://x/y"
    local = FakeSession("local[4]")
    assert shared_dir(local) == local.sparkContext.folder == shared_dir(local)


def keep_partitions(spark, request):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    request.addfinalizer(lambda: spark.conf.set(key, "true"))


def test_positions_spread_in_spite_of_an_outlying_index(spark, request):
    """One index of 10**15 in an item that holds most rows: every range still has its share."""
    rows = [(1, "train", 10 ** 15)] + [(1, "train" if i % 3 else "valid", i) for i in range(20_000)] + [(0, "valid", -5), (2, "train", 1)]
    df = spark.createDataFrame(rows, "item int, split string, idx bigint")
    keep_partitions(spark, request)
    got = sm.load_positions(df).withColumn("part", F.spark_partition_id())
    want = {r: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0], r[1] != "train", r[2])))}
    found = got.collect()
    assert {(r["item"], r["split"], r["idx"]): r["position"] for r in found} == want
    sizes = {}
    for r in found:
        sizes[r["part"]] = sizes.get(r["part"], 0) + 1
    assert len(sizes) > 2 and max(sizes.values()) < 2 * len(rows) / len(sizes)


def test_written_order_is_the_seeded_order(spark, request):
    from scoreloom.session import scratch_path
    from scoreloom.sources import readers, writers

    df = spark.range(5000).select((F.col("id") % 3).alias("item"), "id", F.lit("x").alias("text"))
    root = scratch_path(spark, "order")
    keep_partitions(spark, request)
    writers.sink_shuffled(df, root, 7, ["id"])
    want = [r["id"] for r in sm.shuffled_positions(df, 7, ["id"]).orderBy("position").collect()]
    got = readers.scan_shuffled(spark, root)
    assert [r["id"] for r in got.orderBy("position").collect()] == want
    part = readers.scan_shuffled(spark, root, 1200, 1300)
    assert [r["id"] for r in part.orderBy("position").collect()] == want[1200:1300]
    files = spark.read.parquet(f"{root}/ranges").collect()
    assert len(files) > 4 and sum(r["last"] >= 1200 and r["first"] < 1300 for r in files) <= 2
    assert "PartitionFilters: [range#" in part._jdf.queryExecution().executedPlan().toString()
    assert readers.scan_shuffled(spark, root, 5000).count() == 0
