"""Cleaning of raw records, filters, and the stored formats."""

import json

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import items as it
from scoreloom.operators import records as rc
from scoreloom.session import scratch_path
from scoreloom.sources import readers, schemas, writers


def raw(spark, kind, **change):
    base = {"index": 7, "grade": 11, "mode": "Tar 1a Elaboration", "item": "4711", "sqid": "s-1",
            "sc": "0", "con": "0", "dev": "1", "org": "1", "text": "an answer"}
    row = {**base, **change}
    names = [f.split()[0] for f in schemas.RAW[kind].split(", ")]
    return spark.createDataFrame([tuple(row[n] for n in names)], schemas.RAW[kind])


def test_clean_bw(spark):
    row = rc.clean_bw(raw(spark, "bw")).head()
    assert (row["mode"], row["section"], row["item"], row["score"]) == ("narrative", "elaboration", 4711, 0)
    assert "sqid" not in row and "sc" not in row


def test_clean_math_and_fw(spark):
    assert rc.clean_math(raw(spark, "math", mode="Math 3-5")).head()["mode"] == "math 3-5"
    row = rc.clean_fw(raw(spark, "fw", mode="Narrative")).head()
    assert (row["mode"], row["dev"]["score"], row["con"]["score"]) == ("narrative", 1, 0)


@pytest.mark.parametrize("change", [{"mode": "Tar 9z Opening"}, {"mode": "Tar 1a"}, {"sc": "two"}, {"item": "x1"}])
def test_bad_records_raise(spark, change):
    with pytest.raises(Exception):
        rc.clean_bw(raw(spark, "bw", **change)).collect()


def test_lenient_mode_and_padded_numbers(spark):
    row = rc.clean_bw(raw(spark, "bw", mode="Tar 9z X", item=" 5 "), strict=False).head()
    assert (row["mode"], row["section"], row["item"]) == (None, None, 5)


def test_clean_items_training_range_wins(spark):
    train = raw(spark, "bw", sc="0").unionByName(raw(spark, "bw", sc="2"))
    valid = raw(spark, "bw", sc="3").unionByName(raw(spark, "bw", item="9", sc="1"))
    got = rc.clean_items("bw", train, valid).collect()
    by_key = {(r["item"], r["split"], r["score"]): r["score_norm"] for r in got}
    assert by_key == {(4711, "train", 0): 0.0, (4711, "train", 2): 1.0,
                      (4711, "valid", 3): 1.5, (9, "valid", 1): None}
    assert {r["item_type"] for r in got} == {"bw"}


def test_select_trait(spark):
    rows = raw(spark, "fw", dev="1").unionByName(raw(spark, "fw", dev="4"))
    both = rc.clean_items("fw", rows, rows.limit(0))
    got = sorted((r["score"], r["score_norm"], r["trait"]) for r in rc.select_trait(both, "dev").collect())
    assert got == [(1, 0.0, "dev"), (4, 1.0, "dev")]
    with pytest.raises(ValueError):
        rc.select_trait(both, "style")


def test_truncate_longest(spark):
    rows = [(0, 0, "b" * 100), (0, 1, "abc def ghi " * 10), (0, 2, "short"), (0, 3, "xy" * 20),
            (1, 4, "only one here")]
    df = spark.createDataFrame(rows, "batch int, idx int, text string")
    got = {r["idx"]: r["text"] for r in rc.truncate_longest_to_median(df).collect()}
    assert got[0] == "bb"
    assert got[1] == ("abc def ghi " * 10)[:40]
    assert (got[2], got[3], got[4]) == ("short", "xy" * 20, "only one here")


def test_rater_agreement(spark):
    hh = spark.createDataFrame([(1, 0.9), (2, 0.5)], "item int, qwk_hh double")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item int, x string")
    assert [r["item"] for r in it.filter_rater_agreement(df, hh, 0.7).collect()] == [1]
    with pytest.raises(KeyError):
        it.filter_rater_agreement(df, hh, 0.7, strict=True)


def test_join_predictions_rules(spark):
    df = spark.createDataFrame([(1, 0, "train", 2), (1, 1, "train", 3), (1, 1, "valid", 0), (2, 0, "train", 1)],
                               "item int, idx bigint, split string, score int")
    preds = spark.createDataFrame([(1, 1, 0, 4), (1, 1, 1, 5)], "item int, idx bigint, pos int, pred int")
    got = it.join_predictions(df, it.last_predictions(preds)).collect()
    by_key = {(r["item"], r["idx"], r["split"]): (r["pred"], r["pred_filled"]) for r in got}
    assert by_key == {(1, 0, "train"): (2, True), (1, 1, "train"): (5, False),
                      (1, 1, "valid"): (5, False), (2, 0, "train"): (None, False)}


def test_limit_items_and_order(spark):
    df = spark.range(50).select((F.col("id") % 20).alias("item"), F.col("id").alias("ord"))
    assert it.limit_items(df, True).select("item").distinct().count() == 10
    assert it.limit_items(df, 3).select("item").distinct().count() == 3
    assert it.limit_items(df).count() == 50
    rows = [(r["item"], r["ord"]) for r in it.restore_order(df.repartition(5)).collect()]
    assert rows == sorted(rows)


def test_checkpoint_names(spark):
    df = spark.createDataFrame([("a/checkpoint-50",), ("a/checkpoint-1200/",), ("a/final",)], "path string")
    assert sorted(r["checkpoint"] for r in it.filter_checkpoints(df).collect()) == [50, 1200]
    assert [r["checkpoint"] for r in it.filter_checkpoints(df, low=60).collect()] == [1200]


def write_lines(spark, lines, name):
    path = scratch_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_bad_json_line(spark):
    good = {"index": 1, "grade": 3, "mode": "m", "item": "5", "sqid": "q", "sc": "1", "text": "é\n"}
    path = write_lines(spark, [json.dumps(good), "{broken"], "bad")
    with pytest.raises(Exception):
        readers.scan_jsonl(spark, path, schemas.RAW["bw"]).collect()
    rows = readers.scan_jsonl(spark, path, schemas.RAW["bw"], quarantine=True).cache()
    assert rows.where("_corrupt_record IS NULL").head()["text"] == "é\n"
    assert rows.where("_corrupt_record IS NOT NULL").count() == 1


def test_last_listed_value_wins(spark):
    path = write_lines(spark, ["item,qwk_hh", "1,0.2", "2,0.4", "1,0.8"], "hh")
    got = readers.scan_rater_agreement(spark, path).collect()
    assert {r["item"]: r["qwk_hh"] for r in got} == {1: 0.8, 2: 0.4}


def test_predictions_round_half_to_even_and_sort(spark):
    df = spark.createDataFrame([(1, i, 2, p) for i, p in enumerate([0.5, 1.5, 2.5, -0.5, 1.2])],
                               "item int, idx bigint, score int, pred double")
    root = scratch_path(spark, "preds")
    writers.sink_predictions(df.orderBy(F.desc("idx")), root, "m")
    lines = [r["value"] for r in spark.read.text(f"{root}/model=m/trait=none/item=1").collect()]
    assert lines == ["0,2,0", "1,2,2", "2,2,2", "3,2,0", "4,2,1"]
    got = readers.scan_predictions(spark, root, "m").collect()
    assert {r["idx"]: r["pred"] for r in got} == {0: 0, 1: 2, 2: 2, 3: 0, 4: 1}


def test_item_folders_prune(spark):
    df = spark.range(60).select((F.col("id") % 6).cast("int").alias("item"), F.col("id").alias("idx"),
                                F.when(F.col("id") % 4 == 0, "valid").otherwise("train").alias("split"))
    root = scratch_path(spark, "items")
    writers.sink_item_split_jsonl(df, root)
    back = readers.scan_clean_items(spark, root, "idx bigint")
    one = back.where("item = 3 AND split = 'train'")
    assert all("item=3/split=train" in f for f in one.select("_metadata.file_path").distinct().toPandas()["file_path"])
    assert "PartitionFilters: [isnotnull(item" in one._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 60


def test_names_and_single_build(spark):
    assert writers.dataset_tag("owner/pairs_932", "lab/small-1b") == "pairs_932_small-1b_tokenized"
    root = scratch_path(spark, "once")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.materialize_once(spark, "t", build, root).count() == 3
    assert len(calls) == 1


def test_many_items_share_folders(spark, monkeypatch):
    """Above the bound the item stands in the records: no folder an item, the same rows."""
    monkeypatch.setattr(writers, "FOLDERS", 10)
    df = spark.range(80).select((F.col("id") % 40).alias("item"), F.col("id").alias("idx"),
                                F.when(F.col("id") % 4 == 0, "valid").otherwise("train").alias("split"))
    root = scratch_path(spark, "items")
    writers.sink_item_split_jsonl(df, root)
    writers.sink_item_split_jsonl(df.where("item < 2"), root, "append")   # few items follow the layout that is there
    back = readers.scan_clean_items(spark, root, "idx bigint")
    assert back.select("_metadata.file_path").distinct().count() < 40
    rows = [tuple(r) for r in back.select("item", "idx", "split").collect()]
    want = [tuple(r) for r in df.collect()]
    assert sorted(rows) == sorted(want + [r for r in want if r[0] < 2])
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        writers.sink_item_split_jsonl(df, root)


def test_predictions_of_many_items_are_replaced(spark, monkeypatch):
    """Folders first, shared writes above the bound: the last write of an item counts in either."""
    monkeypatch.setattr(writers, "FOLDERS", 10)
    root = scratch_path(spark, "preds")

    def rows(items, n, pred):
        return spark.range(n).selectExpr("id AS idx", "1 AS score", f"{pred} AS pred", f"explode(array{items}) AS item")

    def stored():
        got = readers.scan_predictions(spark, root, "m").groupBy("item").agg(F.count("idx").alias("n"), F.max("pred").alias("p")).collect()
        return {r["item"]: (r["n"], r["p"]) for r in got}

    def finished():
        return {r["item"]: r["step"] for r in readers.finished_items(spark, root, "m").collect()}

    writers.sink_predictions(rows((1, 2), 3, 1), root, "m", step=1)
    assert stored() == {1: (3, 1), 2: (3, 1)} and not writers.present(spark, writers.shared(root))
    writers.sink_predictions(rows(tuple(range(2, 30)), 2, 2), root, "m", step=2)
    writers.sink_predictions(rows((2, 3), 5, 0), root, "other")
    assert len(writers.folders(spark, f"{root}/model=*/trait=*/item=*")) == 2
    want = {1: (3, 1)} | {i: (2, 2) for i in range(2, 30)}
    assert stored() == want and finished() == {i: 1 if i == 1 else 2 for i in range(1, 30)}
    writers.sink_predictions(rows((1, 4), 1, 3), root, "m", step=3)
    writers.store_predictions(rows((5, 6), 4, 4), root, "m")      # ended before its manifest
    assert stored() == want | {1: (1, 3), 4: (1, 3), 5: (4, 4), 6: (4, 4)}
    assert finished() == {i: 3 if i in (1, 4) else 2 for i in range(1, 30) if i not in (5, 6)}
