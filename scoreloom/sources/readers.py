"""Readers for raw and clean records, rater agreement, predictions and pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.items import item_agreement, last_predictions
from . import schemas, writers


SPREAD_BYTES = 32 << 20


def scan_table(spark: SparkSession, path: str, spread_on: str | None = None) -> DataFrame:
    """A Parquet table. A small one may sit in a single row group, which one task would read
    alone: with ``spread_on`` such a table is redistributed by that key before heavy work.
    Tables with at least 32 MB per core are left as they lie."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_on is None or cores == 1:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, spread_on) if size < cores * SPREAD_BYTES else df


def scan_jsonl(
    spark: SparkSession, path: str | list[str], schema: str, quarantine: bool = False
) -> DataFrame:
    """One JSON object per line. A bad line stops the read, or with ``quarantine`` is kept
    in ``_corrupt_record``."""
    if quarantine:
        return (
            spark.read.schema(f"{schema}, _corrupt_record string")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path)
        )
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_clean_items(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Records below ``item=*/split=*`` folders, where filters on either prune files, or below ``split=*`` folders
    with the item in the records."""
    return spark.read.schema(f"{schema}, item int, split string").json(root)


def scan_items(records: DataFrame) -> DataFrame:
    """Items that have training records, ascending."""
    return records.where("split = 'train'").select("item").distinct().orderBy("item")


def listing_order() -> Column:
    """Sort key for rows in file order: file, block, then position inside the task."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())


def scan_rater_agreement(spark: SparkSession, path: str, trait: str | None = None) -> DataFrame:
    """item -> qwk_hh from CSV with a header; the last of duplicate items wins."""
    schema = schemas.TRAIT_AGREEMENT if trait else schemas.AGREEMENT
    rows = spark.read.schema(schema).csv(path, header=True).withColumn("pos", listing_order())
    return item_agreement(rows, trait)


def scan_predictions(
    spark: SparkSession, root: str, model: str, trait: str | None = None
) -> DataFrame:
    """(item, idx, pred) of a model from headerless CSV; the last of duplicates wins.

    No file for an item means no rows for it.
    """
    return last_predictions(prediction_rows(spark, root, model, trait))


def prediction_rows(spark: SparkSession, root: str, model: str, trait: str | None = None) -> DataFrame:
    """``item, idx, score, pred`` and the place ``pos`` in the files, of every item's last write."""
    columns = ["item", "idx", "score", "pred", "pos"]
    if not writers.present(spark, writers.shared(root)):
        return own_prediction_rows(spark, root, model, trait).select(columns)
    rows = shared_prediction_rows(spark, root, model, trait)
    last = rows.groupBy(F.col("item").alias("_item")).agg(F.max("write").alias("_write"))
    same = F.col("item").eqNullSafe(F.col("_item"))
    newest = rows.join(last, same & (F.col("write") == F.col("_write")), "left_semi").select(columns)
    if not writers.folders(spark, f"{root.rstrip('/')}/model=*"):
        return newest
    older = own_prediction_rows(spark, root, model, trait).join(last, same, "left_anti")
    return newest.unionByName(older.select(columns))


def own_prediction_rows(spark: SparkSession, root: str, model: str, trait: str | None = None) -> DataFrame:
    """Rows of the items that have folders of their own."""
    rows = spark.read.schema(f"{schemas.PREDICTIONS}, model string, trait string, item int").csv(root)
    return rows.where((F.col("model") == model) & (F.col("trait") == (trait or "none"))).withColumn("pos", listing_order())


def shared_prediction_rows(spark: SparkSession, root: str, model: str, trait: str | None = None) -> DataFrame:
    """Rows of all writes of items without folders."""
    rows = spark.read.schema(f"{schemas.PREDICTIONS}, item int, model string, trait string, write int").csv(writers.shared(root))
    return rows.where((F.col("model") == model) & (F.col("trait") == (trait or "none"))).withColumn("pos", listing_order())


def finished_items(spark: SparkSession, root: str, model: str, trait: str | None = None) -> DataFrame:
    """``item, rows, step`` of the items whose stored predictions agree with the manifest's last entry."""
    listed = spark.read.schema(
        "item int, rows bigint, step bigint, model string, trait string, write int").parquet(writers.manifest(root))
    listed = listed.where((F.col("model") == model) & (F.col("trait") == (trait or "none"))).groupBy("item").agg(
        F.max_by(F.struct("rows", "step"), "write").alias("last")).select("item", "last.rows", "last.step")
    stored = prediction_rows(spark, root, model, trait).groupBy("item").agg(F.count(F.lit(1)).alias("stored"))
    return listed.join(stored, "item").where("rows = stored").select("item", "rows", "step")


def scan_metrics(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """(metric, value, step) of one run or of all."""
    rows = spark.read.schema(f"{schemas.METRICS}, run string").parquet(root)
    return (rows if run is None else rows.where(F.col("run") == run)).select("metric", "value", "step")


def scan_shuffled(spark: SparkSession, root: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows of a table stored in shuffled order, with their ``position``; of positions start..stop-1 only, if
    given, from the ranges that hold them."""
    root = root.rstrip("/")
    rows = spark.read.parquet(f"{root}/rows")
    if start > 0 or stop is not None:
        wanted = F.col("last") >= start if stop is None else (F.col("last") >= start) & (F.col("first") < stop)
        held = [r["range"] for r in spark.read.parquet(f"{root}/ranges").where(wanted).collect()]
        rows = rows.where(F.col("range").isin(held) & (F.col("position") >= start))
        rows = rows if stop is None else rows.where(F.col("position") < stop)
    return rows.drop("range")
