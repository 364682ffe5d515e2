"""Sources and sinks: each query writes the bound table and reads it back."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import agreement as ag
from ..session import scratch_path
from ..sources import readers, schemas, writers
from . import bindings as b
from .agreement import QWK_SQL
from .catalog import query
from .records import RAW, raw_records


@query("scan_jsonl", f"""WITH {RAW}
SELECT index, grade, 'Tar ' || code || '  ' || upper(section[1]) || section[2:] AS mode,
       ' ' || item || ' ' AS item, 'q-' || index AS sqid, CAST(score AS VARCHAR) AS sc, md5(text) AS text
FROM raw""")
def scan_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    raw_records(spark, sf).select("index", "grade", "mode", "item", "sqid", "sc", "text").write.json(path)
    return readers.scan_jsonl(spark, path, schemas.RAW["bw"]).withColumn("text", F.md5("text"))


def written_items(spark, sf):
    path = scratch_path(spark, "items")
    writers.sink_item_split_jsonl(ag.with_score_norm(b.ratings(spark, sf)), path)
    schema = "idx bigint, mode string, score int, pred int, min_score int, max_score int, score_norm double"
    return readers.scan_clean_items(spark, path, schema)


@query("sink_item_split_jsonl", f"""WITH {b.RATINGS}
SELECT CAST(item AS INT) AS item, split, idx, score, pred, min(score) FILTER (split = 'train') OVER (PARTITION BY item) AS min_score
FROM ratings""")
def sink_item_split_jsonl(spark, sf):
    return written_items(spark, sf).select("item", "split", "idx", "score", "pred", "min_score")


@query("scan_items", f"WITH {b.RATINGS} SELECT DISTINCT CAST(item AS INT) AS item FROM ratings WHERE split = 'train'")
def scan_items(spark, sf):
    return readers.scan_items(written_items(spark, sf))


@query("scan_predictions", f"""WITH {b.RATINGS}
SELECT CAST(item AS INT) AS item, idx, pred FROM ratings WHERE item % 3 = 0""")
def scan_predictions(spark, sf):
    path = scratch_path(spark, "preds")
    r = b.ratings(spark, sf)
    writers.sink_predictions(r.where("item % 3 = 0"), path, "weak", "dev")
    writers.sink_predictions(r.where("item % 3 <> 0"), path, "weak", "org")
    writers.sink_predictions(r, path, "other", "dev")
    return readers.scan_predictions(spark, path, "weak", "dev")


@query("sink_predictions", f"""WITH {b.RATINGS}
SELECT CAST(item AS INT) AS item, idx, score, CAST(round_even(pred + 0.5, 0) AS INT) AS pred FROM ratings""")
def sink_predictions(spark, sf):
    path = scratch_path(spark, "preds")
    halves = b.ratings(spark, sf).withColumn("pred", F.col("pred") + 0.5)
    writers.sink_predictions(halves, path, "weak")
    return readers.prediction_rows(spark, path, "weak").select("item", "idx", "score", "pred")


@query("sink_pair_dataset", f"""WITH {b.VECTOR_PAIRS}
SELECT CASE WHEN idx1 % 20 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n,
       sum(diff)::BIGINT AS total FROM vector_pairs GROUP BY 1""")
def sink_pair_dataset(spark, sf):
    path = scratch_path(spark, "pairs")
    part = F.when(F.col("idx1") % 20 == 0, "validation").otherwise("train")
    writers.sink_pair_dataset(b.vector_pairs(spark, sf).withColumn("split", part), path)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("diff").alias("total")
    )


@query("materialize_once", """SELECT doc_id,
  CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INT) AS words,
  'docs_small_tokenized' AS tag FROM documents""")
def materialize_once(spark, sf):
    """The second call must find the first one's table: its builder would fail."""
    root, tag = scratch_path(spark, "once"), writers.dataset_tag("someone/docs", "lab/small")
    docs = b.documents(spark, sf).select("doc_id", tx.word_count("text").alias("words"))
    writers.materialize_once(spark, tag, lambda: docs, root)
    again = writers.materialize_once(spark, tag, lambda: docs.select(F.raise_error(F.lit("built twice"))), root)
    return again.withColumn("tag", F.lit(tag))


@query("metrics_log", f"""WITH {b.RATINGS}, {QWK_SQL}
SELECT 'QWK_' || item AS metric, round(qwk, 4) AS value, CAST(s AS BIGINT) AS step
FROM item_qwk, (SELECT unnest([20, 40]) AS s)""")
def metrics_log(spark, sf):
    path = scratch_path(spark, "metrics")
    per_item = ag.qwk(b.ratings(spark, sf), ["item"], "score", "pred")
    for step in (20, 40, 20):   # a step that is logged again does not double
        writers.metrics_log(per_item.select(
            F.concat(F.lit("QWK_"), F.col("item").cast("string")).alias("metric"),
            F.round("qwk", 4).alias("value"), F.lit(step).alias("step"),
        ), path)
    return readers.scan_metrics(spark, path)


@query("finished_items", f"""WITH {b.RATINGS}
SELECT CAST(item AS INT) AS item, count(*) AS rows, CAST(7 AS BIGINT) AS step FROM ratings WHERE item % 3 <> 1 GROUP BY item""")
def finished_items(spark, sf):
    """Items written twice count once; those whose rows changed behind the manifest do not count."""
    path = scratch_path(spark, "preds")
    r = b.ratings(spark, sf)
    for _ in range(2):
        writers.sink_predictions(r, path, "weak", step=7)
    more = r.where("item % 3 = 1")
    writers.store_predictions(more.unionByName(more), path, "weak")   # a run that ended before its manifest
    return readers.finished_items(spark, path, "weak")
