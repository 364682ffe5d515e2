"""Filters and joins."""

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import agreement as ag
from ..operators import items as it
from . import bindings as b
from .agreement import QWK_SQL
from .catalog import query


def agreement_rows(spark, sf):
    """A rater table from the ratings: kappa per item, listed twice with the second value last."""
    q = ag.qwk(b.ratings(spark, sf), ["item"], "score", "pred", "qwk_hh")
    value = F.round("qwk_hh", 4)
    twice = q.select("item", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), value.alias("v"))
    return twice.where("item % 7 <> 0").select(
        "item", "pos", F.when(F.col("pos") == 1, F.lit(0.0)).otherwise(F.col("v") + 0.3).alias("qwk_hh")
    )


HH_SQL = b.RATINGS + ", " + QWK_SQL + """, hh AS (
  SELECT item, round(qwk, 4) + 0.3 AS qwk_hh FROM item_qwk WHERE item % 7 <> 0)"""


def item_rows(df):
    return df.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("filter_item_expr", f"""WITH {b.RATINGS}
SELECT item, count(*) AS n FROM ratings
WHERE item % 2 <> 0 AND NOT (item > 40 AND item < 60) OR item // 10 = 3 GROUP BY item""")
def filter_item_expr(spark, sf):
    rule = "n%2!=0 and not 40 < n < 60 or n//10 == 3"
    return item_rows(it.filter_item_expr(b.ratings(spark, sf), rule))


@query("filter_item_list", f"""WITH {b.RATINGS}
SELECT item, count(*) AS n FROM ratings
WHERE item IN (3, 5, 8, 13, 21) OR item IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
GROUP BY item""")
def filter_item_list(spark, sf):
    r = b.ratings(spark, sf)
    listed = b.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("item"))
    few = it.filter_item_list(r, [3, 5, 8, 13, 21])
    rest = it.filter_item_list(r.where(~F.col("item").isin(3, 5, 8, 13, 21)), listed)
    return item_rows(few.unionByName(rest))


@query("scan_rater_agreement", f"WITH {HH_SQL} SELECT CAST(item AS INT) AS item, round(qwk_hh, 4) AS qwk_hh FROM hh")
def scan_rater_agreement(spark, sf):
    from ..session import scratch_path
    from ..sources.readers import scan_rater_agreement as scan

    rows = agreement_rows(spark, sf).withColumn("trait", F.lit("dev"))
    other = rows.withColumn("trait", F.lit("org")).withColumn("qwk_hh", F.lit(-1.0))
    path = scratch_path(spark, "hh")
    (rows.unionByName(other).orderBy("pos", "item").coalesce(1).select("item", "trait", "qwk_hh")
     .write.csv(path, header=True))
    return scan(spark, path, "dev").select("item", F.round("qwk_hh", 4).alias("qwk_hh"))


@query("join_rater_agreement", f"""WITH {HH_SQL}
SELECT item, count(*) AS n, round(max(qwk_hh), 4) AS qwk_hh FROM ratings JOIN hh USING (item) GROUP BY item""")
def join_rater_agreement(spark, sf):
    joined = it.join_rater_agreement(
        b.ratings(spark, sf), it.item_agreement(agreement_rows(spark, sf))
    )
    return joined.groupBy("item").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("qwk_hh"), 4).alias("qwk_hh")
    )


@query("filter_rater_agreement", f"""WITH {HH_SQL}
SELECT item, count(*) AS n FROM ratings WHERE item IN (SELECT item FROM hh WHERE qwk_hh >= 1.15005)
GROUP BY item""")
def filter_rater_agreement(spark, sf):
    dim = it.item_agreement(agreement_rows(spark, sf))
    return item_rows(it.filter_rater_agreement(b.ratings(spark, sf), dim, 1.15005))


@query("restrict_dimension", f"""WITH {HH_SQL}
SELECT item, round(qwk_hh, 4) AS qwk_hh FROM hh
WHERE item IN (SELECT item FROM ratings WHERE score = 4 AND pred = 3)""")
def restrict_dimension(spark, sf):
    dim = it.item_agreement(agreement_rows(spark, sf))
    left = b.ratings(spark, sf).where("score = 4 AND pred = 3")
    return it.restrict_dimension(dim, left).select("item", F.round("qwk_hh", 4).alias("qwk_hh"))


@query("filter_max_words", """SELECT doc_id FROM documents
WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 200""")
def filter_max_words(spark, sf):
    return it.filter_max_words(b.documents(spark, sf), 200).select("doc_id")


@query("filter_max_tokens", """SELECT doc_id FROM documents
WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) <= 300
  AND len(string_split(text, chr(10))) <= 12""")
def filter_max_tokens(spark, sf):
    docs = b.documents(spark, sf).select(
        "doc_id", words("text").alias("input_ids_1"), F.split("text", "\n").alias("input_ids_2")
    )
    short = it.filter_max_tokens(docs, 300, ["input_ids_1"])
    return it.filter_max_tokens(short, 12, ["input_ids_2"]).select("doc_id")


@query("limit_items", f"""WITH {b.RATINGS}
SELECT item, count(*) AS n FROM ratings
WHERE item IN (SELECT DISTINCT item FROM ratings ORDER BY item LIMIT 10) GROUP BY item""")
def limit_items(spark, sf):
    return item_rows(it.limit_items(b.ratings(spark, sf), debug=True))


@query("skip_existing", f"""WITH {b.RATINGS}
SELECT item, count(*) AS n FROM ratings
WHERE item NOT IN (SELECT item FROM ratings WHERE pred < 0 AND mode = 'error') GROUP BY item""")
def skip_existing(spark, sf):
    r = b.ratings(spark, sf)
    return item_rows(it.skip_existing(r, r.where("pred < 0 AND mode = 'error'")))


@query("filter_checkpoints", f"""WITH {b.CHECKPOINT_PREDS}
SELECT checkpoint, count(*) AS n FROM checkpoint_preds
WHERE checkpoint BETWEEN 150 AND 500 AND checkpoint IN (100, 150, 200, 450, 550) GROUP BY checkpoint""")
def filter_checkpoints(spark, sf):
    named = b.checkpoint_preds(spark, sf).withColumn(
        "path", F.concat(F.lit("out/checkpoint-"), F.col("checkpoint").cast("string"))
    ).drop("checkpoint")
    kept = it.filter_checkpoints(named, "path", 150, 500, [100, 150, 200, 450, 550])
    return kept.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n"))


def some_predictions(spark, sf):
    """Predictions of some records of some items; a few records are listed twice."""
    r = b.ratings(spark, sf).where("item % 4 <> 0 AND idx % 6 <> 0")
    once = r.select("item", "idx", F.lit(1).alias("pos"), "pred")
    again = r.where("idx % 5 = 0").select("item", "idx", F.lit(2).alias("pos"), (F.col("pred") + 1).alias("pred"))
    return once.unionByName(again)


PREDICTED = b.RATINGS + """, given AS (
  SELECT item, idx, CASE WHEN idx % 5 = 0 THEN pred + 1 ELSE pred END AS p
  FROM ratings WHERE item % 4 <> 0 AND idx % 6 <> 0),
predicted AS (
  SELECT r.item, r.idx, r.score,
    CASE WHEN r.item IN (SELECT item FROM given) THEN coalesce(g.p, r.score) END AS pred,
    r.item IN (SELECT item FROM given) AND g.p IS NULL AS pred_filled
  FROM ratings r LEFT JOIN given g ON r.item = g.item AND r.idx = g.idx)"""


def predicted(spark, sf):
    preds = it.last_predictions(some_predictions(spark, sf))
    return it.join_predictions(b.ratings(spark, sf).drop("pred"), preds)


@query("join_predictions", f"WITH {PREDICTED} SELECT item, idx, score, pred, pred_filled FROM predicted")
def join_predictions(spark, sf):
    return predicted(spark, sf).select("item", "idx", "score", "pred", "pred_filled")


@query("missing_prediction_count", f"""WITH {PREDICTED}
SELECT item, count(*) AS records, count(*) FILTER (pred_filled) AS missing FROM predicted GROUP BY item""")
def missing_prediction_count(spark, sf):
    return ag.missing_prediction_count(predicted(spark, sf))


@query("select_split_members", f"""WITH {b.RATINGS}
SELECT item, idx, split FROM ratings
WHERE (item, split, idx) IN (SELECT item, 'valid', idx FROM ratings WHERE score <> pred)""")
def select_split_members(spark, sf):
    r = b.ratings(spark, sf)
    members = r.where("score <> pred").select("item", F.lit("valid").alias("split"), "idx")
    return it.select_split_members(r, members).select("item", "idx", "split")


@query("reconcile_counts", f"""WITH {b.RATINGS}
SELECT item, count(*) AS left_rows, count(*) FILTER (mode <> 'error' OR item % 3 = 0) AS right_rows
FROM ratings GROUP BY item HAVING left_rows <> right_rows""")
def reconcile_counts(spark, sf):
    r = b.ratings(spark, sf)
    return it.reconcile_counts(r, r.where("mode <> 'error' OR item % 3 = 0"))


@query("restore_order", f"WITH {b.RATINGS} SELECT item, idx, idx AS ord, row_number() OVER (ORDER BY item, idx) AS place FROM ratings")
def restore_order(spark, sf):
    shuffled = b.ratings(spark, sf).select("item", "idx", F.col("idx").alias("ord")).repartition("idx")
    return it.restore_order(shuffled)
