"""Embedding tables, out-of-fold evaluation, checkpoints."""

from pyspark.sql import functions as F

from ..operators import encode as en
from ..operators import evaluate as ev
from . import bindings as b
from .agreement import QWK_SQL
from .catalog import query


def embedded_sql(dim: int = 64) -> str:
    """``embedded(item, idx, score, dim, x)``: the signed word hashing of the default encoder."""
    return f"""{b.RESPONSES}, w AS (
  SELECT idx, h % {dim} AS dim, CASE WHEN h // {dim} % 2 = 0 THEN 1 ELSE -1 END AS s FROM (
    SELECT idx, {b.u32("w")} AS h FROM (
      SELECT idx, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w FROM responses))),
sums AS (SELECT idx, dim, sum(s)::DOUBLE AS v FROM w GROUP BY idx, dim),
norms AS (SELECT idx, sqrt(sum(v * v)) AS len FROM sums GROUP BY idx),
grid AS (SELECT item, idx, score, unnest(range({dim})) AS dim FROM responses),
embedded AS (
  SELECT item, g.idx, score, g.dim,
    CAST(CAST(coalesce(v, 0) / CASE WHEN coalesce(len, 0) = 0 THEN 1 ELSE len END AS FLOAT) AS DOUBLE) AS x
  FROM grid g LEFT JOIN sums s ON s.idx = g.idx AND s.dim = g.dim LEFT JOIN norms n ON n.idx = g.idx)"""


EMBEDDED = embedded_sql()


@query("embed_table", f"""WITH {EMBEDDED}
SELECT item, idx, score, CAST(dim AS INT) AS dim, round(x, 5) + 0.0 AS x FROM embedded""")
def embed_table(spark, sf):
    out = en.embed_table(b.responses(spark, sf))
    rows = out.select("item", "idx", "score", F.posexplode("embedding").alias("dim", "x"))
    return rows.withColumn("x", F.round(F.col("x").cast("double"), 5) + 0.0)


def ridge_sql(folds: str, dim: int = 64, alpha: float = 0.1) -> str:
    """Predictions ``p(item, fold, idx, score, pred)`` by solving the normal equations of each fold.

    ``folds`` is a table of item, fold, idx, score and embedding. The sums of products of the other
    folds are the item's minus the fold's; Gauss-Jordan elimination runs over them as nested lists.
    """
    n = dim + 1
    return f"""z AS (
  SELECT item, fold, idx, score, list_concat(embedding::DOUBLE[], [1.0::DOUBLE, score::DOUBLE]) AS z FROM {folds}),
axes AS (SELECT unnest(range(1, {n + 2})) AS i),
grams AS (
  SELECT item, fold, x.i, y.i AS j, sum(z[x.i] * z[y.i]) AS g
  FROM z, axes x, axes y WHERE x.i <= {n} GROUP BY ALL),
others AS (
  SELECT item, fold, i, j, sum(g) OVER (PARTITION BY item, i, j) - g
    + CASE WHEN i = j AND i <= {dim} THEN {alpha} ELSE 0 END AS g FROM grams),
lines AS (SELECT item, fold, i, list(g ORDER BY j) AS r FROM others GROUP BY item, fold, i),
mats AS (SELECT item, fold, list(r ORDER BY i) AS m FROM lines GROUP BY item, fold),
solved AS (
  SELECT item, fold, list_reduce(list_transform(range(1, {n + 1}), lambda k: {{'k': k, 'm': []::DOUBLE[][]}}),
    lambda s, x: {{'k': x.k, 'm': list_transform(s.m, lambda r, i: CASE WHEN i = x.k THEN r ELSE
      list_transform(r, lambda v, j: v - r[x.k] / s.m[x.k][x.k] * s.m[x.k][j]) END)}},
    {{'k': 0::BIGINT, 'm': m}}).m AS m
  FROM mats),
weights AS (SELECT item, fold, list_transform(m, lambda r, i: r[{n + 1}] / r[i]) AS w FROM solved),
p AS (
  SELECT item, fold, idx, score, list_dot_product(z[1:{n}], w) AS pred FROM z JOIN weights USING (item, fold))"""


VECTOR_FOLDS = f"""{b.VECTORS}, folds AS (
  SELECT *, CAST(ntile(5) OVER (PARTITION BY item ORDER BY {b.u32("'42|' || item || '|train|' || idx")}, idx) - 1 AS INT) AS fold
  FROM vectors)"""


@query("oof_predict", f"""WITH {VECTOR_FOLDS}, {ridge_sql("folds")}
SELECT item, idx, fold, score, round(pred, 4) + 0.0 AS pred FROM p""")
def oof_predict(spark, sf):
    out = ev.oof_predict(b.vectors(spark, sf))
    return out.select("item", "idx", "fold", "score", (F.round("pred", 4) + 0.0).alias("pred"))


@query("holdout_predict", f"""WITH {b.VECTORS}, folds AS (
  SELECT *, CASE WHEN idx % 4 = 0 THEN 1 ELSE 0 END AS fold FROM vectors), {ridge_sql("folds")}
SELECT item, idx, 'valid' AS split, score, round(pred, 4) + 0.0 AS pred FROM p WHERE fold = 1""")
def holdout_predict(spark, sf):
    part = F.when(F.col("idx") % 4 == 0, "valid").otherwise("train")
    out = ev.holdout_predict(b.vectors(spark, sf).withColumn("split", part))
    return out.select("item", "idx", "split", "score", (F.round("pred", 4) + 0.0).alias("pred"))


# What can be checked in SQL about the learned predictions: every record is predicted once, in
# the right fold, and sums that are merged in shards first give the same.
@query("oof_fold_summary", f"""WITH {VECTOR_FOLDS}
SELECT item, fold, count(*) AS records, count(*) AS predicted, sum(score)::BIGINT AS scores, true AS both_fits_agree
FROM folds GROUP BY item, fold""")
def oof_fold_summary(spark, sf):
    v = b.vectors(spark, sf)
    rows = ev.oof_predict(v)
    sums = ev.oof_predict(v, shards=3).select("item", "idx", F.col("pred").alias("other"))
    same = F.abs(F.col("pred") - F.col("other")) < 1e-6
    return rows.join(sums, ["item", "idx"]).groupBy("item", "fold").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~F.isnan("pred")).alias("predicted"),
        F.sum("score").alias("scores"), F.bool_and(same).alias("both_fits_agree"),
    )


@query("holdout_summary", f"""WITH {b.VECTORS}
SELECT item, count(*) AS predicted, sum(score)::BIGINT AS scores, true AS both_fits_agree
FROM vectors WHERE idx % 4 = 0 GROUP BY item""")
def holdout_summary(spark, sf):
    part = F.when(F.col("idx") % 4 == 0, "valid").otherwise("train")
    v = b.vectors(spark, sf).withColumn("split", part)
    sums = ev.holdout_predict(v, shards=3).select("item", "idx", F.col("pred").alias("other"))
    same = F.abs(F.col("pred") - F.col("other")) < 1e-6
    return ev.holdout_predict(v).join(sums, ["item", "idx"]).groupBy("item").agg(
        F.count(F.lit(1)).alias("predicted"), F.sum("score").alias("scores"),
        F.bool_and(same).alias("both_fits_agree"),
    )


@query("item_qwk", f"WITH {b.RATINGS}, {QWK_SQL} SELECT item, n, round(qwk, 4) AS qwk FROM item_qwk")
def item_qwk(spark, sf):
    return ev.item_qwk(b.ratings(spark, sf))


def generated(spark, sf):
    """Labelled documents; sources with more than four toxic ones count as done."""
    labelled = b.responses(spark, sf).where("score IS NOT NULL")
    toxic = b.table(spark, sf, "labels").where("toxic = 1")
    done = b.documents(spark, sf).join(toxic, "doc_id").groupBy(F.col("source").alias("item")).agg(
        F.count(F.lit(1)).alias("n")).where("n > 4")
    return ev.generate_predictions(labelled, done=done)


@query("generate_predictions", f"""WITH {EMBEDDED}, done AS (
  SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source HAVING count(*) > 4),
todo AS (
  SELECT item, idx, score, list(x ORDER BY dim) AS embedding FROM embedded
  WHERE score IS NOT NULL AND item NOT IN (SELECT source FROM done) GROUP BY item, idx, score),
folds AS (
  SELECT *, CAST(ntile(5) OVER (PARTITION BY item ORDER BY {b.u32("'42|' || item || '|train|' || idx")}, idx) - 1 AS INT)
    AS fold FROM todo), {ridge_sql("folds")}
SELECT item, idx, score, CAST(round_even(pred, 0) AS INT) AS pred FROM p""")
def generate_predictions(spark, sf):
    return generated(spark, sf)


@query("generated_members", f"""WITH {b.RESPONSES}, done AS (
  SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source HAVING count(*) > 4)
SELECT item, idx, score FROM responses
WHERE score IS NOT NULL AND item NOT IN (SELECT source FROM done)""")
def generated_members(spark, sf):
    """Which records get a prediction."""
    return generated(spark, sf).where("pred IS NOT NULL").select("item", "idx", "score")


CHECKPOINTS = b.CHECKPOINT_PREDS + """, r AS (
  SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM checkpoint_preds
  WINDOW w AS (PARTITION BY checkpoint, item)),
c AS (SELECT checkpoint, item, score AS a, greatest(lo, least(hi, pred)) AS b FROM r),
scores AS (
  SELECT checkpoint, item, count(*) AS n,
    round(1 - avg((a - b) * (a - b)) / nullif(var_pop(a) + var_pop(b) + pow(avg(a) - avg(b), 2), 0), 4) + 0.0 AS qwk
  FROM c GROUP BY checkpoint, item),
board AS (
  SELECT checkpoint, round(avg(qwk), 4) AS mean_qwk, count(qwk) AS items FROM scores GROUP BY checkpoint)"""


@query("score_checkpoints", f"WITH {CHECKPOINTS} SELECT checkpoint, item, n, qwk FROM scores")
def score_checkpoints(spark, sf):
    return ev.score_checkpoints(b.checkpoint_preds(spark, sf))


def scan_sql(checkpoint: int, dim: int) -> str:
    """One checkpoint from texts to agreement: embed, fit every fold, round, compare."""
    return f"""SELECT {checkpoint} AS checkpoint, * FROM (WITH {embedded_sql(dim)}, folds AS (
  SELECT *, CAST(ntile(5) OVER (PARTITION BY item ORDER BY {b.u32("'42|' || item || '|train|' || idx")}, idx) - 1 AS INT) AS fold
  FROM (SELECT item, idx, score, list(x ORDER BY dim) AS embedding FROM embedded WHERE score IS NOT NULL GROUP BY ALL)),
{ridge_sql("folds", dim)},
q AS (SELECT item, score AS a, greatest(min(score) OVER w, least(max(score) OVER w, CAST(round_even(pred, 0) AS INT))) AS b
  FROM p WINDOW w AS (PARTITION BY item))
SELECT item, count(*) AS n,
  round(1 - avg((a - b) * (a - b)) / nullif(var_pop(a) + var_pop(b) + pow(avg(a) - avg(b), 2), 0), 4) AS qwk
FROM q GROUP BY item)"""


@query("scan_checkpoints", scan_sql(50, 8) + " UNION ALL " + scan_sql(100, 16))
def scan_checkpoints(spark, sf):
    labelled = b.responses(spark, sf).where("score IS NOT NULL")
    return ev.scan_checkpoints(labelled, {50: en.HashEncoder(8), 100: en.HashEncoder(16)})


@query("checkpoint_leaderboard", f"""WITH {CHECKPOINTS}
SELECT *, CAST(rank() OVER (ORDER BY mean_qwk DESC) AS INT) AS place FROM board""")
def checkpoint_leaderboard(spark, sf):
    return ev.checkpoint_leaderboard(ev.score_checkpoints(b.checkpoint_preds(spark, sf)))


@query("leaderboard_lines", f"""WITH {CHECKPOINTS}, filled AS (
  SELECT checkpoint, item, coalesce(qwk, 0) AS qwk FROM scores),
grid AS (SELECT * FROM (SELECT DISTINCT checkpoint FROM filled), (SELECT DISTINCT item FROM filled))
SELECT checkpoint, 'checkpoint-' || checkpoint || chr(9) || printf('%.4f', avg(qwk)) || chr(9) || chr(9)
  || string_agg(coalesce(printf('%.4f', qwk), 'nan'), chr(9) ORDER BY item) AS line
FROM grid LEFT JOIN filled USING (checkpoint, item) GROUP BY checkpoint""")
def leaderboard_lines(spark, sf):
    scores = ev.score_checkpoints(b.checkpoint_preds(spark, sf)).na.fill(0.0, ["qwk"])
    return ev.leaderboard_lines(scores)


@query("next_checkpoint", f"""WITH {CHECKPOINTS}, q AS (
  SELECT checkpoint, CASE WHEN checkpoint % 150 <> 0 THEN NULL ELSE mean_qwk END AS qwk FROM board),
n AS (SELECT *, greatest(lag(qwk) OVER (ORDER BY checkpoint), lead(qwk) OVER (ORDER BY checkpoint)) AS beside FROM q)
SELECT checkpoint, beside FROM n WHERE qwk IS NULL AND beside IS NOT NULL
ORDER BY beside DESC, checkpoint LIMIT 1""")
def next_checkpoint(spark, sf):
    board = ev.checkpoint_leaderboard(ev.score_checkpoints(b.checkpoint_preds(spark, sf)))
    visited = F.when(F.col("checkpoint") % 150 == 0, F.col("mean_qwk"))
    return ev.next_checkpoint(board.select("checkpoint", visited.alias("qwk")))
