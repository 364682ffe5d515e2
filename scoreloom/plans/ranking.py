"""Ranking metrics over evaluated pairs."""

from pyspark.sql import functions as F

from ..operators import ranking as rk
from . import bindings as b
from .catalog import query

CURVE = b.PAIR_EVAL + """, curve AS (
  SELECT t.threshold, count(*) FILTER (diff = 0 AND logit >= threshold) AS tp,
    count(*) FILTER (logit >= threshold) AS above, (SELECT count(*) FROM pair_eval WHERE diff = 0) AS positives
  FROM (SELECT DISTINCT logit AS threshold FROM pair_eval) t, pair_eval GROUP BY t.threshold),
pr AS (SELECT threshold, tp / above AS p, tp / positives AS r FROM curve),
best AS (
  SELECT threshold, p, r, 2 * p * r / (p + r) AS f1 FROM pr WHERE p + r > 0
  ORDER BY round(f1, 12) DESC, threshold LIMIT 1),
steps AS (SELECT p, r - coalesce(lag(r) OVER (ORDER BY threshold DESC), 0) AS dr FROM pr),
ap AS (SELECT sum(p * dr) AS ap FROM steps),
binary_pairs AS (
  SELECT CASE WHEN diff = 0 THEN 1 ELSE 0 END AS a, CASE WHEN logit > threshold THEN 1 ELSE 0 END AS b
  FROM pair_eval, best),
kappa AS (
  SELECT 1 - avg((a - b) * (a - b)) / nullif(var_pop(a) + var_pop(b) + pow(avg(a) - avg(b), 2), 0) AS qwk
  FROM binary_pairs)"""


@query("precision_recall_curve", f"""WITH {CURVE}
SELECT threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM pr
UNION ALL SELECT NULL, 1.0, 0.0""")
def precision_recall_curve(spark, sf):
    curve = rk.precision_recall_curve(b.pair_eval(spark, sf))
    return curve.select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("average_precision", f"WITH {CURVE} SELECT round(ap, 6) AS ap FROM ap")
def average_precision(spark, sf):
    curve = rk.precision_recall_curve(b.pair_eval(spark, sf))
    return rk.average_precision(curve).select(F.round("ap", 6).alias("ap"))


@query("best_f1", f"""WITH {CURVE}
SELECT round(f1, 6) AS f1, round(p, 6) AS precision, round(r, 6) AS recall, threshold FROM best""")
def best_f1(spark, sf):
    out = rk.best_f1(rk.precision_recall_curve(b.pair_eval(spark, sf)))
    return out.select(*[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")], "threshold")


@query("binary_qwk_at_threshold", f"WITH {CURVE} SELECT round(qwk, 6) AS qwk FROM kappa")
def binary_qwk_at_threshold(spark, sf):
    df = b.pair_eval(spark, sf)
    threshold = rk.best_f1(rk.precision_recall_curve(df)).head()["threshold"]
    return rk.binary_qwk_at_threshold(df, threshold).select(F.round("qwk", 6).alias("qwk"))


@query("distance_correlation", f"WITH {b.PAIR_EVAL} SELECT round(corr(dist, diff), 6) AS corr FROM pair_eval")
def distance_correlation(spark, sf):
    return rk.distance_correlation(b.pair_eval(spark, sf)).select(F.round("corr", 6).alias("corr"))


@query("pair_eval_report", f"""WITH {CURVE}
SELECT round(ap, 4) AS "AP", round(qwk, 4) AS "QWK", round(f1, 4) AS "F1", round(p, 4) AS "Prec",
       round(r, 4) AS "Recall", (SELECT round(corr(dist, diff), 4) FROM pair_eval) AS "Corr"
FROM ap, kappa, best""")
def pair_eval_report(spark, sf):
    return rk.pair_eval_report(b.pair_eval(spark, sf))
