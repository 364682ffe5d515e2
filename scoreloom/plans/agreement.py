"""Grouping, score ranges, agreement metrics."""

from pyspark.sql import functions as F

from ..operators import agreement as ag
from . import bindings as b
from .catalog import query

# Closed form of the kappa on clipped ratings, as SQL over (item, a, b).
QWK_SQL = """ranged AS (
  SELECT *, min(score) OVER (PARTITION BY item) AS lo, max(score) OVER (PARTITION BY item) AS hi
  FROM ratings),
clipped AS (SELECT item, split, score AS a, greatest(lo, least(hi, pred)) AS b, lo, hi FROM ranged),
grid AS (
  SELECT g.item, i, j, count(c.a) FILTER (c.a = i AND c.b = j) AS o,
         count(c.a) FILTER (c.a = i) AS ha, count(c.a) FILTER (c.b = j) AS hb, count(*) AS n
  FROM (SELECT item, unnest(range(min(lo), max(hi) + 1)) AS i FROM clipped GROUP BY item) g
  JOIN (SELECT item, unnest(range(min(lo), max(hi) + 1)) AS j FROM clipped GROUP BY item) h USING (item)
  JOIN clipped c USING (item) GROUP BY ALL),
item_qwk AS (
  SELECT item, any_value(n) AS n,
    1 - sum((i - j) * (i - j) * o)::DOUBLE
      / nullif(sum((i - j) * (i - j) * (ha * hb / n::DOUBLE)), 0) AS qwk
  FROM grid GROUP BY item)"""


@query("qwk", f"WITH {b.RATINGS}, {QWK_SQL} SELECT item, n, round(qwk, 6) AS qwk FROM item_qwk")
def qwk(spark, sf):
    out = ag.qwk(b.ratings(spark, sf), ["item"], "score", "pred")
    return out.select("item", "n", F.round("qwk", 6).alias("qwk"))


@query("mean_qwk", f"""WITH {b.RATINGS}, {QWK_SQL}
SELECT item % 3 AS item_type, round(avg(round(qwk, 4)), 4) AS mean_qwk, count(*) AS items
FROM item_qwk GROUP BY 1""")
def mean_qwk(spark, sf):
    per_item = ag.qwk(b.ratings(spark, sf), ["item"], "score", "pred")
    typed = per_item.withColumn("item_type", F.col("item") % 3)
    return ag.mean_qwk(typed, ["item_type"])


@query("qwk_weighted_scale", f"""WITH {b.RATINGS},
scaled AS (SELECT item, round_even(score * 2.5, 0) AS a, pred * 2.5 AS p FROM ratings),
clipped AS (
  SELECT item, a, round_even(greatest(min(a) OVER (PARTITION BY item),
         least(max(a) OVER (PARTITION BY item), p)), 0) AS b FROM scaled),
stats AS (
  SELECT item, avg((a - b) * (a - b)) AS d, var_pop(a) AS va, var_pop(b) AS vb,
         avg(a) - avg(b) AS shift, count(*) AS n FROM clipped GROUP BY item)
SELECT item, n, round(1 - d / nullif(va + vb + shift * shift, 0), 6) AS qwk FROM stats""")
def qwk_weighted_scale(spark, sf):
    out = ag.qwk_weighted_scale(b.ratings(spark, sf), ["item"], "score", "pred", 2.5)
    return out.select("item", "n", F.round("qwk", 6).alias("qwk"))


@query("float_kappa", f"""WITH {b.RATINGS},
m AS (SELECT *, avg(score) OVER (PARTITION BY item) AS mean_t FROM ratings),
s AS (SELECT item, count(*) AS n, 0.5 * sum((pred - score) * (pred - score)) AS u,
             sum(pred * (score - mean_t)) AS v FROM m GROUP BY item)
SELECT item, n, round(v / nullif(v + u, 0), 6) AS float_kappa FROM s""")
def float_kappa(spark, sf):
    out = ag.float_kappa(b.ratings(spark, sf), ["item"], "score", "pred")
    return out.select("item", "n", F.round("float_kappa", 6).alias("float_kappa"))


@query("confusion_matrix", f"""WITH {b.RATINGS},
r AS (SELECT item, least(min(score), min(pred)) AS lo, greatest(max(score), max(pred)) AS hi
      FROM ratings GROUP BY item),
g AS (SELECT item, a, unnest(range(lo, hi + 1)) AS b
      FROM (SELECT item, lo, hi, unnest(range(lo, hi + 1)) AS a FROM r))
SELECT g.item, g.a, g.b, count(t.idx) AS n
FROM g LEFT JOIN ratings t ON t.item = g.item AND t.score = g.a AND t.pred = g.b
GROUP BY g.item, g.a, g.b""")
def confusion_matrix(spark, sf):
    return ag.confusion_matrix(b.ratings(spark, sf), ["item"], "score", "pred")


@query("rating_histogram", f"""WITH {b.RATINGS},
g AS (SELECT item, unnest(range(min(pred), max(pred) + 1)) AS rating FROM ratings GROUP BY item)
SELECT g.item, g.rating, count(t.idx) AS n
FROM g LEFT JOIN ratings t ON t.item = g.item AND t.pred = g.rating GROUP BY g.item, g.rating""")
def rating_histogram(spark, sf):
    return ag.rating_histogram(b.ratings(spark, sf), ["item"], "pred")


@query("group_by_item", f"""WITH {b.RATINGS}
SELECT item, count(*) AS records, count(*) FILTER (split = 'train') AS train_records,
       count(*) FILTER (split = 'valid') AS valid_records FROM ratings GROUP BY item""")
def group_by_item(spark, sf):
    return ag.group_by_item(b.ratings(spark, sf))


RANGE_SQL = """score_range AS (
  SELECT item, coalesce(min(score) FILTER (split = 'train'), min(score)) AS min_score,
         coalesce(max(score) FILTER (split = 'train'), max(score)) AS max_score
  FROM ratings GROUP BY item)"""


@query("item_score_range", f"WITH {b.RATINGS}, {RANGE_SQL} SELECT * FROM score_range")
def item_score_range(spark, sf):
    return ag.item_score_range(b.ratings(spark, sf))


@query("score_norm", f"""WITH {b.RATINGS}, {RANGE_SQL}
SELECT item, idx, split, score, min_score, max_score,
       round((score - min_score)::DOUBLE / nullif(max_score - min_score, 0), 6) AS score_norm
FROM ratings JOIN score_range USING (item)""")
def score_norm(spark, sf):
    return ag.with_score_norm(b.ratings(spark, sf)).select(
        "item", "idx", "split", "score", "min_score", "max_score",
        F.round("score_norm", 6).alias("score_norm"),
    )


def traits(spark, sf):
    """Ratings with three trait scores: the score, the prediction, and the score mirrored."""
    return b.ratings(spark, sf).select(
        "item", "idx", "split",
        F.struct(F.col("score").alias("score")).alias("dev"),
        F.struct(F.col("pred").alias("score")).alias("con"),
        F.struct((4 - F.col("score")).alias("score")).alias("org"),
    )


def trait_aggs(names):
    parts = []
    for t, col in names:
        for fn in ("min", "max"):
            parts.append(f"coalesce({fn}({col}) FILTER (split = 'train'), {fn}({col})) AS {t}_{fn}_score")
    return ", ".join(parts)


TRAIT_RANGE_SQL = f"""trait_range AS (
  SELECT item, {trait_aggs([("dev", "score"), ("con", "pred"), ("org", "4 - score")])}
  FROM ratings GROUP BY item)"""


@query("trait_score_range", f"WITH {b.RATINGS}, {TRAIT_RANGE_SQL} SELECT * FROM trait_range")
def trait_score_range(spark, sf):
    return ag.trait_score_range(traits(spark, sf))


@query("select_trait", f"""WITH {b.RATINGS}, {TRAIT_RANGE_SQL}
SELECT item, idx, split, pred AS score, con_min_score AS min_score, con_max_score AS max_score,
       round((pred - con_min_score)::DOUBLE / nullif(con_max_score - con_min_score, 0), 6) AS score_norm,
       'con' AS trait
FROM ratings JOIN trait_range USING (item)""")
def select_trait(spark, sf):
    from ..operators.records import select_trait as pick

    out = pick(ag.with_trait_norms(traits(spark, sf)), "con")
    return out.select("item", "idx", "split", "score", "min_score", "max_score",
                      F.round("score_norm", 6).alias("score_norm"), "trait")


@query("distance_by_diff", f"""WITH {b.PAIR_EVAL}
SELECT diff, count(*) AS n, round(avg(dist), 6) AS mean_dist, round(stddev_pop(dist), 6) AS std_dist
FROM pair_eval GROUP BY diff""")
def distance_by_diff(spark, sf):
    out = ag.distance_by_diff(b.pair_eval(spark, sf))
    return out.select("diff", "n", F.round("mean_dist", 6).alias("mean_dist"),
                      F.round("std_dist", 6).alias("std_dist"))


@query("split_counts", f"""WITH {b.RATINGS}
SELECT mode, split, count(*) AS rows FROM ratings GROUP BY ROLLUP (mode, split)""")
def split_counts(spark, sf):
    return ag.split_counts(b.ratings(spark, sf), "mode", "split")
