"""Ranking metrics of scored pairs: positives are pairs with difference 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .agreement import qwk
from .scaling import running_totals


def precision_recall_curve(
    df: DataFrame, score: str = "logit", diff: str = "diff", end_point: bool = True
) -> DataFrame:
    """Precision and recall at every distinct score taken as threshold, plus the end (1, 0).

    Pairs without a score or a difference are left out.
    Scores are counted first; the running counts then go over distinct scores, cut into
    ranges, so no task sorts the whole table.
    """
    df = df.where(F.col(score).isNotNull() & F.col(diff).isNotNull())
    cells = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(diff) == 0).alias("pos"), F.count_if(F.col(diff) != 0).alias("neg")
    )
    run = running_totals(cells, "threshold", ["pos", "neg"], descending=True)
    curve = run.select(
        "threshold", "pos",
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("cum_pos") / F.nullif("all_pos", F.lit(0))).alias("recall"),
    )
    if not end_point:
        return curve
    last = df.sparkSession.createDataFrame([(None, 0, 1.0, 0.0)], curve.schema)
    return curve.unionByName(last)


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.agg(
        (F.sum(F.col("pos") * F.col("precision")) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap")
    )


def best_f1(curve: DataFrame) -> DataFrame:
    """The threshold with the highest F1 (the lowest of equals) and its precision and recall.

    Thresholds where F1 is 0/0 are left out.
    """
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / F.nullif(p + r, F.lit(0.0))
    rows = curve.where(F.col("threshold").isNotNull()).withColumn("f1", f1)
    best = F.max(F.when(F.col("f1").isNotNull(), F.struct("f1", (-F.col("threshold")).alias("t"), "precision", "recall")))
    return rows.agg(best.alias("b")).select(
        F.col("b.f1").alias("f1"), F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"), (-F.col("b.t")).alias("threshold"),
    )


def binary_qwk_at_threshold(
    df: DataFrame, threshold: float | None, score: str = "logit", diff: str = "diff"
) -> DataFrame:
    """Kappa between being positive and scoring strictly above a threshold."""
    flags = df.select(
        (F.col(diff) == 0).cast("int").alias("label"),
        (F.col(score) > F.lit(threshold)).cast("int").alias("hit"),
    )
    return qwk(flags, [], "label", "hit").select("qwk")


def distance_correlation(df: DataFrame, dist: str = "dist", diff: str = "diff") -> DataFrame:
    return df.agg(F.corr(dist, F.col(diff).cast("double")).alias("corr"))


def pair_eval_report(
    df: DataFrame, score: str = "logit", dist: str = "dist", diff: str = "diff"
) -> DataFrame:
    """AP, QWK, F1, precision, recall and correlation in one row, to 4 places.

    The pairs are computed once, as three slim columns in the shared folder.
    """
    shared_dir(df.sparkSession)
    df = df.select(score, dist, diff).checkpoint()
    curve = precision_recall_curve(df, score, diff, end_point=False).checkpoint()
    best = best_f1(curve)
    threshold = best.head()["threshold"]
    one_row = [
        average_precision(curve).select(F.col("ap").alias("AP")),
        binary_qwk_at_threshold(df, threshold, score, diff).select(F.col("qwk").alias("QWK")),
        best.select(
            F.col("f1").alias("F1"), F.col("precision").alias("Prec"), F.col("recall").alias("Recall")
        ),
        distance_correlation(df, dist, diff).select(F.col("corr").alias("Corr")),
    ]
    keyed = [t.withColumn("_k", F.lit(0)) for t in one_row]
    row = reduce(lambda a, b: a.join(F.broadcast(b), "_k"), keyed).drop("_k")
    return row.select(*[F.round(c, 4).alias(c) for c in row.columns])
