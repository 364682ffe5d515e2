"""Agreement between two raters: counts, quadratic weighted kappa and its relatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scaling import dim_join


def rating_cells(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rows per (group, rating a, rating b), both rounded half to even.

    Everything below works on these cells, so the rows themselves meet only a partial
    aggregation and a group of any size is reduced before the shuffle.
    """
    return (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(
            *keys,
            F.rint(F.col(a)).cast("bigint").alias("a"),
            F.rint(F.col(b)).cast("bigint").alias("b"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def clip_to_first(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Move rating b into the range rating a has in its group.

    The bounds are integers, so clipping after rounding equals rounding after clipping.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    low, high = F.min("a").over(group), F.max("a").over(group)
    return cells.select(
        *keys, "a", F.greatest(F.least(F.col("b"), high), low).alias("b"), "n",
        low.alias("low"), high.alias("high"),
    )


def qwk(df: DataFrame, keys: list[str], a: str, b: str, out: str = "qwk") -> DataFrame:
    """Quadratic weighted kappa of b against a per group; NULL where it is 0/0."""
    cells = clip_to_first(rating_cells(df, keys, a, b), keys)
    n, x, y = (F.col(c).cast("double") for c in ("n", "a", "b"))
    sums = cells.groupBy(*keys).agg(
        F.sum(n).alias("_n"),
        F.sum(n * x).alias("_a"),
        F.sum(n * y).alias("_b"),
        F.sum(n * x * x).alias("_aa"),
        F.sum(n * y * y).alias("_bb"),
        F.sum(n * (x - y) * (x - y)).alias("_d"),
    )
    expected = F.col("_n") * (F.col("_aa") + F.col("_bb")) - 2 * F.col("_a") * F.col("_b")
    value = 1 - F.col("_n") * F.col("_d") / F.nullif(expected, F.lit(0.0))
    return sums.select(*keys, F.col("_n").cast("bigint").alias("n"), value.alias(out))


def qwk_weighted_scale(
    df: DataFrame, keys: list[str], t: str, x: str, weight: float | None = None
) -> DataFrame:
    """qwk after a cast to float and an optional common factor on both ratings."""
    def scaled(c: str) -> Column:
        value = F.col(c).cast("float")
        return (value * F.lit(weight).cast("float")).cast("float") if weight else value

    pair = df.select(*keys, scaled(t).alias("_t"), scaled(x).alias("_x"))
    return qwk(pair, keys, "_t", "_x")


def float_kappa(df: DataFrame, keys: list[str], t: str, x: str) -> DataFrame:
    """Kappa for unrounded predictions, from one pass of sums."""
    tv, xv = F.col(t).cast("float").cast("double"), F.col(x).cast("float").cast("double")
    sums = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((xv - tv) * (xv - tv)).alias("_d"),
        F.sum(xv * tv).alias("_xt"),
        F.sum(xv).alias("_x"),
        F.sum(tv).alias("_t"),
    )
    v = F.col("_xt") - F.col("_x") * F.col("_t") / F.col("n")
    return sums.select(
        *keys, "n", (v / F.nullif(v + F.col("_d") / 2, F.lit(0.0))).alias("float_kappa")
    )


def confusion_matrix(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Dense counts over the square of ratings that occur on either side, per group."""
    cells = rating_cells(df, keys, a, b)
    bounds = cells.groupBy(*keys).agg(
        F.least(F.min("a"), F.min("b")).alias("_lo"),
        F.greatest(F.max("a"), F.max("b")).alias("_hi"),
    )
    scale = F.sequence("_lo", "_hi")
    grid = bounds.select(*keys, F.explode(scale).alias("a"), "_lo", "_hi").select(
        *keys, "a", F.explode(scale).alias("b")
    )
    return grid.join(cells, [*keys, "a", "b"], "left").select(
        *keys, "a", "b", F.coalesce("n", F.lit(0)).alias("n")
    )


def rating_histogram(df: DataFrame, keys: list[str], rating: str) -> DataFrame:
    """Dense counts per rating between the smallest and the largest of the group."""
    counts = df.groupBy(*keys, F.col(rating).cast("bigint").alias("rating")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = counts.groupBy(*keys).agg(
        F.sequence(F.min("rating"), F.max("rating")).alias("_r")
    ).select(*keys, F.explode("_r").alias("rating"))
    return grid.join(counts, [*keys, "rating"], "left").select(
        *keys, "rating", F.coalesce("n", F.lit(0)).alias("n")
    )


def mean_qwk(per_item: DataFrame, keys: list[str], value: str = "qwk") -> DataFrame:
    """Mean of the per-item values rounded to 4 places, itself rounded to 4 places."""
    return per_item.groupBy(*keys).agg(
        F.round(F.avg(F.round(value, 4)), 4).alias("mean_qwk"),
        F.count(F.lit(1)).alias("items"),
    )


def group_by_item(df: DataFrame) -> DataFrame:
    """Rows and rows per split of each item."""
    return df.groupBy("item").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("split") == "train").alias("train_records"),
        F.count_if(F.col("split") == "valid").alias("valid_records"),
    )


def item_score_range(df: DataFrame, scores: list[str] = ("score",)) -> DataFrame:
    """min/max per item and score column; an item seen in training takes its training range."""
    train = F.col("split") == "train"
    aggs = []
    for s in scores:
        prefix = "" if s == "score" else f"{s.split('.')[0]}_"
        value = F.col(s)
        aggs += [
            F.coalesce(F.min(F.when(train, value)), F.min(value)).alias(f"{prefix}min_score"),
            F.coalesce(F.max(F.when(train, value)), F.max(value)).alias(f"{prefix}max_score"),
        ]
    return df.groupBy("item").agg(*aggs)


def trait_score_range(df: DataFrame, traits=("dev", "con", "org")) -> DataFrame:
    """The same for each trait struct, in one pass."""
    return item_score_range(df, [f"{t}.score" for t in traits])


def normalised(score: Column, low: Column, high: Column) -> Column:
    """Position of a score in its range; NULL where the range is a single value."""
    span = (high - low).cast("double")
    return (score - low).cast("double") / F.nullif(span, F.lit(0.0))


def with_score_norm(df: DataFrame) -> DataFrame:
    """Attach min_score, max_score and score_norm."""
    joined = dim_join(df, item_score_range(df), ["item"])
    return joined.withColumn(
        "score_norm", normalised(F.col("score"), F.col("min_score"), F.col("max_score"))
    )


def with_trait_norms(df: DataFrame, traits=("dev", "con", "org")) -> DataFrame:
    """Fill the score block of every trait struct."""
    joined = dim_join(df, trait_score_range(df, traits), ["item"])
    for t in traits:
        score, low, high = F.col(f"{t}.score"), F.col(f"{t}_min_score"), F.col(f"{t}_max_score")
        joined = joined.withColumn(
            t,
            F.struct(
                score.alias("score"), low.alias("min_score"), high.alias("max_score"),
                normalised(score, low, high).alias("score_norm"),
            ),
        ).drop(f"{t}_min_score", f"{t}_max_score")
    return joined


def distance_by_diff(df: DataFrame, dist: str = "dist", diff: str = "diff") -> DataFrame:
    """Mean and population deviation of the distance for every label difference."""
    return df.groupBy(diff).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(dist).alias("mean_dist"),
        F.stddev_pop(dist).alias("std_dist"),
    )


def split_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per combination of keys, with subtotals and the grand total."""
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("rows"))


def missing_prediction_count(joined: DataFrame) -> DataFrame:
    """Per item: rows, and rows whose prediction was filled in."""
    return joined.groupBy("item").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("pred_filled").alias("missing")
    )
