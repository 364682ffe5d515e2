"""Item and record filters, and joins with per-item and per-record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.itemexpr import item_filter
from ..functions.text import word_count
from .scaling import dim_join, running_totals

# Least agreement between raters an item needs, by item type.
HH_MIN = {"math": 0.7, "bw": 0.58, "fw": 0.75}


def filter_item_expr(df: DataFrame, expression: str, item: str = "item") -> DataFrame:
    """Keep items for which a Python expression in ``n`` holds."""
    return df.where(item_filter(expression, F.col(item)))


def filter_item_list(df: DataFrame, items) -> DataFrame:
    """Keep the listed items; the list may be Python values or a table."""
    if isinstance(items, DataFrame):
        return dim_join(df, items.select("item").distinct(), ["item"], "left_semi")
    return df.where(F.col("item").isin(list(items)))


def item_agreement(
    df: DataFrame, trait: str | None = None, position: str = "pos"
) -> DataFrame:
    """item -> qwk_hh, one row per item; the last listed value wins."""
    rows = df.where(F.col("trait") == trait) if trait else df
    return rows.groupBy("item").agg(F.max_by("qwk_hh", position).alias("qwk_hh"))


def join_rater_agreement(df: DataFrame, agreement: DataFrame) -> DataFrame:
    return dim_join(df, agreement, ["item"], "inner")


def filter_rater_agreement(
    df: DataFrame, agreement: DataFrame, hh_min: float, strict: bool = False
) -> DataFrame:
    """Keep items whose raters agree at least ``hh_min``.

    Items without a value are dropped, or refused when strict.
    """
    if strict:
        unknown = dim_join(df.select("item").distinct(), agreement, ["item"], "left_anti")
        first = unknown.head(1)
        if first:
            raise KeyError(f"no rater agreement for item {first[0]['item']}")
    keep = agreement.where(F.col("qwk_hh") >= hh_min).select("item")
    return dim_join(df, keep, ["item"], "left_semi")


def restrict_dimension(agreement: DataFrame, df: DataFrame) -> DataFrame:
    """Agreement rows of the items that are left."""
    return agreement.join(df.select("item").distinct(), "item", "left_semi")


def filter_max_words(df: DataFrame, max_words: int = 8192, text: str = "text") -> DataFrame:
    return df.where(word_count(text) <= max_words)


def filter_max_tokens(
    df: DataFrame, max_tokens: int = 2048, columns=("input_ids_1", "input_ids_2")
) -> DataFrame:
    for c in columns:
        df = df.where(F.size(c) <= max_tokens)
    return df


def limit_items(df: DataFrame, debug: bool | int = False) -> DataFrame:
    """Debug aid: the first n items in order, 10 unless a larger number is given."""
    if not debug:
        return df
    n = 10 if debug is True or debug <= 1 else int(debug)
    first = df.select("item").distinct().orderBy("item").limit(n)
    return df.join(F.broadcast(first), "item", "left_semi")


def skip_existing(df: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    """Leave out items that already have results."""
    if overwrite:
        return df
    return dim_join(df, done.select("item").distinct(), ["item"], "left_anti")


def checkpoint_number(path: Column) -> Column:
    return F.regexp_extract(path, r"checkpoint-(\d+)/?$", 1).try_cast("int")


def filter_checkpoints(
    df: DataFrame, path: str = "path", low: int | None = None, high: int | None = None,
    listed: list[int] | None = None,
) -> DataFrame:
    """Checkpoints by number: inside [low, high] and, when given, in a list."""
    out = df.withColumn("checkpoint", checkpoint_number(F.col(path)))
    out = out.where(F.col("checkpoint").isNotNull())
    if low is not None:
        out = out.where(F.col("checkpoint") >= low)
    if high is not None:
        out = out.where(F.col("checkpoint") <= high)
    return out.where(F.col("checkpoint").isin(listed)) if listed else out


def blacklisted(score1: Column, score2: Column, blacklist=((0, 0),)) -> Column:
    """Is the unordered pair of scores listed?"""
    hit = F.lit(False)
    for a, b in blacklist:
        low, high = sorted((a, b))
        hit = hit | ((F.least(score1, score2) == low) & (F.greatest(score1, score2) == high))
    return hit


def blacklist_pairs(pairs: DataFrame, blacklist=((0, 0),)) -> DataFrame:
    return pairs.where(~blacklisted(F.col("score1"), F.col("score2"), blacklist))


def last_predictions(preds: DataFrame, position: str = "pos") -> DataFrame:
    """One prediction per record; the last listed wins."""
    return preds.groupBy("item", "idx").agg(F.max_by("pred", position).alias("pred"))


def join_predictions(df: DataFrame, preds: DataFrame) -> DataFrame:
    """Attach predictions by (item, idx).

    A record missing from its item's predictions takes its score and is flagged; a record of
    an item without any predictions keeps NULL.
    """
    known = preds.select("item", F.lit(True).alias("_known")).distinct()
    joined = dim_join(df.join(preds, ["item", "idx"], "left"), known, ["item"])
    filled = F.col("_known").isNotNull() & F.col("pred").isNull()
    return joined.select(
        *df.columns,
        F.when(filled, F.col("score")).otherwise(F.col("pred")).cast("int").alias("pred"),
        filled.alias("pred_filled"),
    )


def select_split_members(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows whose (item, split, idx) is listed."""
    return df.join(members, ["item", "split", "idx"], "left_semi")


def reconcile_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Items with a different number of rows in the two tables."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("item").agg(F.count(F.lit(1)).alias(name))

    both = counts(left, "left_rows").join(counts(right, "right_rows"), "item", "full")
    both = both.na.fill(0, ["left_rows", "right_rows"])
    return both.where("left_rows <> right_rows")


def restore_order(df: DataFrame, position: str = "ord", place: str = "place") -> DataFrame:
    """Rows in the order of item and position, with their 1-based number in it.

    Items are numbered from their sizes, rows inside their item, so no task sorts the whole table.
    """
    starts = running_totals(df.groupBy("item").agg(F.count(F.lit(1)).alias("_n")), "item", ["_n"]).select(
        "item", (F.col("cum__n") - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("item").orderBy(position))
    out = dim_join(df.withColumn("_rank", inside), starts, ["item"])
    return out.withColumn(place, F.col("_start") + F.col("_rank")).drop("_start", "_rank").orderBy(place)
