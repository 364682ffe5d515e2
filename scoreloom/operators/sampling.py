"""Shuffles, splits, caps and folds that depend only on a seed and the record keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from .scaling import dim_join, numbered, rank_within, running_totals

RADIX = 1 << 16


def smallest_k(df: DataFrame, u: Column, keys: list[str], k: int) -> Column:
    """Condition that holds for exactly the k rows with the smallest (hash, keys).

    Two counts over 16 bits each find the k-th hash value; rows at that very value are told
    apart by their keys. The driver sees at most 65,536 counters at a time, and the table is
    afterwards only filtered: nothing is sorted or moved.
    """
    if k <= 0:
        return F.lit(False)
    slim = df.select(*keys, u.alias("_u"))

    def find(rows: DataFrame, digit: Column, rank: int):
        counts = rows.groupBy(digit.alias("_d")).agg(F.count(F.lit(1)).alias("_n")).collect()
        for value, n in sorted((r["_d"], r["_n"]) for r in counts):
            if rank <= n:
                return value, rank
            rank -= n
        return None, rank

    high, left = find(slim, F.shiftright("_u", 16), k)
    if high is None:
        return F.lit(True)
    inside = slim.where(F.shiftright("_u", 16) == high)
    low, left = find(inside, F.col("_u") % RADIX, left)
    cut = high * RADIX + low
    ties = inside.where(F.col("_u") == cut).select(*keys).orderBy(*keys).limit(left).collect()
    types = dict(slim.dtypes)
    last = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, ties[-1])])
    return (u < cut) | ((u == cut) & (F.struct(*keys) <= last))


def shuffle_rows(df: DataFrame, seed, keys: list[str]) -> DataFrame:
    """The whole table in a seeded random order."""
    return df.withColumn("_u", hash32(seed, *keys)).orderBy("_u", *keys).drop("_u")


def shuffled_positions(df: DataFrame, seed, keys: list[str]) -> DataFrame:
    """Keys with their 0-based position in the seeded order."""
    slim = df.select(*keys, hash32(seed, *keys).alias("_u"), F.lit(1).cast("bigint").alias("one"))
    out = running_totals(slim, "_u", ["one"], ties=keys)
    return out.select(*keys, (F.col("cum_one") - 1).alias("position"))


def split_by_item(df: DataFrame, seed, share: float = 0.05) -> DataFrame:
    """Whole items go to validation: the first int(share * items) in seeded order."""
    items = df.select("item").distinct()
    ranked = shuffled_positions(items, seed, ["item"]).persist()
    cut = int(ranked.count() * share)
    part = F.when(F.col("position") < cut, "validation").otherwise("train")
    return dim_join(df, ranked.select("item", part.alias("part")), ["item"])


def train_test_split(
    df: DataFrame, seed, keys: list[str], test_share: float = 0.1
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) with ceil(share * n) rows in validation."""
    picked = _picked(df, seed, keys, math.ceil(df.count() * test_share))
    return df.where(~picked), df.where(picked)


def _picked(df: DataFrame, seed, keys: list[str], k: int) -> Column:
    return smallest_k(df, hash32(seed, *keys), keys, k)


def cap_rows(df: DataFrame, seed, keys: list[str], max_rows: int) -> DataFrame:
    """At most ``max_rows`` randomly chosen rows."""
    return df.where(_picked(df, seed, keys, max_rows))


def random_subset(df: DataFrame, n: float, seed, keys: list[str]) -> DataFrame:
    """n rows, or a share of the rows for 0 < n < 1; everything for n <= 0 or n >= rows."""
    if n <= 0:
        return df
    rows = df.count()
    if n >= rows:
        return df
    return df.where(_picked(df, seed, keys, int(rows * n) if n < 1 else int(n)))


def per_item_seed(df: DataFrame, seed) -> DataFrame:
    """An own seed for every item."""
    return df.select("item").distinct().withColumn("seed", hash32(seed, "item"))


def kfold_assign(
    df: DataFrame, k: int, seed, keys: list[str] = ("item", "split", "idx"), group_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Random folds 0..k-1 per item; the first n % k folds hold one row more.

    ``keys`` tell the rows of an item apart; those that the table does not have are left out.
    """
    keys = [c for c in keys if c in df.columns]
    ranked = rank_within(
        df, ["item"], hash32(seed, *keys), [c for c in keys if c != "item"], "_rank", "_size",
        group_rows, largest,
    )
    at = F.col("_rank") - 1
    small = F.floor(F.col("_size") / k)
    larger = F.col("_size") % k
    border = larger * (small + 1)
    fold = F.when(at < border, F.floor(at / (small + 1))).otherwise(
        larger + F.floor((at - border) / F.nullif(small, F.lit(0)))
    )
    return ranked.withColumn("fold", fold.cast("int")).drop("_rank", "_size")


def load_positions(df: DataFrame) -> DataFrame:
    """0-based position in load order: items ascending, training rows first, then by index."""
    later = (F.col("split") != "train").cast("int")
    keyed = df.withColumn("_later", later)
    return numbered(keyed, ["item", "_later", "idx"]).drop("_later")


def batch_assign(df: DataFrame, batch_size: int = 8) -> DataFrame:
    """Batch number of each record over the flattened items."""
    return load_positions(df).withColumn("batch_index", F.floor(F.col("position") / batch_size))
