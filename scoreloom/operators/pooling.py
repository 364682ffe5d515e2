"""Pooling of hidden states that come as one row per token, for sequences too long for a row.

The vector sum is Spark ML's summarizer: it merges, so tasks send one vector per record and layer, however many tokens
the record has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scaling import dim_join


def token_rows(df: DataFrame, keys: list[str], hidden: str = "hidden", mask: str = "mask") -> DataFrame:
    """``keys, token, mask, state`` from one row per sequence; tokens count from 0."""
    zipped = F.arrays_zip(F.col(hidden).alias("state"), F.col(mask).alias("mask"))
    return df.select(*keys, F.posexplode(zipped).alias("token", "t")).select(*keys, "token", "t.mask", "t.state")


def _ends(rows: DataFrame, keys: list[str], side: str, offset: int) -> DataFrame:
    """Per record: one beyond the last token that counts."""
    if side not in ("left", "right"):
        raise ValueError(f"padding side {side!r} not recognised")
    size = F.max("token") + 1 if side == "left" else F.sum("mask")
    return rows.groupBy(*keys).agg((size - offset).cast("bigint").alias("_end"))


def mean_pool_rows(
    rows: DataFrame, keys: list[str], side: str = "left", last_token_offset: int = 0, nan_safe: bool = False
) -> DataFrame:
    """``keys, pooled``: mean of the token vectors where the mask is 1; NaN entries count as 0 if ``nan_safe``.

    The last ``last_token_offset`` real tokens are left out. A record without a real token has null entries.
    """
    weight = F.col("mask").cast("double")
    if last_token_offset > 0:
        rows = dim_join(rows, _ends(rows, keys, side, last_token_offset), keys)
        weight = F.when(F.col("token") < F.col("_end"), weight).otherwise(F.lit(0.0))

    def value(x: Column) -> Column:
        return (F.nanvl(x, F.lit(0.0)) if nan_safe else x) * F.col("_weight")

    weighed = rows.withColumn("_weight", weight)
    state = array_to_vector(F.transform(F.col("state").cast("array<double>"), value))
    sums = weighed.groupBy(*keys).agg(Summarizer.sum(state).alias("_sum"), F.sum("_weight").alias("_count"))
    count = F.nullif(F.col("_count"), F.lit(0.0))
    return sums.select(*keys, F.transform(vector_to_array("_sum"), lambda x: x / count).alias("pooled"))


def last_token_pool_rows(rows: DataFrame, keys: list[str], side: str = "left", last_token_offset: int = 0) -> DataFrame:
    """``keys, pooled``: the vector of the last real token, or of the one ``last_token_offset`` before it.

    Without an offset one grouped maximum finds it; else the place is counted first and its row taken.
    """
    state = F.col("state").cast("array<double>")
    if last_token_offset == 0 and side in ("left", "right"):
        real = rows if side == "left" else rows.where("mask = 1")
        return real.groupBy(*keys).agg(F.max_by(state, "token").alias("pooled"))
    ends = _ends(rows, keys, side, last_token_offset)
    return dim_join(rows, ends, keys).where(F.col("token") == F.col("_end") - 1).select(*keys, state.alias("pooled"))


def multi_pool_rows(
    rows: DataFrame, keys: list[str], modes: str = "mean", side: str = "left", last_token_offset: int = 0
) -> DataFrame:
    """Concatenation of several poolings named in a comma-separated list."""
    pools = {"mean": mean_pool_rows, "lasttoken": last_token_pool_rows}
    names = [m.strip() for m in modes.split(",")]
    for name in names:
        if name not in pools:
            raise ValueError(f"pooling mode {name!r} not recognised")
    parts = [
        pools[name](rows, keys, side, last_token_offset).withColumnRenamed("pooled", f"_pooled{i}")
        for i, name in enumerate(names)]
    joined = reduce(lambda a, b: a.join(b, keys), parts)
    return joined.select(*keys, F.concat(*[f"_pooled{i}" for i in range(len(names))]).alias("pooled"))
