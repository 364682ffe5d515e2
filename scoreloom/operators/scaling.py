"""Joins, ranks and running totals that stay balanced when one group holds most rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import TWO32
from ..session import stored

BROADCAST_ROWS = 500_000   # a per-group table above this many rows is joined by shuffle
GROUP_ROWS = 200_000       # a group above this many rows is ranked in several tasks
SALTS = 32
CUTS = 4096                # most ranges a running total is cut into


def is_small(dim: DataFrame, max_rows: int | None = None) -> bool:
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    return dim.limit(limit + 1).count() <= limit


def dim_join(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    how: str = "left",
    max_rows: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Join a per-group table to its rows.

    The table is broadcast only after its row count is checked, unless the caller has already
    done so. Above the bound both sides shuffle, with the group key salted so that no single
    group lands in one task.
    """
    if small is None:
        dim = dim.persist()
        small = is_small(dim, max_rows)
    if small:
        return fact.join(F.broadcast(dim), keys, how)
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return fact.withColumn("_salt", _spread(fact)).join(copies, [*keys, "_salt"], how).drop("_salt")


def _spread(df: DataFrame) -> Column:
    """A salt from the row's own scalar values, the same on every retry."""
    return F.pmod(F.xxhash64(*[n for n, t in df.dtypes if "<" not in t]), F.lit(SALTS)).cast("int")


def rank_within(
    df: DataFrame,
    keys: list[str],
    u: Column,
    ties: list[str],
    rank: str = "rank",
    size: str = "size",
    group_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """1-based rank of each row in its group by the 32-bit hash ``u``, and the group size.

    Groups above ``group_rows`` are cut into equal hash ranges; each range is ranked on its
    own and shifted by the sizes of the ranges before it. ``largest`` is the size of the largest
    group where the caller knows it.
    """
    limit = GROUP_ROWS if group_rows is None else group_rows
    df = df.withColumn("_u", u)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(size))
    if largest is None:
        sizes = sizes.persist()
        largest = sizes.agg(F.max(size)).head()[0] or 0
    if largest <= limit:
        group = Window.partitionBy(*keys)
        return df.select(
            "*",
            F.row_number().over(group.orderBy("_u", *ties)).alias(rank),
            F.count(F.lit(1)).over(group).alias(size),
        ).drop("_u")
    pieces = F.ceil(F.col(size) / F.lit(float(limit)))
    df = dim_join(df, sizes, keys).withColumn(
        "_piece", F.floor(F.col("_u") * pieces / F.lit(float(TWO32)))
    )
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = (
        df.where(F.col(size) > limit)
        .groupBy(*keys, "_piece")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_piece", F.sum("_rows").over(before).alias("_shift"))
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy("_u", *ties))
    return (
        dim_join(df, shifts, [*keys, "_piece"])
        .withColumn(rank, (local + F.coalesce("_shift", F.lit(0))).cast("int"))
        .drop("_u", "_piece", "_shift")
    )


def running_totals(
    cells: DataFrame,
    order: str,
    values: list[str],
    ties: list[str] = (),
    descending: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Add ``cum_<value>`` and ``all_<value>`` over the whole table in ``order``.

    The order column is cut at approximate quantiles; only one total per cut reaches the
    driver. Where the cuts fall affects balance, never the result.
    """
    spark = cells.sparkSession
    cells = cells.persist()
    n = parts or min(CUTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = cells.withColumn("_o", F.col(order).cast("double"))
    cuts = sorted(set(keyed.approxQuantile("_o", [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    if cuts:
        ends = [float("-inf"), *cuts, float("inf")]
        cutter = Bucketizer(splits=ends, inputCol="_o", outputCol="_c", handleInvalid="keep")
        keyed = cutter.transform(keyed).withColumn("_cut", F.col("_c").cast("int")).drop("_c")
    else:
        keyed = keyed.withColumn("_cut", F.lit(0))
    rows = keyed.groupBy("_cut").agg(*[F.sum(v).alias(v) for v in values]).collect()
    rows.sort(key=lambda r: r["_cut"], reverse=descending)
    total = {v: 0 for v in values}
    shifts = []
    for r in rows:
        shifts.append((r["_cut"], *[total[v] for v in values]))
        for v in values:
            total[v] += r[v]
    types = dict(keyed.groupBy().agg(*[F.sum(v).alias(v) for v in values]).dtypes)
    schema = "_cut int, " + ", ".join(f"_shift_{v} {types[v]}" for v in values)
    table = spark.createDataFrame(shifts, schema)
    key = F.col(order).desc() if descending else F.col(order).asc()
    upto = Window.partitionBy("_cut").orderBy(key, *ties).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = keyed.join(F.broadcast(table), "_cut", "left")
    for v in values:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(upto) + F.col(f"_shift_{v}"))
        out = out.withColumn(f"all_{v}", F.lit(total[v]).cast(types[v]))
    return out.drop("_o", "_cut", *[f"_shift_{v}" for v in values])


def numbered(df: DataFrame, order: list, position: str = "position", part: str | None = None) -> DataFrame:
    """Add the 0-based ``position`` of every row in a total order, and with ``part`` the number of its range.

    The rows are range-partitioned by the whole order, at sampled borders, and sorted inside their ranges; a
    position is the row's place in its range plus the rows of the ranges before it. So neither ties
    of the first keys nor an outlying value put more than a range's share into one task, and the driver sees one number
    a range. The table is stored once.
    """
    spark = df.sparkSession
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(df.orderBy(*order).select("*", F.spark_partition_id().alias("_range"), inside.alias("_place")), "numbered")
    shifts, total = [], 0
    for r in sorted(rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        shifts.append((r["_range"], total))
        total += r["n"]
    before = spark.createDataFrame(shifts, "_range int, _before bigint")
    more = [] if part is None else [F.col("_range").alias(part)]
    return rows.join(F.broadcast(before), "_range").select(
        *df.columns, (F.col("_before") + F.col("_place")).alias(position), *more)
