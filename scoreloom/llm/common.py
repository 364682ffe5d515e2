"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shared_dir

SPACE, NO_SPACE = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"   # what separates words, and what makes them


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once and keep it in the shared checkpoint folder.

    Later reads do not depend on the executors that made it. The files go when nothing refers
    to the table any more, if the session cleans its checkpoints.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``settle``, but as compressed columns, of which later steps read only some."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def word_list(text: Column) -> Column:
    """Maximal runs of anything but blanks, tabs, line and page breaks."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    A lambda that refers to a column of its own table may get that column's whole expression in its
    place when filters are pushed down, and would then compute it for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_mark(text: Column) -> Column:
    """A 64-bit mark that tells texts with one id apart; null has a mark of its own."""
    return F.xxhash64(text.isNull(), text)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working names that no column of the table has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
