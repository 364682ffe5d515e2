"""Typing and cleaning of raw records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import collapse_runs, strip

TRAITS = ("dev", "con", "org")

# Mode codes of the raw records.
MODE_CODES = {"1a": "narrative", "3a": "explanatory", "6a": "argumentative"}


def type_common(df: DataFrame) -> DataFrame:
    """item, index and grade as integers; a value that is not one raises."""
    return df.withColumns({c: F.col(c).cast("int") for c in ("item", "index", "grade")})


def mode_parts(mode: Column, strict: bool = True) -> tuple[Column, Column]:
    """(mode, section) of text like ``Tar 1a Elaboration``.

    Text of another shape raises, or gives NULLs when not strict.
    """
    words = F.split(strip(F.lower(mode)), r"(?U)[\s\x1c-\x1f]+")
    known = F.create_map(*[F.lit(x) for pair in MODE_CODES.items() for x in pair])
    name = F.when(F.size(words) == 3, F.try_element_at(known, F.get(words, 1)))
    section = F.when(name.isNotNull(), F.get(words, 2))
    if strict:
        broken = F.raise_error(F.concat(F.lit("unknown mode: "), F.coalesce(mode, F.lit("null"))))
        return F.coalesce(name, broken.cast("string")), section
    return name, section


def clean_bw(df: DataFrame, strict: bool = True) -> DataFrame:
    mode, section = mode_parts(F.col("mode"), strict)
    return type_common(df).select(
        "index", "grade", mode.alias("mode"), "item", "text", section.alias("section"),
        F.col("sc").cast("int").alias("score"), *_split(df),
    )


def clean_math(df: DataFrame) -> DataFrame:
    return type_common(df).select(
        "index", "grade", F.lower("mode").alias("mode"), "item", "text",
        F.col("sc").cast("int").alias("score"), *_split(df),
    )


def clean_fw(df: DataFrame) -> DataFrame:
    blocks = [F.struct(F.col(t).cast("int").alias("score")).alias(t) for t in TRAITS]
    return type_common(df).select(
        "index", "grade", F.lower("mode").alias("mode"), "item", *blocks, "text", *_split(df)
    )


def _split(df: DataFrame) -> list[str]:
    return [c for c in ("split",) if c in df.columns]


CLEANERS = {"bw": clean_bw, "fw": clean_fw, "math": clean_math}


def clean_items(item_type: str, train: DataFrame, valid: DataFrame) -> DataFrame:
    """Both raw splits typed, tagged and normalised: everything before the per-item write."""
    from .agreement import with_score_norm, with_trait_norms

    clean = CLEANERS[item_type]
    tagged = [
        clean(df).withColumn("split", F.lit(name)) for name, df in (("train", train), ("valid", valid))
    ]
    both = tag_split_type(union_splits(*tagged), item_type)
    return with_trait_norms(both) if item_type == "fw" else with_score_norm(both)


def select_trait(df: DataFrame, trait: str) -> DataFrame:
    """Lift the score block of one trait to the top level and name the trait."""
    if trait not in TRAITS:
        raise ValueError(f"unknown trait {trait!r}")
    return df.select("*", f"{trait}.*", F.lit(trait).alias("trait"))


def tag_split_type(df: DataFrame, item_type: str, split: str | None = None) -> DataFrame:
    tagged = df.withColumn("item_type", F.lit(item_type))
    return tagged.withColumn("split", F.lit(split)) if split else tagged


def keep_label_columns(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Only the label columns that exist, and the named ones."""
    return df.select(*[c for c in ("diff", "diff_norm", "diff_abs") if c in df.columns], *extra)


def pair_label(columns: list[str], use_diff_norm: bool = False) -> Column:
    """diff_norm by request, else diff_abs with diff as its stand-in."""
    if use_diff_norm:
        return F.col("diff_norm").cast("double")
    present = [F.col(c) for c in ("diff_abs", "diff") if c in columns]
    if not present:
        raise ValueError("no label column")
    return F.coalesce(*present).cast("double")


def common_key_projection(tables: list[DataFrame]) -> DataFrame:
    """Union of tables over the columns all of them have."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    return reduce(DataFrame.unionByName, [t.select(*shared) for t in tables])


def union_splits(train: DataFrame, valid: DataFrame) -> DataFrame:
    return train.unionByName(valid)


def union_configs(tables: dict[str, DataFrame]) -> DataFrame:
    """Concatenate the tables of several configurations, each row tagged with its own."""
    tagged = [t.withColumn("config", F.lit(name)) for name, t in tables.items()]
    return common_key_projection(tagged)


def truncate_longest_to_median(
    df: DataFrame, batch: str = "batch", text: str = "text", order: str = "idx",
    min_length: int = 10, keep_ratio: float = 0.8,
) -> DataFrame:
    """Length guard for inference batches.

    Character runs are collapsed in every text; the longest text of a batch, if it still has
    more than ``keep_ratio`` of its length, is cut to the upper median length of the batch.
    Batches are a handful of rows by construction.
    """
    fixed = df.withColumn("_old", F.length(text)).withColumn(text, collapse_runs(text, min_length))
    fixed = fixed.withColumn("_new", F.length(text))
    rows = Window.partitionBy(batch)
    ranked = fixed.select(
        "*",
        F.row_number().over(rows.orderBy(F.desc("_old"), order)).alias("_longest"),
        F.row_number().over(rows.orderBy("_new", order)).alias("_nth"),
        F.count(F.lit(1)).over(rows).alias("_n"),
    )
    median = F.max(F.when(F.col("_nth") == F.floor(F.col("_n") / 2) + 1, F.col("_new"))).over(rows)
    cut = (F.col("_longest") == 1) & (F.col("_new") / F.col("_old") > keep_ratio)
    return (
        ranked.withColumn("_median", median)
        .withColumn(text, F.when(cut, F.substring(F.col(text), F.lit(1), F.col("_median"))).otherwise(F.col(text)))
        .drop("_old", "_new", "_longest", "_nth", "_n", "_median")
    )
