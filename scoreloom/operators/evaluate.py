"""Out-of-fold evaluation of embeddings and comparison of checkpoints."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.hashing import hash32
from ..functions.vectors import dot
from ..session import shared_dir
from ..sources.readers import finished_items
from ..sources.writers import manifest, present, sink_predictions
from .agreement import qwk_weighted_scale
from .encode import Encoder, embed_many, embed_table
from .items import skip_existing
from .learners import Learner, Ridge, products
from .sampling import kfold_assign
from .scaling import dim_join, numbered, rank_within

SUM_VALUES = 16_000_000   # values of sums a task keeps before passing them on
SHARD_ROWS = 1 << 20      # rows of a group whose sums are merged together
FIT_ROWS = 20_000         # rows of a group on which a learner without sums is fitted
PART_ROWS = 100_000       # rows such a learner predicts at once
LINE_ITEMS = 1 << 14      # neighbouring items whose values become text together


# --- one grouped fit for items of any size -----------------------------------------------------

class _Sums:
    """Sums of products of (x, 1, y) over the rows of one group and fold.

    Few rows stay as they are; from ``width`` rows on their products take less room. So what is
    shipped is never larger than the rows, and a row is only counted, never kept, in a long stream.
    """

    def __init__(self, width: int):
        self.width, self.x, self.y, self.held, self.gram = width, [], [], 0, None

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x.append(x)
        self.y.append(y)
        self.held += len(x)
        if self.held >= self.width + 2:
            self.fold()

    def fold(self) -> None:
        if self.held:
            self._plus(products(np.concatenate(self.x).astype(np.float64), np.concatenate(self.y)))
            self.x, self.y, self.held = [], [], 0

    def _plus(self, gram: np.ndarray) -> None:
        self.gram = gram if self.gram is None else self.gram + gram

    def values(self) -> int:
        return self.held * (self.width + 1) + (0 if self.gram is None else self.gram.size)

    def packed(self) -> tuple[int, int, bytes]:
        """(rows, bytes of a value, data) of rows, or (0, 8, upper triangle) of products."""
        if self.gram is None:
            x = np.concatenate(self.x)
            return len(x), x.itemsize, x.tobytes() + np.concatenate(self.y).tobytes()
        self.fold()
        return 0, 8, self.gram[np.triu_indices(self.width + 2)].tobytes()

    def unpack(self, rows: int, size: int, data: bytes) -> None:
        if rows:
            x = np.frombuffer(data, dtype=f"f{size}", count=rows * self.width).reshape(rows, self.width)
            self.add(x, np.frombuffer(data, dtype="f8", offset=x.nbytes))
            return
        gram = np.zeros((self.width + 2, self.width + 2))
        gram[np.triu_indices(len(gram))] = np.frombuffer(data, dtype="f8")
        self._plus(gram + np.triu(gram, 1).T)

    def total(self) -> np.ndarray:
        self.fold()
        return self.gram


SHIPPED = "fold int, salt int, width int, rows int, size int, data binary"


def _ship(df: DataFrame, group: list[str], shards: int) -> DataFrame:
    """Each task's sums per group and fold; ``salt`` deals the tasks over the shards of a group."""
    keys = [*group, "fold"]
    slim = df.select(*group, F.col("fold").cast("int").alias("fold"), F.col("score").cast("double").alias("score"), "embedding")
    schema = StructType([*slim.select(*group).schema, *StructType.fromDDL(SHIPPED)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        salt = TaskContext.get().partitionId() % shards

        def flush():
            for key, own in sums.items():
                yield _record((*key, salt, own.width, *own.packed()), arrow)
            sums.clear()

        for batch in batches:
            pdf = batch.to_pandas()
            for key, g in pdf.groupby(keys, dropna=False):
                x = np.stack(g["embedding"].to_numpy())
                key = tuple(v.item() if isinstance(v, np.generic) else v for v in key)
                if key not in sums:
                    sums[key] = _Sums(x.shape[1])
                sums[key].add(x, g["score"].to_numpy(np.float64))
            if sum(own.values() for own in sums.values()) > SUM_VALUES:
                yield from flush()
        yield from flush()

    return slim.mapInArrow(run, schema)


def _record(row: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)


def _streamed(batches: Iterator[pa.RecordBatch], n: int):
    """(key of n columns, width, rows, size, data) row by row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in batch.columns]
            yield tuple(row[:n]), *row[-4:]


def _merge(shipped: DataFrame, group: list[str]) -> DataFrame:
    """One sum per group, fold and shard: rows stream by in order, so a task holds one sum at a time."""
    keys = [*group, "fold", "salt"]
    arrow = to_arrow_schema(shipped.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for key, width, *data in _streamed(batches, len(keys)):
            if key != now:
                if own is not None:
                    yield _record((*now, own.width, *own.packed()), arrow)
                now, own = key, _Sums(width)
            own.unpack(*data)
        if own is not None:
            yield _record((*now, own.width, *own.packed()), arrow)

    return shipped.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, shipped.schema)


def fit_folds(df: DataFrame, ridge: Ridge, group: list[str], shards: int) -> DataFrame:
    """``group, fold, w``: for every fold the coefficients fitted on the group's other folds.

    Tasks send sums, not more bytes than the rows have; groups of many rows are merged in shards first. The other
    folds are the group's total minus the fold. A task holds the sums of one group, k times (width + 2) squared.
    """
    shipped = _ship(df, group, shards)
    if shards > 1:
        shipped = _merge(shipped, group)
    keys = [*group, "fold"]
    schema = StructType([*df.select(*group).schema, *StructType.fromDDL("fold int, w array<double>")])
    arrow = to_arrow_schema(schema)

    def solved(now, folds):
        total = sum(own.total() for own in folds.values())
        for fold, own in folds.items():
            yield _record((*now, fold, ridge.weights(total - own.total()).tolist()), arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, folds = None, {}
        for key, width, *data in _streamed(batches, len(keys)):
            if key[:-1] != now:
                yield from solved(now, folds)
                now, folds = key[:-1], {}
            folds.setdefault(key[-1], _Sums(width)).unpack(*data)
        yield from solved(now, folds)

    dealt = shipped.repartition(*group).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def _fit_ridge(df: DataFrame, ridge: Ridge, group: list[str], shards: int, width: int) -> DataFrame:
    weights = fit_folds(df, ridge, group, shards)
    size = F.size("embedding")
    # Coefficients are broadcast up to a bounded number of values.
    joined = dim_join(df, weights, [*group, "fold"], max_rows=SUM_VALUES // (width + 1))
    pred = dot("embedding", F.slice("w", F.lit(1), size)) + F.element_at("w", size + 1)
    return joined.select(*group, "idx", "split", "fold", "score", pred.alias("pred"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _fit_drawn(df: DataFrame, learner: Learner, group: list[str], fit_rows: int, part_rows: int) -> DataFrame:
    """Any learner for items of any size: one task fits the models of a group on at most ``fit_rows`` of its
    rows, drawn by key hash, and the rows are predicted in parts of about ``part_rows`` rows."""
    types = dict(df.dtypes)
    key = [*group, "fold"]
    head = ", ".join(f"{c} {types[c]}" for c in group)
    drawn = rank_within(
        df, group, hash32("fit", *group, "split", "idx"), ["split", "idx"], "_rank", "_size"
    ).where(F.col("_rank") <= fit_rows)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, fold = _matrix(pdf["embedding"]), pdf["score"].to_numpy(np.float64), pdf["fold"].to_numpy()
        rows = []
        for f in json.loads(pdf["folds"].iat[0]):
            other = fold != f
            if other.any():
                rows.append((*pdf[group].iloc[0], f, cloudpickle.dumps(learner.fit(x[other], y[other]))))
        return pd.DataFrame(rows, columns=[*key, "model"])

    folds = df.groupBy(*group).agg(F.to_json(F.sort_array(F.collect_set("fold"))).alias("folds"))
    models = dim_join(drawn, folds, group).groupBy(*group).applyInPandas(fit, f"{head}, fold {types['fold']}, model binary")
    sizes = df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(part_rows))).cast("int").alias("_parts"))
    rows = dim_join(df, sizes, key).withColumn("_part", F.pmod(F.xxhash64("split", "idx"), F.col("_parts")).cast("int")).drop("_parts")
    numbers = sizes.select(*key, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    copies = models.join(numbers, key).select(*key, "model", "_part")

    def predict(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*group, "idx", "split", "fold", "score"]]
        if pdf.empty or model.empty:
            return out.assign(pred=np.nan)
        return out.assign(pred=learner.predict(pickle.loads(model["model"].iat[0]), _matrix(pdf["embedding"])))

    schema = head + "".join(f", {c} {types[c]}" for c in ("idx", "split", "fold", "score")) + ", pred double"
    return rows.groupBy(*key, "_part").cogroup(copies.groupBy(*key, "_part")).applyInPandas(predict, schema)


def predict_folds(
    df: DataFrame, learner: Learner | None = None, group: list[str] = ("item",), shards: int | None = None,
    sizes: tuple[int, int] | None = None, fit_rows: int = FIT_ROWS, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Predict every fold of every group from the group's other folds, in the same way at every size.

    A Ridge is fitted on all rows, from sums. Other learners fit a group on ``fit_rows`` of its rows, drawn
    by key hash, less the fold in question; every row of every group is predicted.
    """
    learner, group = learner or Ridge(), list(group)
    if not isinstance(learner, Ridge):
        return _fit_drawn(df, learner, group, fit_rows, part_rows)
    largest, width = sizes or _sizes(df, group)
    return _fit_ridge(df, learner, group, shards or max(1, -(-largest // SHARD_ROWS)), width)


def _sizes(df: DataFrame, group: list[str] = ("item",)) -> tuple[int, int]:
    """Rows of the largest group, and length of the longest embedding."""
    per_group = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")
    )
    row = per_group.agg(F.max("n").alias("n"), F.max("d").alias("d")).head()
    return row["n"] or 0, max(0, row["d"] or 0)


def _with_split(df: DataFrame) -> DataFrame:
    return df if "split" in df.columns else df.withColumn("split", F.lit("train"))


def oof_predict(
    df: DataFrame, k: int = 5, learner: Learner | None = None, seed=42,
    shards: int | None = None, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """K-fold out-of-fold predictions per item; every item has folds of its own."""
    df = _with_split(df)
    sizes = _sizes(df)
    folds = kfold_assign(df, k, seed, largest=sizes[0])
    return predict_folds(folds, learner, shards=shards, sizes=sizes, fit_rows=fit_rows)


def holdout_predict(
    df: DataFrame, learner: Learner | None = None, shards: int | None = None,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Fit on the training rows of an item, predict its validation rows."""
    known = df.where(F.col("split").startswith("train") | F.col("split").startswith("valid"))
    folds = known.withColumn("fold", F.col("split").startswith("valid").cast("int"))
    return predict_folds(folds, learner, shards=shards, fit_rows=fit_rows).where(
        (F.col("fold") == 1) & F.col("pred").isNotNull() & ~F.isnan("pred")
    )


def item_qwk(preds: DataFrame, keys: list[str] = ("item",)) -> DataFrame:
    """Agreement of predictions with scores per item, to 4 places, never a negative zero."""
    known = preds.where(~F.isnan(F.col("pred").cast("double")))
    out = qwk_weighted_scale(known, list(keys), "score", "pred")
    return out.withColumn("qwk", F.round("qwk", 4) + 0.0)


def generate_predictions(
    df: DataFrame, encoder: Encoder | None = None, k: int = 5, learner: Learner | None = None,
    seed=42, done: DataFrame | None = None, overwrite: bool = False, root: str | None = None,
    model: str = "default", trait: str | None = None, step: int | None = None, batches: int = 1,
) -> DataFrame:
    """Embed, predict out of fold and round, for items without results so far.

    With a ``root`` the predictions are saved there by model, trait and item, and items that its manifest calls
    finished count as done: a second call does nothing new, one after a broken run makes what is missing.
    Items are saved in ``batches`` parts, so that a run that is stopped keeps the parts it has ended. The embeddings
    are stored once: encoding is the costly part and must survive lost executors.
    """
    spark = df.sparkSession
    shared_dir(spark)
    if root is not None and present(spark, manifest(root)):
        # Stored, so that no later plan over the same files is taken for what they held before.
        saved = finished_items(spark, root, model, trait).select("item").checkpoint()
        done = saved if done is None else done.select("item").unionByName(saved)
    todo = df if done is None else skip_existing(df, done, overwrite)

    def predicted(part: DataFrame) -> DataFrame:
        preds = oof_predict(embed_table(part, encoder).checkpoint(), k, learner, seed)
        return preds.select("item", "idx", "score", F.rint("pred").cast("int").alias("pred"))

    if root is None:
        return predicted(todo)
    parts = []
    for n in range(batches):
        part = todo if batches == 1 else todo.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == n)
        parts.append(predicted(part).checkpoint())
        sink_predictions(parts[-1], root, model, trait, step)
    return reduce(DataFrame.unionByName, parts)


# --- checkpoints -------------------------------------------------------------------------------

def scan_checkpoints(
    df: DataFrame, encoders: dict[int, Encoder], k: int = 5, learner: Learner | None = None, seed=42
) -> DataFrame:
    """Embed, predict out of fold and measure agreement, for every checkpoint and item.

    ``encoders`` holds one encoder per checkpoint number. The texts are read and split once for all of
    them, the vectors are stored once, folds are drawn once, and one grouped fit serves all
    checkpoints, items and folds.
    """
    shared_dir(df.sparkSession)
    vectors = _with_split(embed_many(df, encoders).checkpoint())
    longest = F.array_max(F.transform(F.map_values("vectors"), lambda v: F.size(v)))
    per_item = vectors.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max(longest).alias("d"))
    size = per_item.agg(F.max("n").alias("n"), F.max("d").alias("d")).head()
    sizes = size["n"] or 0, size["d"] or 0
    folds = kfold_assign(vectors, k, seed, largest=sizes[0])
    keys = ["item", "idx", "split", "fold", "score"]
    rows = folds.select(*keys, F.explode("vectors").alias("checkpoint", "embedding"))
    preds = predict_folds(rows, learner, ["checkpoint", "item"], sizes=sizes)
    return score_checkpoints(preds.select("checkpoint", "item", "idx", "score", F.rint("pred").cast("int").alias("pred")))


def score_checkpoints(preds: DataFrame) -> DataFrame:
    """Agreement per checkpoint and item of ready predictions; all checkpoints in one job."""
    return item_qwk(preds, ["checkpoint", "item"])


def checkpoint_leaderboard(scores: DataFrame) -> DataFrame:
    """Mean agreement over items and rank of each checkpoint."""
    per = scores.groupBy("checkpoint").agg(
        F.round(F.avg("qwk"), 4).alias("mean_qwk"), F.count("qwk").alias("items")
    )
    best = Window.orderBy(F.desc("mean_qwk"))   # one row per checkpoint
    return per.withColumn("place", F.rank().over(best)).orderBy("checkpoint")


def leaderboard_lines(scores: DataFrame) -> DataFrame:
    """Tab-separated text per checkpoint: name, mean over all items, and the value of every item in
    ascending order of items; ``nan`` where a checkpoint has no value for an item.

    A line holds one number per item, so lines grow with the items, not with the records. Items are numbered once;
    the values of a checkpoint become text in pieces of neighbouring items, and the pieces lines, so no value is
    searched for among the others. A null item, or an item twice in a checkpoint, is an error.
    """
    def number(value):
        return F.when(value.isNull(), "nan").otherwise(F.format_string("%.4f", value))

    own = scores.groupBy("item").agg(F.collect_list(F.struct("checkpoint", "qwk")).alias("own"))
    placed = numbered(own, ["item"], "place")
    items = placed.count()
    values = placed.select("item", "place", F.explode("own").alias("own")).select(
        "own.checkpoint", F.floor(F.col("place") / LINE_ITEMS).alias("_piece"),
        F.col("place").alias("first"), F.col("place").alias("last"),
        F.col("own.qwk").cast("double").alias("sum"), F.col("own.qwk").isNotNull().cast("bigint").alias("n"),
        F.when(F.col("item").isNull(), F.raise_error(F.lit("a score without an item")))
        .otherwise(number(F.col("own.qwk"))).alias("text"))
    lines = _side_by_side(_side_by_side(values, ["checkpoint", "_piece"]), ["checkpoint"])
    return lines.select("checkpoint", F.concat(
        F.lit("checkpoint-"), F.col("checkpoint").cast("string"), F.lit("\t"),
        number(F.col("sum") / F.nullif(F.col("n"), F.lit(0))), F.lit("\t\t"),
        F.repeat(F.lit("nan\t"), F.col("first").cast("int")), F.col("text"),
        F.repeat(F.lit("\tnan"), (items - 1 - F.col("last")).cast("int"))).alias("line")).orderBy("checkpoint")


def _side_by_side(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Texts that cover the places ``first`` to ``last``, joined per group, with ``nan`` for the places between them."""
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("first"))
    gap = F.coalesce(F.col("first") - before - 1, F.lit(0)).cast("int")
    text = F.when(gap < 0, F.raise_error(F.lit("an item has two scores at one checkpoint"))).otherwise(
        F.concat(F.repeat(F.lit("nan\t"), gap), F.col("text")))
    inner = pieces.withColumn("text", text)
    ordered = F.sort_array(F.collect_list(F.struct("first", "text")))
    return inner.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda t: t["text"]), "\t").alias("text"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("sum").alias("sum"), F.sum("n").alias("n"))


def next_checkpoint(board: DataFrame) -> DataFrame:
    """The unvisited checkpoint (NULL value) beside the best visited one; lowest number on ties."""
    order = Window.orderBy("checkpoint")   # one row per checkpoint
    beside = F.greatest(F.lag("qwk").over(order), F.lead("qwk").over(order))
    open_rows = board.withColumn("beside", beside).where(
        F.col("qwk").isNull() & F.col("beside").isNotNull()
    )
    best = F.max(F.struct("beside", (-F.col("checkpoint")).alias("c")))
    return open_rows.agg(best.alias("b")).where("b IS NOT NULL").select(
        (-F.col("b.c")).alias("checkpoint"), F.col("b.beside").alias("beside")
    )
