"""Seeded sampling, splits, folds and positions."""

from pyspark.sql import functions as F

from ..operators import sampling as sm
from ..session import scratch_path
from ..sources import readers, writers
from . import bindings as b
from .catalog import query

SEED = 932
KEYS = ["item", "idx"]
U = b.u32(f"'{SEED}|' || item || '|' || idx")
SEEDED = f"{b.RATINGS}, seeded AS (SELECT *, {U} AS u FROM ratings)"


@query("shuffle_rows", f"""WITH {SEEDED}
SELECT item, idx, row_number() OVER (ORDER BY u, item, idx) - 1 AS position FROM seeded""")
def shuffle_rows(spark, sf):
    return sm.shuffled_positions(b.ratings(spark, sf), SEED, KEYS)


@query("stored_shuffle", f"""WITH {SEEDED}
SELECT item, idx, score, row_number() OVER (ORDER BY u, item, idx) - 1 AS position FROM seeded""")
def stored_shuffle(spark, sf):
    """The table written in its seeded order and read back."""
    path = scratch_path(spark, "shuffled")
    writers.sink_shuffled(b.ratings(spark, sf), path, SEED, KEYS)
    return readers.scan_shuffled(spark, path).select("item", "idx", "score", "position")


@query("split_by_item", f"""WITH {b.RATINGS}, i AS (
  SELECT item, row_number() OVER (ORDER BY {b.u32(f"'{SEED}|' || item")}, item) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT item FROM ratings))
SELECT item, idx, CASE WHEN r <= CAST(floor(n * 0.05) AS INT) THEN 'validation' ELSE 'train' END AS part
FROM ratings JOIN i USING (item)""")
def split_by_item(spark, sf):
    return sm.split_by_item(b.ratings(spark, sf), SEED).select("item", "idx", "part")


@query("train_test_split", f"""WITH {SEEDED}, r AS (
  SELECT *, row_number() OVER (ORDER BY u, item, idx) AS r, count(*) OVER () AS n FROM seeded)
SELECT item, idx, CASE WHEN r <= ceil(n * 0.1) THEN 'validation' ELSE 'train' END AS part FROM r""")
def train_test_split(spark, sf):
    train, test = sm.train_test_split(b.ratings(spark, sf), SEED, KEYS)
    tagged = [t.withColumn("part", F.lit(name)) for t, name in ((train, "train"), (test, "validation"))]
    return tagged[0].unionByName(tagged[1]).select("item", "idx", "part")


@query("cap_rows", f"""WITH {SEEDED}
SELECT item, idx, split FROM seeded
QUALIFY row_number() OVER (PARTITION BY split ORDER BY u, item, idx) <= 1500""")
def cap_rows(spark, sf):
    r = b.ratings(spark, sf)
    parts = [sm.cap_rows(r.where(F.col("split") == s), SEED, KEYS, 1500) for s in ("train", "valid")]
    return parts[0].unionByName(parts[1]).select("item", "idx", "split")


@query("random_subset", f"""WITH {SEEDED}, r AS (
  SELECT *, row_number() OVER (ORDER BY u, item, idx) AS r, count(*) OVER () AS n FROM seeded),
cases AS (SELECT unnest([0, 0.3, 777, 1e9]) AS want)
SELECT CAST(want AS DOUBLE) AS want, count(*) AS n, sum(idx)::BIGINT AS total FROM r, cases
WHERE want <= 0 OR want >= n OR r <= CASE WHEN want < 1 THEN floor(n * want) ELSE want END
GROUP BY want""")
def random_subset(spark, sf):
    r = b.ratings(spark, sf)
    parts = []
    for want in (0, 0.3, 777, 1e9):
        got = sm.random_subset(r, want, SEED, KEYS)
        parts.append(got.groupBy(F.lit(float(want)).alias("want")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("idx").alias("total")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("per_item_seed", f"""WITH {b.RATINGS}
SELECT DISTINCT item, {b.u32(f"'{SEED}|' || item")} AS seed FROM ratings""")
def per_item_seed(spark, sf):
    return sm.per_item_seed(b.ratings(spark, sf), SEED)


FOLDS_SQL = f"""{b.RATINGS}, folds AS (
  SELECT *, CAST(ntile(5) OVER (PARTITION BY item ORDER BY
    {b.u32(f"'{SEED}|' || item || '|' || split || '|' || idx")}, split, idx) - 1 AS INT) AS fold FROM ratings)"""


@query("kfold_assign", f"WITH {FOLDS_SQL} SELECT item, idx, fold FROM folds")
def kfold_assign(spark, sf):
    return sm.kfold_assign(b.ratings(spark, sf), 5, SEED).select("item", "idx", "fold")


@query("batch_assign", f"""WITH {b.RATINGS}
SELECT item, idx, (row_number() OVER (ORDER BY item, split, idx) - 1) // 8 AS batch_index FROM ratings""")
def batch_assign(spark, sf):
    return sm.batch_assign(b.ratings(spark, sf), 8).select("item", "idx", "batch_index")
