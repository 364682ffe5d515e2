"""Pooling, layers, similarities and losses."""

from pyspark.sql import functions as F

from ..functions import losses as ls
from ..functions import vectors as vc
from ..operators import pooling as pl
from . import bindings as b
from .catalog import query


def token_states(spark, sf):
    """Four tokens of 16 values, of which 2 to 4 are real; padded on either side."""
    real = (2 + F.col("idx") % 3).cast("int")
    left = [F.when(F.lit(4 - i) <= real, 1).otherwise(0) for i in range(4)]
    right = [F.when(F.lit(i) < real, 1).otherwise(0) for i in range(4)]
    return b.layers(spark, sf).select(
        "idx", F.array("h1", "h2", "h3", "h4").alias("hidden"),
        F.array(*left).alias("left_mask"), F.array(*right).alias("right_mask"),
    )


STATES = b.LAYERS + """, states AS (
  SELECT *, CAST(2 + idx % 3 AS INT) AS real, [h1, h2, h3, h4] AS hidden FROM layers)"""


def exploded(df, *names):
    """One row per vector dimension, so every value is compared."""
    zipped = F.arrays_zip(*[F.col(n).alias(n) for n in names])
    rows = df.select("idx", F.posexplode(zipped).alias("dim", "v"))
    return rows.select("idx", "dim", *[(F.round(f"v.{n}", 6) + 0.0).alias(n) for n in names])


def mean_sql(low, high):
    """Mean over tokens low..high of one dimension d."""
    inner = f"list_sum(list_transform(hidden[({low}):({high})], lambda h: h[d + 1]))"
    return f"{inner} / (({high}) - ({low}) + 1)"


def by_dim(select, width=16):
    return f"""WITH {STATES} SELECT idx, CAST(d AS INT) AS dim, {select}
FROM states, (SELECT unnest(range({width})) AS d)"""


@query("mean_pool", by_dim(
    f"round({mean_sql('5 - real', '4')}, 6) + 0.0 AS l, round({mean_sql('1', 'real')}, 6) + 0.0 AS r, "
    f"round({mean_sql('1', 'real - 1')}, 6) + 0.0 AS r_off"))
def mean_pool(spark, sf):
    h, left, right = F.col("hidden"), F.col("left_mask"), F.col("right_mask")
    return exploded(token_states(spark, sf).select(
        "idx", vc.mean_pool(h, left).alias("l"), vc.mean_pool(h, right, "right").alias("r"),
        vc.mean_pool(h, right, "right", 1).alias("r_off"),
    ), "l", "r", "r_off")


@query("mean_pool_nan_safe", by_dim(
    """round(list_sum(list_transform(hidden[1:real],
         lambda h: CASE WHEN h[d + 1] < -0.1 THEN 0 ELSE h[d + 1] END)) / real, 6) + 0.0 AS x"""))
def mean_pool_nan_safe(spark, sf):
    """Values below -0.1 become NaN and must count as 0."""
    holes = F.transform("hidden", lambda h: F.transform(h.cast("array<double>"), lambda x: F.when(
        x < -0.1, F.lit(float("nan"))).otherwise(x)))
    out = token_states(spark, sf).select(
        "idx", vc.mean_pool(holes, F.col("right_mask"), "right", nan_safe=True).alias("x"))
    return exploded(out, "x")


@query("last_token_pool", by_dim(
    "round(hidden[4][d + 1], 6) + 0.0 AS l, round(hidden[real][d + 1], 6) + 0.0 AS r, "
    "round(hidden[real - 1][d + 1], 6) + 0.0 AS r_off"))
def last_token_pool(spark, sf):
    h, left, right = F.col("hidden"), F.col("left_mask"), F.col("right_mask")
    return exploded(token_states(spark, sf).select(
        "idx", vc.last_token_pool(h, left).alias("l"),
        vc.last_token_pool(h, right, "right").alias("r"),
        vc.last_token_pool(h, right, "right", 1).alias("r_off"),
    ), "l", "r", "r_off")


@query("multi_pool", f"""WITH {STATES}
SELECT idx, CAST(d AS INT) AS dim, round(CASE WHEN d < 16 THEN hidden[4][d + 1] ELSE
  list_sum(list_transform(hidden[5 - real:4], lambda h: h[d - 15])) / real END, 6) + 0.0 AS x
FROM states, (SELECT unnest(range(32)) AS d)""")
def multi_pool(spark, sf):
    out = token_states(spark, sf).select(
        "idx", vc.multi_pool(F.col("hidden"), F.col("left_mask"), "lasttoken,mean").alias("x"))
    return exploded(out, "x")


@query("pool_token_rows", by_dim(
    f"round({mean_sql('5 - real', '4')}, 6) + 0.0 AS l, round({mean_sql('1', 'real')}, 6) + 0.0 AS r, "
    f"round({mean_sql('1', 'real - 1')}, 6) + 0.0 AS r_off, round(hidden[4][d + 1], 6) + 0.0 AS last_l, "
    "round(hidden[real][d + 1], 6) + 0.0 AS last_r, round(hidden[real - 1][d + 1], 6) + 0.0 AS last_r_off"))
def pool_token_rows(spark, sf):
    """The poolings once more, from one row per token."""
    states = token_states(spark, sf)
    left, right = (pl.token_rows(states, ["idx"], mask=f"{side}_mask") for side in ("left", "right"))
    parts = {
        "l": pl.mean_pool_rows(left, ["idx"]), "r": pl.mean_pool_rows(right, ["idx"], "right"),
        "r_off": pl.mean_pool_rows(right, ["idx"], "right", 1),
        "last_l": pl.last_token_pool_rows(left, ["idx"]), "last_r": pl.last_token_pool_rows(right, ["idx"], "right"),
        "last_r_off": pl.last_token_pool_rows(right, ["idx"], "right", 1),
    }
    out = states.select("idx")
    for name, pooled in parts.items():
        out = out.join(pooled.withColumnRenamed("pooled", name), "idx")
    return exploded(out, *parts)


@query("select_layer", by_dim(
    "round(h4[d + 1], 6) + 0.0 AS last, round(h2[d + 1], 6) + 0.0 AS second"))
def select_layer(spark, sf):
    stack = F.array("h1", "h2", "h3", "h4")
    out = b.layers(spark, sf).select(
        "idx", vc.select_layer(stack).cast("array<double>").alias("last"),
        vc.select_layer(stack, 1).cast("array<double>").alias("second"))
    return exploded(out, "last", "second")


LAYER_SQL = f"""dims AS (SELECT unnest(range(0, 16)) AS d),
lays AS (SELECT unnest(range(0, 4)) AS layer),
shares AS (
  SELECT method, layer, sum(1 + rise * layer) OVER (PARTITION BY method ORDER BY layer) AS upto,
         sum(1 + rise * layer) OVER (PARTITION BY method) AS total
  FROM lays, (VALUES (0, 1.0::DOUBLE), (1, 0.0), (3, 0.0)) v(method, rise)),
owned AS (
  SELECT method, min(layer) AS layer, d FROM shares, dims
  WHERE {b.u32("'1234|owner|' || d")} / 4294967296.0::DOUBLE * total < upto GROUP BY method, d),
drawn AS (
  SELECT method, layer, d FROM (
    SELECT layer, d, row_number() OVER (PARTITION BY layer ORDER BY {b.u32("'1234|' || layer || '|' || d")}, d) AS r
    FROM lays, dims), (VALUES (2, 6), (3, 4)) v(method, size)
  WHERE r <= size),
plan AS (
  SELECT method, layer, d, row_number() OVER (PARTITION BY method ORDER BY layer, d) - 1 AS p
  FROM (SELECT * FROM owned UNION SELECT * FROM drawn))"""


@query("layer_mix", f"""WITH {b.LAYERS}, {LAYER_SQL}
SELECT idx, CAST(method AS INT) AS method, CAST(p AS INT) AS dim,
       round(CASE layer WHEN 0 THEN h1[d + 1] WHEN 1 THEN h2[d + 1] WHEN 2 THEN h3[d + 1] ELSE h4[d + 1] END, 6) + 0.0 AS x
FROM layers, plan""")
def layer_mix(spark, sf):
    df = b.layers(spark, sf)
    stack = [F.col(f"h{i}") for i in range(1, 5)]
    mixes = [vc.layer_mix(stack, vc.layer_plan(4, 16, m)) for m in range(4)]
    tagged = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), x.alias("x")) for m, x in enumerate(mixes)]))
    rows = df.select("idx", tagged.alias("t")).select("idx", "t.method", F.posexplode("t.x").alias("dim", "x"))
    return rows.withColumn("x", F.round("x", 6) + 0.0)


@query("merge_layer_batches", by_dim(
    "round(h1[d + 1], 6) + 0.0 AS first, round(h3[d + 1], 6) + 0.0 AS third"))
def merge_layer_batches(spark, sf):
    df = b.layers(spark, sf)
    rows = df.select("idx", F.explode(F.array(*[
        F.struct(F.lit(i).alias("layer"), F.col(f"h{i}").cast("array<double>").alias("vector"))
        for i in range(1, 5)])).alias("r")).select("idx", "r.*")
    merged = vc.merge_layer_batches(rows.repartition("layer"), ["idx"])
    return exploded(merged.select(
        "idx", F.element_at("layers", 1).alias("first"), F.element_at("layers", 3).alias("third")
    ), "first", "third")


SIMILAR = b.VECTOR_PAIRS + """, sims AS (
  SELECT idx1, idx2, diff,
    list_dot_product(emb1, emb2) / (sqrt(list_dot_product(emb1, emb1)) * sqrt(list_dot_product(emb2, emb2))) AS cos,
    sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(emb1[i] - emb2[i] + 1e-6, 2)))) AS d
  FROM vector_pairs)"""


def similarities(spark, sf):
    return b.vector_pairs(spark, sf).select(
        "idx1", "idx2", "diff", vc.cosine("emb1", "emb2").alias("cos"),
        vc.euclidean("emb1", "emb2").alias("d"))


@query("cosine_similarity", f"WITH {SIMILAR} SELECT idx1, idx2, round(cos, 6) AS cos FROM sims")
def cosine_similarity(spark, sf):
    return similarities(spark, sf).select("idx1", "idx2", F.round("cos", 6).alias("cos"))


@query("euclidean_distance", f"WITH {SIMILAR} SELECT idx1, idx2, round(d, 6) AS d FROM sims")
def euclidean_distance(spark, sf):
    return similarities(spark, sf).select("idx1", "idx2", F.round("d", 6).alias("d"))


@query("angular_distance", f"WITH {SIMILAR} SELECT idx1, idx2, round(acos(cos), 6) AS theta FROM sims")
def angular_distance(spark, sf):
    theta = vc.angular(F.col("cos"))
    return similarities(spark, sf).select("idx1", "idx2", F.round(theta, 6).alias("theta"))


@query("pair_logits", f"""WITH {SIMILAR}
SELECT idx1, idx2, round(-cos, 6) AS c0, round(cos, 6) AS c1, round(d - 1, 6) AS e0, round(1 - d, 6) AS e1
FROM sims""")
def pair_logits(spark, sf):
    c, e = vc.cosine_logits(F.col("cos")), vc.euclidean_logits(F.col("d"))
    return similarities(spark, sf).select("idx1", "idx2", *[
        F.round(F.get(x, i), 6).alias(f"{n}{i}") for n, x in (("c", c), ("e", e)) for i in (0, 1)])


@query("contrastive_cosine", f"""WITH {SIMILAR}
SELECT diff, count(*) AS n, round(avg(CASE WHEN diff = 0 THEN 1 - cos
  ELSE greatest(0, 1 + diff / 9.0::DOUBLE - (1 - cos)) END), 6) AS loss FROM sims GROUP BY diff""")
def contrastive_cosine(spark, sf):
    loss = ls.contrastive_cosine(F.col("cos"), F.col("diff") / F.lit(9.0))
    return similarities(spark, sf).groupBy("diff").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("loss"))


@query("contrastive_euclid", f"""WITH {SIMILAR}
SELECT diff, round(avg(CASE WHEN diff = 0 THEN d * d ELSE pow(greatest(0, 2 + (diff - 1) * 1 - d), 2) END), 6) AS by_step,
  round(avg(CASE WHEN diff = 0 THEN d * d ELSE pow(greatest(0, 1.5 + diff / 9.0::DOUBLE * 0.5 - d), 2) END), 6) AS by_norm
FROM sims GROUP BY diff""")
def contrastive_euclid(spark, sf):
    d, diff = F.col("d"), F.col("diff")
    return similarities(spark, sf).groupBy("diff").agg(
        F.round(F.avg(ls.contrastive_euclid(d, diff)), 6).alias("by_step"),
        F.round(F.avg(ls.contrastive_euclid(d, diff / F.lit(9.0), 1.5, 0.5, True)), 6).alias("by_norm"))


@query("angular_loss", f"""WITH {SIMILAR}
SELECT diff, round(avg(CASE WHEN diff = 0 THEN acos(cos) ELSE greatest(0, 1.7 - acos(cos)) END), 6) AS loss
FROM sims GROUP BY diff""")
def angular_loss(spark, sf):
    loss = ls.angular_loss(F.col("cos"), (F.col("diff") == 0).cast("int"), 1.7)
    return similarities(spark, sf).groupBy("diff").agg(F.round(F.avg(loss), 6).alias("loss"))


@query("hybrid_loss", f"""WITH {SIMILAR}
SELECT diff, round(avg(d * d + 0.2 * (abs(cos) + d) / 2), 6) AS loss, round(avg(d * d), 6) AS pair_only
FROM sims GROUP BY diff""")
def hybrid_loss(spark, sf):
    d, lm = F.col("d"), (F.abs("cos"), F.col("d"))
    return similarities(spark, sf).groupBy("diff").agg(
        F.round(F.avg(ls.hybrid_loss(d * d, *lm, 0.2)), 6).alias("loss"),
        F.round(F.avg(ls.hybrid_loss(d * d, *lm, 0.0)), 6).alias("pair_only"))
