"""Token sequences."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import tokens as tk
from ..session import shared_dir
from . import bindings as b
from .catalog import query

PAIR_BLOCK = 6     # bits of an id inside its block
ID_ROWS = 64       # rows of an id up to which their texts meet those of the id before in one list
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
TOKENS = f"""split_words AS (SELECT doc_id, {WORDS} AS ws FROM documents),
vocabulary AS (
  SELECT w, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, w) + {tk.FIRST_ID - 1} AS INT) AS id
  FROM (SELECT unnest(ws) AS w FROM split_words) GROUP BY w),
coded AS (
  SELECT doc_id, list(id ORDER BY i) AS ids
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split_words) JOIN vocabulary USING (w)
  GROUP BY doc_id),
tokens AS (SELECT doc_id, coalesce(ids, []) AS ids FROM split_words LEFT JOIN coded USING (doc_id))"""


def digest(ids):
    return F.md5(F.array_join(F.transform(ids, lambda t: t.cast("string")), ","))


@query("build_vocabulary", f"WITH {TOKENS} SELECT w AS word, n, id FROM vocabulary")
def build_vocabulary(spark, sf):
    return tk.build_vocabulary(b.documents(spark, sf))


@query("tokenize_text", f"""WITH {TOKENS}
SELECT doc_id, CAST(len(ids) AS INT) AS n, CAST(len(ids) AS BIGINT) AS mask_sum,
       md5(array_to_string(ids, ',')) AS ids,
       md5(array_to_string(ids[1:64], ',')) AS cut_ids FROM tokens""")
def tokenize_text(spark, sf):
    source = b.documents(spark, sf).select("doc_id", "text")
    known = tk.build_vocabulary(source)
    docs = tk.tokenize_text(source, vocabulary=known)
    again = tk.tokenize_text(docs)   # already tokenized: unchanged
    cut = tk.tokenize_text(again, max_length=64, suffix="_cut", vocabulary=known)
    return cut.select(
        "doc_id", F.size("input_ids").alias("n"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("mask_sum"),
        digest(F.col("input_ids")).alias("ids"), digest(F.col("input_ids_cut")).alias("cut_ids"),
    )


def text_pairs(spark, sf):
    """Each document beside its successor by id.

    A text travels once, to the block of its id; the first of a block also to the block before it. Tables where an
    id has very many rows are joined instead.
    """
    docs = b.table(spark, sf, "documents").select("doc_id", "text").where("doc_id IS NOT NULL")
    rows = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.max("doc_id").alias("last")).head()
    if (rows["n"] or 0) <= ID_ROWS and (rows["last"] or 0) < (1 << 63) - 1:
        own = F.shiftright("doc_id", PAIR_BLOCK)
        blocks = F.array_distinct(F.array(own, F.shiftright(F.col("doc_id") - 1, PAIR_BLOCK)))
        after = Window.partitionBy("_block").orderBy("doc_id").rangeBetween(1, 1)
        texts = docs.select("doc_id", F.struct("text").alias("_own"), F.explode(blocks).alias("_block"))
        beside = texts.withColumn("_after", F.collect_list("_own").over(after)).where(F.col("_block") == own)
        pairs = beside.select("doc_id", F.col("_own.text").alias("txt1"), F.explode("_after").alias("_next"))
        pairs = pairs.select("doc_id", "txt1", F.col("_next.text").alias("txt2"))
    else:
        after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("txt2"))
        pairs = docs.withColumnRenamed("text", "txt1").join(after, "doc_id")
    return pairs.withColumn("diff", (F.col("doc_id") % 4).cast("int"))


PAIR_TOKENS = TOKENS + """, pair_tokens AS (
  SELECT a.doc_id, a.ids AS ids1, b.ids AS ids2, a.doc_id % 4 AS diff
  FROM tokens a JOIN tokens b ON b.doc_id = a.doc_id + 1)"""


def pair_tokens(spark, sf):
    """Tokenized pairs that keep their document id, in batches of 8.

    Every text is tokenized once and kept; only ids move in the join.
    """
    shared_dir(spark)
    coded = tk.tokenize_text(b.documents(spark, sf).select("doc_id", "text")).drop("text").checkpoint()
    first = coded.toDF("doc_id", "input_ids_1", "attention_mask_1")
    after = coded.select(F.col("doc_id") - 1, "input_ids", "attention_mask").toDF(
        "doc_id", "input_ids_2", "attention_mask_2")
    return first.join(after, "doc_id").withColumns({
        "diff": (F.col("doc_id") % 4).cast("int"), "batch": F.floor(F.col("doc_id") / 8)})


@query("tokenize_pairs", f"""WITH {PAIR_TOKENS}
SELECT md5(array_to_string(ids1, ',')) AS ids1, md5(array_to_string(ids2, ',')) AS ids2,
       CAST(len(ids1) AS INT) AS mask1, CAST(len(ids2) AS INT) AS mask2, CAST(diff AS INT) AS diff_abs
FROM pair_tokens""")
def tokenize_pairs(spark, sf):
    known = tk.build_vocabulary(b.documents(spark, sf))
    return tk.tokenize_pairs(text_pairs(spark, sf), vocabulary=known).select(
        digest(F.col("input_ids_1")).alias("ids1"), digest(F.col("input_ids_2")).alias("ids2"),
        F.size("attention_mask_1").alias("mask1"), F.size("attention_mask_2").alias("mask2"), "diff_abs",
    )


@query("pad_batch", f"""WITH {PAIR_TOKENS}, goals AS (
  SELECT *, (max(len(ids1)) OVER w + 3) // 4 * 4 AS g1, (max(len(ids2)) OVER w + 3) // 4 * 4 AS g2
  FROM pair_tokens WINDOW w AS (PARTITION BY doc_id // 8))
SELECT doc_id, CAST(g1 AS INT) AS n1, CAST(g2 AS INT) AS n2,
  md5(array_to_string(list_concat(list_transform(range(g1 - len(ids1)), lambda x: 0), ids1), ',')) AS ids1,
  md5(array_to_string(list_concat(list_transform(range(g2 - len(ids2)), lambda x: 0), ids2), ',')) AS ids2,
  md5(repeat('0', CAST(g1 - len(ids1) AS INT)) || repeat('1', CAST(len(ids1) AS INT))) AS mask1
FROM goals""")
def pad_batch(spark, sf):
    padded = tk.pad_batch(pair_tokens(spark, sf))
    return padded.select(
        "doc_id", F.size("input_ids_1").alias("n1"), F.size("input_ids_2").alias("n2"),
        digest(F.col("input_ids_1")).alias("ids1"), digest(F.col("input_ids_2")).alias("ids2"),
        F.md5(F.array_join(F.transform("attention_mask_1", lambda m: m.cast("string")), "")).alias("mask1"),
    )


@query("mask_labels", f"""WITH {PAIR_TOKENS}, goals AS (
  SELECT *, (max(len(ids1)) OVER (PARTITION BY doc_id // 8) + 3) // 4 * 4 AS g1 FROM pair_tokens)
SELECT doc_id, md5(array_to_string(
  list_concat(ids1, list_transform(range(g1 - len(ids1)), lambda x: -100)), ',')) AS labels FROM goals""")
def mask_labels(spark, sf):
    padded = tk.pad_batch(pair_tokens(spark, sf), suffixes=("_1",), side="right")
    labels = tk.mask_labels("input_ids_1", "attention_mask_1")
    return padded.select("doc_id", digest(labels).alias("labels"))


@query("length_histogram", f"""WITH {PAIR_TOKENS}, lens AS (
  SELECT len(ids1) AS len FROM pair_tokens UNION ALL SELECT len(ids2) FROM pair_tokens),
e AS (SELECT min(len) AS lo, (max(len) - min(len)) / 20.0::DOUBLE AS w, max(len) - min(len) AS ptp FROM lens),
first_pass AS (
  SELECT least(floor((len - lo) / w), ceil(20 + 1 / w) - 2) AS bin, count(*) AS n FROM lens, e GROUP BY 1),
seen AS (
  SELECT max(bin) FILTER (floor(100 / (SELECT max(n) FROM first_pass)::DOUBLE * n) > 0) AS last FROM first_pass),
nb AS (SELECT CASE WHEN last < 16 THEN floor(400 / (last + 1)) ELSE 20 END AS nb FROM seen),
final AS (
  SELECT least(floor((len - lo) / (ptp / nb)), ceil(nb + nb / ptp) - 2) AS bin, count(*) AS n
  FROM lens, e, nb GROUP BY 1),
shown AS (
  SELECT max(bin) FILTER (floor(100 / (SELECT max(n) FROM final)::DOUBLE * n) > 0) AS last FROM final),
grid AS (SELECT unnest(range(0, CAST(last AS INT) + 1)) AS bin FROM shown)
SELECT CAST(grid.bin AS INT) AS bin, round(lo + grid.bin * (ptp / nb), 4) AS low,
       round(lo + (grid.bin + 1) * (ptp / nb), 4) AS high, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM grid CROSS JOIN e CROSS JOIN nb LEFT JOIN final ON final.bin = grid.bin""")
def length_histogram(spark, sf):
    size = b.documents(spark, sf).select("doc_id", F.size(words(F.col("text"))).alias("len1"))
    after = size.select((F.col("doc_id") - 1).alias("doc_id"), F.col("len1").alias("len2"))
    out = tk.length_histogram(size.join(after, "doc_id"), ("len1", "len2"))
    return out.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query("start_token_check", f"""WITH {TOKENS}, marked AS (
  SELECT source, lang, CASE WHEN lang = 'en' THEN list_concat([7], ids)
    WHEN lang = 'fr' THEN ids WHEN source <> 'src3' THEN list_concat([8], ids)
    ELSE list_concat([8], list_append(ids, 8)) END AS ids
  FROM tokens JOIN documents USING (doc_id))
SELECT source, lang, CAST(CASE WHEN min(ids[1]) = max(ids[1]) AND NOT bool_or(list_contains(ids[2:], ids[1]))
  THEN min(ids[1]) END AS INT) AS start_token
FROM marked GROUP BY source, lang""")
def start_token_check(spark, sf):
    ids = F.col("input_ids")
    marked = (
        F.when(F.col("lang") == "en", F.concat(F.array(F.lit(7)), ids))
        .when(F.col("lang") == "fr", ids)
        .when(F.col("source") != "src3", F.concat(F.array(F.lit(8)), ids))
        .otherwise(F.concat(F.array(F.lit(8)), ids, F.array(F.lit(8))))
    )
    docs = tk.tokenize_text(b.documents(spark, sf)).withColumn("input_ids", marked)
    return tk.start_token_check(docs, ["source", "lang"])
